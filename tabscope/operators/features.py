"""Feature importance, mutual information and target correlation (FEA-1..3)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import column_quantiles, tall
from .prep import feature_frame
from .roles import distinct_counts


def target_correlation(df: DataFrame, target: str, cols: list[str], top: int = 20) -> DataFrame:
    """FEA-3: ``(rank, feature, correlation)``, pairwise complete with n > 2, by |r|."""
    cols = [c for c in cols if c != target]
    if not cols:
        return df.sparkSession.createDataFrame([], "rank int, feature string, correlation double")
    aggs = []
    for i, c in enumerate(cols):
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        aggs += [F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r{i}"),
                 F.sum(both.cast("long")).alias(f"n{i}")]
    one = df.agg(*aggs).first()  # one row: ranked locally (one entry per column)
    got = [(c, float(one[f"r{i}"])) for i, c in enumerate(cols)
           if one[f"n{i}"] and one[f"n{i}"] > 2 and one[f"r{i}"] is not None]
    got.sort(key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame([(k + 1, f, r) for k, (f, r) in enumerate(got[:top])],
                                           "rank int, feature string, correlation double")


def cut_points(df: DataFrame, cols: list[str], q: int = 10) -> dict[str, list[float]]:
    """The distinct inner ``q``-quantiles of each column that has values."""
    names = {f"q{j}": j / q for j in range(1, q)}
    return {r["variable"]: sorted({r[n] for n in names}) for r in column_quantiles(df, cols, names).collect()}


def decile_bins(df: DataFrame, cols: list[str], q: int = 10) -> DataFrame:
    """Tall ``(variable, value, bin)``: bin = number of distinct decile edges below the value."""
    t = tall(df, cols).where(F.col("value").isNotNull())
    edges = df.sparkSession.createDataFrame(list(cut_points(df, cols, q).items()), "variable string, _e array<double>")
    j = t.join(F.broadcast(edges), "variable")      # one row per column
    return j.select("variable", "value",
                    F.size(F.filter("_e", lambda e: F.col("value") > e)).alias("bin"))


def mutual_information(df: DataFrame, target: str, cols: list[str], key: str,
                       target_discrete: bool = True, top: int = 20) -> DataFrame:
    """FEA-2 (plug-in estimator): ``sum p(x,y) log(p(x,y) / (p(x) p(y)))`` in nats.

    Numeric features are cut at their deciles; the target is used as is when
    discrete, else cut at its deciles too.  Rows need both values.
    """
    cols = [c for c in cols if c != target]
    base = df.select(key, target, *cols)
    # decile edges per feature (<= 9 each), then the bin as a column expression
    emap = cut_points(base, cols)
    if target_discrete:
        ycol = F.col(target).cast("string")
    else:
        ye = cut_points(base, [target]).get(target, [])
        ycol = sum((F.when(F.col(target) > F.lit(e), 1).otherwise(0) for e in ye), F.lit(0)).cast("string")
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                      sum((F.when(F.col(c) > F.lit(e), 1).otherwise(0)
                                           for e in emap.get(c, [])), F.lit(0)).alias("x"),
                                      F.col(c).isNull().alias("_xn")) for c in cols]))
    cells = (base.where(F.col(target).isNotNull())
                 .select(ycol.alias("y"), st.alias("s")).select("y", "s.*").where(~F.col("_xn"))
                 .groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("nxy")))
    w_f = Window.partitionBy("feature")
    w_x = Window.partitionBy("feature", "x")
    w_y = Window.partitionBy("feature", "y")
    c = (cells.withColumn("n", F.sum("nxy").over(w_f)).withColumn("nx", F.sum("nxy").over(w_x))
              .withColumn("ny", F.sum("nxy").over(w_y)))
    mi = c.groupBy("feature").agg(
        F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny"))))
        .alias("mutual_info"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("mutual_info").desc(), "feature")
    return (mi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
              .select(F.col("rank").cast("int").alias("rank"), "feature", "mutual_info"))


def rf_importance(df: DataFrame, target: str, numeric_cols: list[str], other_cols: list[str],
                  trees: int = 100, top: int = 20, seed: int = 42,
                  max_depth: int = 30) -> DataFrame:
    """FEA-1: random-forest importance (classifier when the target has <= 20 values)."""
    from .forest import forest_importance
    spark = df.sparkSession
    x, names = feature_frame(df, target, numeric_cols, other_cols)
    if not names:
        return spark.createDataFrame([], "rank int, feature string, importance double")
    nd = distinct_counts(df, [target]).first()
    is_cls = nd is not None and nd["n_distinct"] <= 20
    classes, take, label = 0, None, target
    if is_cls:
        from .prep import encode_labels
        x, levels = encode_labels(x, target)
        classes, take, label = len(levels), math.ceil(math.sqrt(len(names))), "label"
    imp = forest_importance(x, label, names, classes, trees, take, max_depth, seed)
    rows = sorted(zip(names, [float(v) for v in imp]), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")

"""Correlation (COR-1, 2, 4, 5), pairwise complete.

Pearson: every ``corr(a, b)`` in one aggregate (Spark's ``corr`` skips a
row when either side is null).  Spearman: mid-ranks of each column once, for every
partner column that has nulls, then Pearson of ranks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import col, r4
from ..functions.quantiles import running_sums


FEW = 10_000        # most distinct values of a column whose ranks are broadcast


def _pairs(cols):
    return [(i, j) for i, j in combinations(range(len(cols)), 2)]


def _corr(a: str, b: str):
    """``corr`` that is null where a column is constant over the pair's rows (Spark's raises under ANSI)."""
    c, r2 = F.covar_pop(a, b), F.regr_r2(a, b)
    return F.when((c == 0) & (r2 == 1), F.lit(None)).otherwise(F.signum(c) * F.sqrt(r2))


def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(var1, var2, i, j, r)`` for the full matrix, diagonal 1.0; < 2 columns → empty."""
    schema = "var1 string, var2 string, i long, j long, r double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    x = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    aggs = [_corr(f"_{i}", f"_{j}").alias(f"_c{i}_{j}") for i, j in _pairs(cols)]
    # one row of p(p-1)/2 numbers: the p x p matrix is built locally from it
    one = x.agg(*aggs).first()
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = 1.0 if i == j else one[f"_c{min(i, j)}_{max(i, j)}"]
            rows.append((a, b, i, j, None if v is None else float(v)))
    return df.sparkSession.createDataFrame(rows, schema)


def spearman_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Spearman ρ per pair over the pair's complete rows (average ranks for ties).

    A row becomes one row per column, never one per pair.  The ranks of a column depend on its partner only where
    the partner has nulls; so each distinct value carries one count for the whole column and one for each column with
    nulls (rows where that column is there), and one run over the sorted values turns all of them into
    mid-ranks.  The ranks go back to the rows by value, and all correlations are one aggregate.
    """
    spark = df.sparkSession
    schema = "var1 string, var2 string, i long, j long, r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    p = range(len(cols))
    x = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    full = x.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"_{i}").alias(f"n{i}") for i in p]).first()
    with_nulls = [i for i in p if full[f"n{i}"] < full["n"]]
    slot = {i: with_nulls.index(i) + 1 if i in with_nulls else 0 for i in p}       # 0: every row of the column
    flags = ["_f0", *[f"_f{slot[i]}" for i in with_nulls]]
    rows = x.withColumn("_id", F.monotonically_increasing_id()).withColumn("_f0", F.lit(1).cast("long"))
    rows = rows.withColumns({f"_f{slot[i]}": F.col(f"_{i}").isNotNull().cast("long") for i in with_nulls})
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("_c"), F.col(f"_{i}").alias("_v")) for i in p]))
    t = rows.select("_id", *flags, each.alias("_s")).select("_id", *flags, "_s._c", "_s._v").where(F.col("_v").isNotNull())
    ranks = running_sums(t, ["_c"], "_v", flags)
    ranks = ranks.select("_c", "_v", *[(F.col(f"cum_{f}") + (F.col(f) + 1) / 2).alias(f"r{f}") for f in flags])
    # columns with few values get their ranks where their rows are
    few = [r["_c"] for r in ranks.groupBy("_c").count().collect() if r["count"] <= FEW]       # a row a column
    is_few = F.col("_c").isin(few) if few else F.lit(False)
    tall = t.select("_id", "_c", "_v")
    back = tall.where(~is_few).join(ranks.where(~is_few), ["_c", "_v"])
    if few:
        back = back.unionByName(tall.where(is_few).join(F.broadcast(ranks.where(is_few)), ["_c", "_v"]))
    used = sorted({(i, slot[j]) for i in p for j in p if i != j})
    # sent as they are: a partial sum of one value would send a column for each of the others too
    meet = back.select("_id", "_c", *[f"r{f}" for f in flags]).repartition("_id")
    wide = meet.groupBy("_id").agg(*[F.max(F.when(F.col("_c") == i, F.col(f"r_f{k}"))).alias(f"r{i}_{k}") for i, k in used])
    one = wide.agg(*[_corr(f"r{i}_{slot[j]}", f"r{j}_{slot[i]}").alias(f"_c{i}_{j}")
                     for i, j in _pairs([None] * len(cols))]).first()
    out = [(a, b, i, j, 1.0 if i == j else one[f"_c{min(i, j)}_{max(i, j)}"]) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return spark.createDataFrame(out, schema)


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    if method == "pearson":
        return pearson_matrix(df, cols)
    if method == "spearman":
        return spearman_matrix(df, cols)
    if method == "kendall":
        return kendall_matrix(df, cols)
    raise ValueError(f"unsupported correlation method {method!r}")


def strength(r_abs):
    """COR-5: |r| > .7 strong, > .3 moderate, otherwise weak."""
    return F.when(r_abs > 0.7, "strong").when(r_abs > 0.3, "moderate").otherwise("weak")


def top_pairs(matrix: DataFrame, k: int = 10) -> DataFrame:
    """COR-4: upper triangle sorted by |r| descending, first ``k`` (ties by position)."""
    up = matrix.where(F.col("i") < F.col("j"))
    return (up.orderBy(F.abs("r").desc_nulls_last(), "i", "j").limit(k)
              .select("var1", "var2", r4("r").alias("r"), strength(F.abs("r")).alias("strength")))


# ---------------------------------------------------------------- COR-3
def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall tau-b of one pair over its complete rows, exact.

    The numerator ``concordant - discordant`` is a 2-D dominance count.  With
    ``r`` the dense rank of y, a pair (j, i) with ``x_j < x_i`` is concordant
    when r_j < r_i, i.e. when at the highest bit ``b`` where the ranks differ
    r_j has 0 and r_i has 1 under the same prefix ``r >> (b + 1)``.  So for
    every bit level and prefix the running count of 0-bits (and of 1-bits)
    over increasing x gives all pairs at once:
    ``S = sum(ones * zeros_before) - sum(zeros * ones_before)``.
    Points are first collapsed to distinct (x, r) with weights; the running
    sums are the range-partitioned ``running_sums`` (no one-task window), and
    no pair of rows is ever formed.  Work is O(n log D).
    """
    from ..functions.frames import dense_codes
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    codes = dense_codes(d.select("y"), "y")
    n_codes = codes.count()
    levels = max(1, int(max(n_codes - 1, 1)).bit_length())
    pts = d.join(codes, "y").groupBy("x", "_code").agg(F.count(F.lit(1)).alias("w"))
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("b")
    p2 = lambda e: F.pow(F.lit(2.0), e)
    e = (pts.select("x", "_code", "w", lv)
            .select("b", F.floor(F.col("_code") / p2(F.col("b") + 1)).cast("long").alias("pre"), "x",
                    (F.floor(F.col("_code") / p2(F.col("b"))).cast("long") % 2).alias("bit"), "w"))
    g = e.groupBy("b", "pre", "x").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("w")).otherwise(0)).cast("decimal(38,0)").alias("z"),
        F.sum(F.when(F.col("bit") == 1, F.col("w")).otherwise(0)).cast("decimal(38,0)").alias("o"))
    rs = running_sums(g, ["b", "pre"], "x", ["z", "o"])
    s = rs.agg(F.sum(F.col("o") * F.col("cum_z") - F.col("z") * F.col("cum_o")).alias("S"))
    tx = d.groupBy("x").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c")) \
          .agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("n1"))
    ty = d.groupBy("y").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c")) \
          .agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("n2"))
    n = d.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    from ..functions.frames import attach_scalars
    one = attach_scalars(attach_scalars(attach_scalars(s, tx), ty), n)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    den = F.sqrt(((n0 - F.col("n1")) * (n0 - F.col("n2"))).cast("double"))
    return one.select(F.col("n").cast("long").alias("n"), F.col("S").cast("double").alias("s"),
                      F.try_divide(F.col("S").cast("double"), den).alias("tau_b"))


def kendall_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """COR-3: ``(var1, var2, i, j, r)`` upper and lower triangle plus diagonal."""
    spark = df.sparkSession
    rows = []
    for i, j in _pairs(cols):
        tau = kendall_tau_b(df, cols[i], cols[j]).first()["tau_b"]
        rows += [(cols[i], cols[j], i, j, tau), (cols[j], cols[i], j, i, tau)]
    rows += [(c, c, i, i, 1.0) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "var1 string, var2 string, i long, j long, r double")

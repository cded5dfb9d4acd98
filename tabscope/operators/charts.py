"""Chart data (CHT-1..6): the numbers behind each chart, not the drawing.

Two-phase charts (histogram, box plot) compute one small bounds table per
column and ship it to the data with a broadcast join — nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import col, r4, top_k_per_group
from ..functions.normal import norm_ppf
from ..functions.quantiles import column_quantiles, rank_ranges, tall

# Largest run of equal values expanded into positions inside one task.
RANK_CHUNK = 100_000


# ---------------------------------------------------------------- CHT-1
def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """``(variable, bin, bin_lo, bin_hi, count)``: equal-width bins on [min, max].

    The last bin is closed; every bin is reported, empty ones with 0.  A
    constant column is centred in [v - .5, v + .5] (the NumPy rule).
    """
    t = tall(df, cols).where(F.col("value").isNotNull())
    b = t.groupBy("variable").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    b = b.select("variable",
                 F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                 F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (t.join(F.broadcast(b), "variable").groupBy("variable", idx.alias("bin"))
               .agg(F.count(F.lit(1)).alias("count")))
    grid = b.select("variable", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, ["variable", "bin"], "left")
                .select("variable", F.col("bin").cast("long").alias("bin"),
                        r4(F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                        r4(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


# ---------------------------------------------------------------- CHT-2
def box_stats(df: DataFrame, cols: list[str], max_cols: int | None = None, whis: float = 1.5) -> DataFrame:
    """``(variable, q1, median, q3, whisker_lo, whisker_hi, n_fliers)``.

    Whiskers are the most extreme data inside ``[q1 - 1.5 IQR, q3 + 1.5 IQR]``.
    """
    cols = cols[:max_cols]
    q = column_quantiles(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    boxes = q.collect()         # one row per column
    if not boxes:
        return q.select("variable", *[F.lit(None).cast("double").alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                        F.lit(None).cast("long").alias("n_fliers"))
    aggs = []
    for i, b in enumerate(boxes):
        v, iqr = col(b["variable"]).cast("double"), b["q3"] - b["q1"]
        inside = (v >= F.lit(b["q1"] - whis * iqr)) & (v <= F.lit(b["q3"] + whis * iqr))
        aggs += [F.min(F.when(inside, v)).alias(f"lo{i}"), F.max(F.when(inside, v)).alias(f"hi{i}"), F.sum((~inside).cast("long")).alias(f"out{i}")]
    one = df.agg(*aggs).first()
    w = df.sparkSession.createDataFrame([(b["variable"], one[f"lo{i}"], one[f"hi{i}"], one[f"out{i}"]) for i, b in enumerate(boxes)],
                                        "variable string, whisker_lo double, whisker_hi double, n_fliers long")
    return q.join(w, "variable").select(
        "variable", r4("q1").alias("q1"), r4("median").alias("median"), r4("q3").alias("q3"),
        r4("whisker_lo").alias("whisker_lo"), r4("whisker_hi").alias("whisker_hi"), "n_fliers")


# ---------------------------------------------------------------- CHT-3
def bar_counts(df: DataFrame, cols: list[str], top: int = 20, max_cols: int | None = None) -> DataFrame:
    """``(column_name, rank, category, count)``; nulls dropped, ties by value."""
    cols = cols[:max_cols]
    t = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
           .unpivot([], cols, "column_name", "category").where(F.col("category").isNotNull()))
    counts = t.groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("count"))
    r = top_k_per_group(counts, ["column_name"], [F.col("count").desc(), F.col("category").asc()],
                        top, salt_col="category")
    return r.select("column_name", F.col("rank").cast("long").alias("rank"), "category",
                    F.col("count").cast("long").alias("count"))


# ---------------------------------------------------------------- CHT-4
def scatter_sample(df: DataFrame, cols: list[str], key_cols: list[str], k: int = 1000,
                   color: str | None = None, max_cols: int | None = None) -> DataFrame:
    """A repeatable hash-ordered sample of the columns (the first ``max_cols``, if given).

    Rows are ordered by ``md5`` of the key columns joined with '|' and the
    first ``k`` kept (a per-partition top-k, then a merge: no global sort).
    """
    cols = cols[:max_cols]
    keep = list(dict.fromkeys(key_cols + cols + ([color] if color and color not in cols else [])))
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]))
    return df.select(*keep, h.alias("sample_key")).orderBy("sample_key").limit(k)


# ---------------------------------------------------------------- CHT-5
def _positions(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(variable, n, i, value)``: every sorted position ``i`` (1-based) of each column.

    Runs of equal values are expanded in chunks of ``RANK_CHUNK`` spread over
    tasks, so a value holding a third of the rows is not one task's work.
    """
    t = tall(df, cols)
    rr = rank_ranges(t, ["variable"], "value")
    n = rr.groupBy("variable").agg(F.sum("_c").alias("n"))
    chunks = (rr.select("variable", "_v", "_c", "_start",
                        F.explode(F.sequence(F.lit(0), ((F.col("_c") - 1) / RANK_CHUNK).cast("long")))
                         .alias("_j"))
                .select("variable", "_v", (F.col("_start") + F.col("_j") * RANK_CHUNK + 1).alias("_a"),
                        F.least(F.col("_start") + F.col("_c"),
                                F.col("_start") + (F.col("_j") + 1) * RANK_CHUNK).alias("_b"))
                .repartition("variable", "_a"))
    pos = chunks.select("variable", F.col("_v").alias("value"),
                        F.explode(F.sequence("_a", "_b")).alias("i"))
    return pos.join(F.broadcast(n), "variable")


def filliben(i, n):
    """Filliben's order-statistic medians (the ``probplot`` plotting positions)."""
    nd = n.cast("double")
    return (F.when(i == n, F.pow(F.lit(0.5), 1 / nd))
             .when(i == 1, 1 - F.pow(F.lit(0.5), 1 / nd))
             .otherwise((i - 0.3175) / (nd + 0.365)))


def qq_points(df: DataFrame, cols: list[str], min_n: int = 5, max_cols: int | None = None) -> DataFrame:
    """``(variable, i, theoretical, sample)`` — normal Q-Q points, n >= ``min_n``."""
    p = _positions(df, cols[:max_cols]).where(F.col("n") >= min_n)
    return p.select("variable", "i", norm_ppf(filliben(F.col("i"), F.col("n"))).alias("theoretical"),
                    F.col("value").alias("sample"))


def qq_fit(df: DataFrame, cols: list[str], min_n: int = 5, max_cols: int | None = None) -> DataFrame:
    """``(variable, n, slope, intercept, r)`` of the least-squares line through the Q-Q points.

    Reported to 3 decimals: the intercept equals the column mean, which on integer
    data often sits exactly on a 4th-decimal rounding tie."""
    p = qq_points(df, cols, min_n, max_cols)
    return (p.groupBy("variable")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.regr_slope("sample", "theoretical").alias("slope"),
                  F.regr_intercept("sample", "theoretical").alias("intercept"),
                  F.corr("sample", "theoretical").alias("r"))
             .select("variable", F.col("n").cast("long").alias("n"), r4("slope", 3).alias("slope"),
                     r4("intercept", 3).alias("intercept"), r4("r", 3).alias("r")))


# ---------------------------------------------------------------- CHT-6
def importance_bars(imp: DataFrame, name_col: str = "feature", value_col: str = "importance",
                    top: int = 20) -> DataFrame:
    """``(rank, feature, importance, above_mean)``: top ``top`` by value, flag > mean of shown."""
    w = Window.orderBy(F.col(value_col).desc(), F.col(name_col).asc())
    top_rows = imp.select(name_col, value_col).orderBy(F.col(value_col).desc(), F.col(name_col)).limit(top)
    ranked = top_rows.withColumn("rank", F.row_number().over(w).cast("long"))
    mean = F.avg(value_col).over(Window.partitionBy(F.lit(1)))
    return ranked.select("rank", name_col, value_col, (F.col(value_col) > mean).alias("above_mean"))

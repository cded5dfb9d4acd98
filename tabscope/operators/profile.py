"""Data-quality profile and descriptive statistics (AGG-1..15).

Every statistic over many columns is one aggregate over a tall
``(variable, value)`` frame, so the table is scanned once per statistic
family and Spark's partial (map-side) aggregation does the heavy lifting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import attach_scalars, col, r4, top_k_per_group, value_hash
from ..functions.quantiles import column_quantiles, tall
from .roles import NUMERIC

_GROUPABLE_SKIP = (T.MapType,)


def numeric_columns(df: DataFrame, include_bool: bool = True) -> list[str]:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC):
            if include_bool or not isinstance(f.dataType, T.BooleanType):
                out.append(f.name)
    return out


# ---------------------------------------------------------------- AGG-1,4,5
def profile_summary(df: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_cols, total_missing, duplicate_rows``.

    Duplicates are rows beyond the first of each identical group, nulls equal
    to each other.  Rows are grouped by a 128-bit hash of their typed values, so a row
    is shuffled as 16 bytes however wide it is and counted map-side.
    """
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, _GROUPABLE_SKIP)]
    miss = sum((col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    basic = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(miss).alias("total_missing"))
    one, two = value_hash([(col(c), df.schema[c].dataType) for c in cols])
    dups = (df.select(one.alias("_a"), two.alias("_b")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_c"))
              .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows")))
    out = attach_scalars(basic, dups)
    return out.select(F.col("n_rows").cast("long").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"),
                      F.coalesce(F.col("total_missing"), F.lit(0)).cast("long").alias("total_missing"),
                      F.col("duplicate_rows").cast("long").alias("duplicate_rows"))


# ---------------------------------------------------------------- AGG-2
def column_dtypes(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string")


# ---------------------------------------------------------------- AGG-3
def missing_values(df: DataFrame) -> DataFrame:
    """``(position, column_name, missing_count, missing_pct)`` in one pass."""
    if not df.columns:
        return df.sparkSession.createDataFrame(
            [], "position int, column_name string, missing_count bigint, missing_pct double")
    aggs = [F.count(F.lit(1)).alias("_rows")] + \
           [F.sum(col(c).isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs).first()  # one row: the table is built locally from it
    rows_n = int(one["_rows"] or 0)
    rows = []
    for i, c in enumerate(df.columns):
        m = int(one[f"_m{i}"] or 0)
        rows.append((i, c, m, m / max(rows_n, 1) * 100))
    out = df.sparkSession.createDataFrame(
        rows, "position int, column_name string, missing_count bigint, missing_pct double")
    return out.withColumn("missing_pct", F.round("missing_pct", 2))


def missing_table(df: DataFrame) -> DataFrame:
    """FND-2: only the columns that have missing values."""
    return missing_values(df).where(F.col("missing_count") > 0)


# ---------------------------------------------------------------- AGG-6
def iqr_bounds(df: DataFrame, cols: list[str], min_count: int = 4) -> DataFrame:
    """``(variable, n, q1, q3, lower, upper)`` for columns with >= ``min_count`` values."""
    q = column_quantiles(df, cols, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return (q.where(F.col("n") >= min_count)
             .select("variable", "n", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower"),
                     (F.col("q3") + 1.5 * iqr).alias("upper")))


def outlier_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, outliers)``: strict IQR rule; booleans are not examined."""
    cols = numeric_columns(df, include_bool=False) if cols is None else cols
    bounds = {r["variable"]: r for r in iqr_bounds(df, cols).collect()}      # one row per column
    ddl = "column_name string, outliers bigint"
    if not bounds:
        return df.sparkSession.createDataFrame([], ddl)
    v = {c: col(c).cast("double") for c in bounds}
    one = df.agg(*[F.sum(((v[c] < F.lit(b["lower"])) | (v[c] > F.lit(b["upper"]))).cast("long")).alias(f"_o{i}")
                   for i, (c, b) in enumerate(bounds.items())]).first()
    return df.sparkSession.createDataFrame([(c, one[f"_o{i}"]) for i, c in enumerate(bounds)], ddl)


# ---------------------------------------------------------------- AGG-7..10
_DESCRIBED = ("count", "mean", "median", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis")


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column with at least one value.

    count, mean, std (ddof 1, null for n = 1), min, quartiles, max, population
    skewness and excess kurtosis, all rounded to 4 decimals.
    """
    cols = numeric_columns(df) if cols is None else cols
    q = column_quantiles(df, cols, {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n")
    if not cols:
        return q.select("variable", *[F.lit(None).cast("long" if c == "count" else "double").alias(c) for c in _DESCRIBED])
    # the moments of all columns in one pass; one row of numbers reaches the driver
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
             "skewness": F.skewness, "kurtosis": F.kurtosis}
    one = df.agg(*[f(col(c).cast("double")).alias(f"{s}{i}") for i, c in enumerate(cols) for s, f in stats.items()]).first()
    mom = df.sparkSession.createDataFrame([(c, *[one[f"{s}{i}"] for s in stats]) for i, c in enumerate(cols)],
                                          "variable string, count long, mean double, std double, min double, max double, skewness double, kurtosis double")
    j = mom.join(q, "variable")
    return j.select(
        "variable", F.col("count").cast("long").alias("count"), r4("mean").alias("mean"), r4("median").alias("median"),
        r4("std").alias("std"), r4("min").alias("min"), r4("q25").alias("q25"),
        r4("median").alias("q50"), r4("q75").alias("q75"), r4("max").alias("max"),
        r4("skewness").alias("skewness"), r4("kurtosis").alias("kurtosis"))


def skew_bias_corrected(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-11: ``(variable, n, g1)`` — pandas ``.skew()`` (adjusted Fisher-Pearson)."""
    t = tall(df, cols).where(F.col("value").isNotNull())
    n = F.col("n").cast("double")
    return (t.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.skewness("value").alias("g"),
                                      F.stddev_pop("value").alias("sd"))
             .select("variable", "n",
                     F.when((F.col("n") > 2) & (F.col("sd") > 0),
                            F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)).alias("g1")))


# ---------------------------------------------------------------- AGG-12
def frequency_table(df: DataFrame, cols: list[str], top: int = 20) -> DataFrame:
    """``(column_name, rank, category, count, percent)``; nulls are a category.

    Percent is over all rows (before the top-``top`` cut); ties broken by
    value, nulls last.
    """
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, rank int, category string, count bigint, percent double")
    t = (df.select(*[col(c).cast("string").alias(c) for c in cols])
           .unpivot([], [col(c) for c in cols], "column_name", "category"))
    counts = t.groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("column_name").agg(F.sum("count").alias("_total"))
    ranked = top_k_per_group(counts, ["column_name"],
                             [F.col("count").desc(), F.col("category").asc_nulls_last()],
                             top, salt_col="category")
    return (ranked.join(F.broadcast(totals), "column_name")
                  .select("column_name", F.col("rank").cast("int").alias("rank"), "category",
                          F.col("count").cast("long").alias("count"),
                          F.round(F.col("count") / F.col("_total") * 100, 2).alias("percent")))


# ---------------------------------------------------------------- AGG-13
def distinct_table(df: DataFrame, cols: list[str]) -> DataFrame:
    from .roles import distinct_counts
    return distinct_counts(df, cols).select("column_name", F.col("n_distinct").cast("long").alias("n_distinct"))


# ---------------------------------------------------------------- AGG-15
def mode_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, mode, mode_count)``; ties go to the smallest value.

    ``min(struct(-count, value))`` is an algebraic aggregate: partial results
    merge map-side, so a column's distinct values never meet in one task.
    Numeric columns order numerically, others as strings.
    """
    out = []
    num = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC)]
    oth = [c for c in cols if c not in num]
    for group, cast in ((num, "double"), (oth, "string")):
        if not group:
            continue
        t = (df.select(*[col(c).cast(cast).alias(c) for c in group])
               .unpivot([], [col(c) for c in group], "column_name", "v").where(F.col("v").isNotNull()))
        best = (t.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
                 .groupBy("column_name").agg(F.min(F.struct((-F.col("c")).alias("nc"), "v")).alias("m")))
        out.append(best.select("column_name", F.col("m.v").cast("string").alias("mode"),
                               (-F.col("m.nc")).cast("long").alias("mode_count")))
    if not out:
        return df.sparkSession.createDataFrame([], "column_name string, mode string, mode_count bigint")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res

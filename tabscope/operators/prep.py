"""Automatic preprocessing (PRE-1..13) and the model feature frame (CLS-1..3).

Each step is a column projection whose constants (medians, modes,
percentiles, moments) come from one aggregate over a tall frame.  Only
scalars and short level lists (<= 15 per column) reach the driver; the
decisions they drive are recorded in a log DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import col, quoted
from ..functions.quantiles import column_quantiles, tall
from ..session import cut_lineage
from .profile import mode_values, numeric_columns, outlier_counts, skew_bias_corrected

LOG_SCHEMA = "step int, phase string, action string, chosen string, metric string, value double"
ONE_HOT_MAX = 15


def split_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """``select_dtypes(number)`` vs the rest (booleans, strings, dates)."""
    num = numeric_columns(df, include_bool=False)
    return num, [c for c in df.columns if c not in num]


# ---------------------------------------------------------------- PRE-1, 2
def fill_values(df: DataFrame, num_cols: list[str], other_cols: list[str], numeric_modes: bool = True) -> DataFrame:
    """``(column_name, mean, median, mode)`` — candidate fill values per column.

    Mode is the most frequent value (ties to the smallest), as a string.
    """
    spark = df.sparkSession
    parts = []
    if num_cols:
        t = tall(df, num_cols, "column_name", "value")
        mom = t.groupBy("column_name").agg(F.avg("value").alias("mean"))
        med = column_quantiles(df, num_cols, {"median": 0.5}, "column_name").drop("n")
        parts.append(mom.join(med, "column_name", "full"))
    modes = mode_values(df, (num_cols if numeric_modes else []) + other_cols).select("column_name", "mode")
    if parts:
        out = parts[0].join(modes, "column_name", "full")
    else:
        out = modes.select("column_name", F.lit(None).cast("double").alias("mean"),
                           F.lit(None).cast("double").alias("median"), "mode")
    return out if (num_cols or other_cols) else spark.createDataFrame(
        [], "column_name string, mean double, median double, mode string")


def impute(df: DataFrame, num_cols: list[str], other_cols: list[str],
           numeric_strategy: str = "median") -> DataFrame:
    """Fill numeric columns by ``numeric_strategy`` and the rest by their mode."""
    fv = fill_values(df, num_cols, other_cols, numeric_strategy == "mode").collect()  # one row per column
    vals = {r["column_name"]: r for r in fv}
    cols = []
    for c in df.columns:
        r = vals.get(c)
        if r is None:
            cols.append(F.col(c))
        elif c in num_cols:
            # the filled column is floating, as after a fitted imputer
            v = r["mode"] if numeric_strategy == "mode" else r[numeric_strategy]
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")).alias(c))
        else:
            v = r["mode"]
            cols.append(F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)).alias(c)
                        if v is not None else F.col(c))
    return df.select(*cols)


# ---------------------------------------------------------------- PRE-6
def winsorize(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip each column to its own ``lo`` / ``hi`` percentiles (linear)."""
    if not cols:
        return df
    b = column_quantiles(df, cols, {"lo": lo, "hi": hi}).collect()
    bounds = {r["variable"]: (r["lo"], r["hi"]) for r in b}
    out = []
    for c in df.columns:
        if c in bounds and bounds[c][0] is not None:
            a, z = bounds[c]
            out.append(F.when(F.col(c).isNull(), F.col(c))
                        .otherwise(F.least(F.greatest(F.col(c).cast("double"), F.lit(a)), F.lit(z)))
                        .alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- PRE-7..10
def choose_scaler(df: DataFrame, cols: list[str]) -> tuple[str, float]:
    """Robust if max |G1| > 1, standard if > .5, else min-max."""
    if not cols:
        return "none", 0.0
    g = skew_bias_corrected(df, cols).agg(F.max(F.abs("g1"))).first()[0]
    g = float(g) if g is not None else 0.0
    return ("RobustScaler" if g > 1 else "StandardScaler" if g > 0.5 else "MinMaxScaler"), g


def scale(df: DataFrame, cols: list[str], method: str) -> DataFrame:
    """Scale with constants from one aggregate; a zero scale becomes 1 (as sklearn)."""
    if not cols:
        return df
    t = tall(df, cols)
    if method == "RobustScaler":
        s = column_quantiles(df, cols, {"_a": 0.5, "q1": 0.25, "q3": 0.75}) \
            .select("variable", "_a", (F.col("q3") - F.col("q1")).alias("_b"))
    elif method == "StandardScaler":
        s = t.groupBy("variable").agg(F.avg("value").alias("_a"), F.stddev_pop("value").alias("_b"))
    elif method == "MinMaxScaler":
        s = t.groupBy("variable").agg(F.min("value").alias("_a"),
                                      (F.max("value") - F.min("value")).alias("_b"))
    else:
        raise ValueError(method)
    consts = {r["variable"]: (r["_a"], r["_b"]) for r in s.collect()}  # one row per column
    out = []
    for c in df.columns:
        if c in consts and consts[c][0] is not None:
            a, b = consts[c]
            b = 1.0 if (b is None or b == 0) else b
            out.append(((F.col(c).cast("double") - F.lit(a)) / F.lit(b)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def standardize_pop(df: DataFrame, cols: list[str]) -> DataFrame:
    """CLS-3 / PRE-9: (x - mean) / population std, zero std -> 1."""
    return scale(df, cols, "StandardScaler")


# ---------------------------------------------------------------- PRE-11, 12
def level_lists(df: DataFrame, cols: list[str], cap: int | None = ONE_HOT_MAX) -> dict[str, list | int]:
    """Sorted non-null levels for columns with at most ``cap`` of them; else the count.

    One tall distinct pass; a column with more levels only reports its count.  Without a ``cap``
    every level is listed: a model with a coefficient per level has them on the driver anyway.
    """
    if not cols:
        return {}
    t = (df.select(*[col(c).cast("string").alias(c) for c in cols])
           .unpivot([], [col(c) for c in cols], "column_name", "v").where(F.col("v").isNotNull()).distinct())
    if cap is None:
        levels: dict[str, list | int] = {c: [] for c in cols}
        for r in t.collect():
            levels[r["column_name"]].append(r["v"])
        return {c: sorted(lv) for c, lv in levels.items()}
    counts = {r["column_name"]: int(r["n"]) for r in
              t.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict[str, list | int] = {c: [] for c in cols}
    small = [c for c, n in counts.items() if n <= cap]
    for c, n in counts.items():
        if n > cap:
            out[c] = n
    if small:
        g = (t.where(F.col("column_name").isin(small)).groupBy("column_name")
              .agg(F.sort_array(F.collect_list("v")).alias("lv")))  # <= cap values each
        for r in g.collect():
            out[r["column_name"]] = list(r["lv"])
    return out


def one_hot_columns(col: str, levels: list[str], drop_first: bool = True) -> list:
    """``col_value`` 0/1 columns for the sorted levels, first one dropped."""
    keep = levels[1:] if drop_first else levels
    s = F.col(col).cast("string")
    return [F.when(s == F.lit(v), 1).otherwise(0).cast("int").alias(f"{col}_{v}") for v in keep]


def label_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """PRE-12: code = position of the value in sorted order; missing -> -1.

    Codes come from a sorted, range-partitioned distinct list (``dense_rank``
    over distinct values, computed by partition offsets), joined back.
    """
    from ..functions.frames import dense_codes
    out = out or col
    codes = dense_codes(df.select(F.col(col).cast("string").alias("_v")), "_v")
    # rows without a value match no code; they are spread over the tasks of the join
    value = F.col(col).cast("string")
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string")
    rows = df.withColumns({"_v": F.coalesce(value, spread), "_null": value.isNull()})
    j = rows.join(codes.withColumn("_null", F.lit(False)), ["_v", "_null"], "left")
    cols = [F.coalesce(F.col("_code"), F.lit(-1)).cast("long").alias(out) if c == col else F.col(c)
            for c in df.columns]
    if out != col:
        cols.append(F.coalesce(F.col("_code"), F.lit(-1)).cast("long").alias(out))
    return j.select(*cols)


def encode_categoricals(df: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """1 level: kept; 2..15: one-hot (drop first); more: label codes."""
    lv = level_lists(df, cols)
    encoded = 0
    sel = []
    coded = []
    for c in df.columns:
        if c not in lv:
            sel.append(F.col(c))
            continue
        levels = lv[c]
        if isinstance(levels, list) and len(levels) <= 1:
            sel.append(F.col(c))
        elif isinstance(levels, list):
            sel.extend(one_hot_columns(c, levels))
            encoded += 1
        else:
            sel.append(F.col(c))
            coded.append(c)
            encoded += 1
    out = df.select(*sel)
    for c in coded:
        out = label_codes(out, c)
    return out, encoded


# ---------------------------------------------------------------- PRE-13 (whole pipeline)
def auto_preprocess(df: DataFrame, contamination: float = 0.05, forest_trees: int = 100,
                    max_cols: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Impute (median / mode), winsorise if outliers >= 1 %, scale by skew, encode.

    The outlier tests and the winsorising look at all numeric columns (the first ``max_cols``, if given).  Returns ``(data, log)``; the log has one row per decision metric.
    """
    spark = df.sparkSession
    num, other = split_kinds(df)
    # The reference's names of phases, actions and choices in the log
    log = []
    n_rows = df.count()
    miss = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]).first()
    total_missing = int(sum((miss[c] or 0) for c in df.columns))
    cols_filled = int(sum(1 for c in df.columns if (miss[c] or 0) > 0))
    if total_missing == 0:
        log.append((1, "Missing Values", "skipped", None, "total_missing", 0.0))
        data = df
    else:
        for strat in ("Mean", "Median", "Mode"):
            log.append((1, "Missing Values", "tested", strat, "values_imputed", float(total_missing)))
        log.append((1, "Missing Values", "applied", "Median", "cols_filled", float(cols_filled)))
        data = cut_lineage(impute(df, num, other, "median"))

    if not num:
        log.append((2, "Outlier Handling", "skipped", None, "numeric_columns", 0.0))
    else:
        tested = num[:max_cols]
        oc = {r["column_name"]: int(r["outliers"]) for r in outlier_counts(data, tested).collect()}
        iqr_total = sum(oc.values())
        log.append((2, "Outlier Handling", "tested", "IQR", "total", float(iqr_total)))
        forest_total = 0
        if n_rows > 10:
            from .isoforest import isolation_forest_outliers
            forest_total = isolation_forest_outliers(data, tested, contamination=contamination,
                                                     n_trees=forest_trees)
            log.append((2, "Outlier Handling", "tested", "IsolationForest", "total", float(forest_total)))
        detected = max(iqr_total, forest_total)
        if detected < n_rows * 0.01:
            log.append((2, "Outlier Handling", "skipped", None, "detected", float(detected)))
        else:
            data = winsorize(data, [c for c in tested if oc.get(c, 0) > 0])
            log.append((2, "Outlier Handling", "applied", "Winsorization (1st-99th percentile)",
                        "detected", float(detected)))
        chosen, g = choose_scaler(data, num)
        data = scale(data, num, chosen)
        log.append((3, "Scaling", "applied", chosen, "max_abs_skew", float(g)))

    if not other:
        log.append((4, "Categorical Encoding", "skipped", None, "encoded", 0.0))
    else:
        data, enc = encode_categoricals(data, other)
        log.append((4, "Categorical Encoding", "applied", "One-hot (<=15 categories) + Label encoding (>15)",
                    "encoded", float(enc)))
    return data, spark.createDataFrame(log, LOG_SCHEMA)


# ---------------------------------------------------------------- CLS-1, 2
def feature_frame(df: DataFrame, target: str, numeric_cols: list[str], other_cols: list[str],
                  standardize: bool = False, max_levels: int | None = None,
                  keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Model input: numeric medians filled (over all rows), other columns one-hot
    (drop first; every level, or no column beyond ``max_levels`` if given), target non-null, constant features dropped."""
    keep = keep or []
    feats = [c for c in numeric_cols if c != target and c not in keep]
    cats = [c for c in other_cols if c != target and c not in keep]
    med = {}
    if feats:
        q = column_quantiles(df, feats, {"m": 0.5}).collect()
        med = {r["variable"]: r["m"] for r in q}
    lv = level_lists(df, cats, max_levels)
    sel = [F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double"), F.lit(0.0)).alias(c)
           for c in feats]
    for c in cats:
        if isinstance(lv.get(c), list) and len(lv[c]) > 1:
            sel.extend(one_hot_columns(c, lv[c]))
    x = df.where(F.col(target).isNotNull()).select(*keep, F.col(target), *sel)
    names = [c for c in x.columns if c != target and c not in keep]
    if names:
        r = x.agg(*[(F.min(c) != F.max(c)).alias(c) for c in names]).first()
        names = [c for c in names if r[c]]
    x = x.select(*keep, target, *[F.col(c).cast("double").alias(c) for c in names])
    if standardize:
        x = standardize_pop(x, names)
    return x, names


def encode_labels(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, list[str]]:
    """CLS-2: sorted string order of the target -> 0, 1, ..., with no limit on the classes."""
    lv = level_lists(df, [target], cap=None)[target]
    codes = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(lv)], f"_level string, {quoted(out)} double")
    return df.join(codes, col(target).cast("string") == F.col("_level"), "left").drop("_level"), lv

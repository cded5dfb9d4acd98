"""Hypothesis tests with effect sizes (HYP-1..10).

Every test reduces to group moments: one tall pass
``(variable, grouping, level, x)`` -> ``groupBy(...).agg(count, avg, var_samp)``
whose partial aggregation runs map-side, so the shuffle carries one row per
(column pair, level) and per task, whatever the table size.  Statistics are
then column expressions over that small moments table; p-values are the only
Python step and touch result rows only.

Group order is sorted by level (``group1 < group2``); the sign of t and d
follows that order.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_pvalue, f_pvalue, t_pvalue
from ..functions.frames import col
from ..functions.quantiles import running_sums
from .roles import distinct_counts

MIN_GROUP = 3

TTEST_SCHEMA = ("test string, variable string, grouping string, group1 string, group2 string, "
                "n1 bigint, n2 bigint, mean1 double, mean2 double, t_stat double, df double, "
                "cohens_d double, effect_size string")
ANOVA_SCHEMA = ("test string, variable string, grouping string, groups bigint, n bigint, "
                "f_stat double, df1 bigint, df2 bigint, eta_squared double, effect_size string")
CHI_SCHEMA = ("test string, variable1 string, variable2 string, n bigint, n_rows bigint, "
              "n_cols bigint, chi2 double, df bigint, yates boolean, cramers_v double, "
              "effect_size string")


# ---------------------------------------------------------------- HYP-8
def effect_label(kind: str, value):
    """Magnitude label of an effect size (thresholds fixed by the reference)."""
    # Label thresholds per effect kind.
    edges = {"cohens_d": (0.2, 0.5, 0.8), "eta_squared": (0.01, 0.06, 0.14),
             "cramers_v": (0.1, 0.3, 0.5)}[kind]
    v = F.abs(value) if kind == "cohens_d" else value
    return (F.when(v < edges[0], "Negligible").when(v < edges[1], "Small")
             .when(v < edges[2], "Medium").otherwise("Large"))


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def group_moments(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """``(variable, grouping, level, n, mean, var)`` for every numeric x categorical pair.

    Rows with a null on either side of a pair drop out of that pair only.
    """
    pairs = [(v, g) for g in cat_cols for v in num_cols if v != g]
    stack = F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(g).alias("grouping"),
                 F.col(g).cast("string").alias("level"), F.col(v).cast("double").alias("x"))
        for v, g in pairs]))
    t = (df.select(stack.alias("s")).select("s.*")
           .where(F.col("level").isNotNull() & F.col("x").isNotNull()))
    return t.groupBy("variable", "grouping", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def _levels(df: DataFrame, cat_cols: list[str]) -> DataFrame:
    return distinct_counts(df, cat_cols).withColumnRenamed("column_name", "grouping")


# ---------------------------------------------------------------- HYP-1, 2
def ttests_from_moments(m: DataFrame) -> DataFrame:
    """Welch t and Cohen's d for (variable, grouping) with two groups of n >= 3."""
    m = m.where(F.col("n") >= MIN_GROUP)
    g = (m.groupBy("variable", "grouping")
          .agg(F.count(F.lit(1)).alias("_k"),
               F.min(F.struct("level", "n", "mean", "var")).alias("a"),
               F.max(F.struct("level", "n", "mean", "var")).alias("b"))
          .where(F.col("_k") == 2))
    n1, n2 = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    v1, v2 = F.col("a.var"), F.col("b.var")
    se1, se2 = v1 / n1, v2 / n2
    # zero variance in both groups: t and df are undefined (null), not an error
    t = F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(se1 + se2))
    dfw = F.try_divide(F.pow(se1 + se2, 2), F.pow(se1, 2) / (n1 - 1) + F.pow(se2, 2) / (n2 - 1))
    sp = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    d = F.when(sp == 0, F.lit(0.0)).otherwise((F.col("a.mean") - F.col("b.mean")) / sp)
    return g.select(F.lit("Independent t-test").alias("test"), "variable", "grouping",
                    F.col("a.level").alias("group1"), F.col("b.level").alias("group2"),
                    F.col("a.n").cast("long").alias("n1"), F.col("b.n").cast("long").alias("n2"),
                    F.col("a.mean").alias("mean1"), F.col("b.mean").alias("mean2"),
                    t.alias("t_stat"), dfw.alias("df"), d.alias("cohens_d"),
                    effect_label("cohens_d", d).alias("effect_size"))


def ttests(df: DataFrame, num_cols: list[str], cat_cols: list[str],
           p_values: bool = True) -> DataFrame:
    """HYP-1: categorical columns with exactly 2 distinct levels (whole column)."""
    lv = _levels(df, cat_cols).where(F.col("n_distinct") == 2)
    two = [r["grouping"] for r in lv.collect()]  # at most len(cat_cols) names
    if not two or not num_cols:
        return _with_p(_empty(df, TTEST_SCHEMA), "t", p_values)
    out = ttests_from_moments(group_moments(df, num_cols, two))
    return _with_p(out, "t", p_values)


# ---------------------------------------------------------------- HYP-3, 4
def anova_from_moments(m: DataFrame) -> DataFrame:
    """One-way F and eta-squared over the groups with n >= 3 (at least 2 groups)."""
    m = m.where(F.col("n") >= MIN_GROUP)
    w = Window.partitionBy("variable", "grouping")
    m = (m.withColumn("_N", F.sum("n").over(w))
          .withColumn("_k", F.count(F.lit(1)).over(w))
          .withColumn("_grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("_N")))
    a = (m.where(F.col("_k") >= 2).groupBy("variable", "grouping")
          .agg(F.first("_k").alias("k"), F.first("_N").alias("N"),
               F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).alias("ssb"),
               F.sum((F.col("n") - 1) * F.col("var")).alias("ssw")))
    df1 = F.col("k") - 1
    df2 = F.col("N") - F.col("k")
    f = F.try_divide(F.col("ssb") / df1, F.col("ssw") / df2)
    eta = F.when(df2 == 0, F.lit(0.0)).otherwise(F.try_divide(f * df1, f * df1 + df2))
    return a.select(F.lit("One-way ANOVA").alias("test"), "variable", "grouping",
                    F.col("k").cast("long").alias("groups"), F.col("N").cast("long").alias("n"),
                    f.alias("f_stat"), df1.cast("long").alias("df1"), df2.cast("long").alias("df2"),
                    eta.alias("eta_squared"), effect_label("eta_squared", eta).alias("effect_size"))


def anovas(df: DataFrame, num_cols: list[str], cat_cols: list[str],
           p_values: bool = True, max_levels: int = 20) -> DataFrame:
    """HYP-3: categorical columns with 3..``max_levels`` distinct levels."""
    lv = _levels(df, cat_cols).where(F.col("n_distinct").between(3, max_levels))
    many = [r["grouping"] for r in lv.collect()]
    if not many or not num_cols:
        return _with_p(_empty(df, ANOVA_SCHEMA), "f", p_values)
    return _with_p(anova_from_moments(group_moments(df, num_cols, many)), "f", p_values)


# ---------------------------------------------------------------- HYP-5..7
def contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """HYP-6, tall: ``(pair, variable1, variable2, a, b, count)``; rows with a null drop out."""
    stack = F.explode(F.array(*[
        F.struct(F.lit(k).alias("pair"), F.lit(x).alias("variable1"), F.lit(y).alias("variable2"),
                 F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b"))
        for k, (x, y) in enumerate(pairs)]))
    t = (df.select(stack.alias("s")).select("s.*")
           .where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    return t.groupBy("pair", "variable1", "variable2", "a", "b").agg(F.count(F.lit(1)).alias("count"))


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """HYP-6, wide: rows = levels of ``x``, one column per level of ``y``."""
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
              .groupBy(F.col(x).cast("string").alias(x)).pivot(y).count().na.fill(0))


def crosstab_cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """HYP-6 for any number of levels: ``(row, col, row_code, col_code, count)`` of the cells that are not empty.

    Codes are the levels' places in sorted order, numbered over range partitions; neither the
    levels nor the table's width reach the driver or the plan.
    """
    cells = (df.select(col(x).cast("string").alias("row"), col(y).cast("string").alias("col")).na.drop()
               .groupBy("row", "col").agg(F.count(F.lit(1)).alias("count")))
    for name in ("row", "col"):
        levels = cells.select(name).distinct().withColumn("_one", F.lit(1).cast("long"))
        codes = running_sums(levels, [], name, ["_one"]).select(name, F.col("cum__one").alias(f"{name}_code"))
        cells = cells.join(codes, name)
    return cells.select("row", "col", "row_code", "col_code", "count")


def chi_square_from_counts(cells: DataFrame) -> DataFrame:
    """Chi-square of independence per pair, Yates-corrected when df = 1.

    Without correction the statistic is ``sum(O^2 / E) - n`` over the non-zero
    cells (zero cells add ``E`` and cancel), so no grid of empty cells is
    built.  A df = 1 table is 2 x 2: its four cells come from joining the two
    row levels with the two column levels of the pair.
    """
    key = ["pair", "variable1", "variable2"]
    rows = cells.groupBy(*key, "a").agg(F.sum("count").alias("ra"))
    cols = cells.groupBy(*key, "b").agg(F.sum("count").alias("cb"))
    shape = (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("n"))
                 .join(cols.groupBy(*key).agg(F.count(F.lit(1)).alias("c")), key)
                 .where((F.col("r") >= 2) & (F.col("c") >= 2)))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    shape = shape.withColumn("dof", dof)
    e = F.col("ra") * F.col("cb") / F.col("n")
    plain = (cells.join(shape.where(F.col("dof") > 1), key)
                  .join(rows, key + ["a"]).join(cols, key + ["b"])
                  .groupBy(*key).agg(F.sum(F.col("count") * F.col("count") / e).alias("_s"),
                                     F.first("n").alias("_n"))
                  .select(*key, (F.col("_s") - F.col("_n")).alias("chi2")))
    s1 = shape.where(F.col("dof") == 1).select(*key, "n")
    grid = (rows.join(s1, key).join(cols, key)
                .join(cells, key + ["a", "b"], "left")
                .select(*key, "n", "ra", "cb", F.coalesce(F.col("count"), F.lit(0)).alias("count")))
    diff = F.abs(F.col("count") - e)
    yates = (grid.groupBy(*key)
                 .agg(F.sum(F.pow(diff - F.least(F.lit(0.5), diff), 2) / e).alias("chi2")))
    chi = plain.unionByName(yates)
    out = shape.join(chi, key)
    v = F.when(F.least("r", "c") <= 1, F.lit(0.0)) \
         .otherwise(F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1))))
    return out.select(F.lit("Chi-square").alias("test"), "variable1", "variable2",
                      F.col("n").cast("long").alias("n"), F.col("r").cast("long").alias("n_rows"),
                      F.col("c").cast("long").alias("n_cols"), "chi2",
                      F.col("dof").cast("long").alias("df"), (F.col("dof") == 1).alias("yates"),
                      v.alias("cramers_v"), effect_label("cramers_v", v).alias("effect_size"))


def chi_squares(df: DataFrame, cat_cols: list[str], first: int | None = None,
                p_values: bool = True) -> DataFrame:
    """HYP-5: every pair of categorical columns (of the first ``first``, if given)."""
    pairs = list(combinations(cat_cols[:first], 2))
    if not pairs:
        return _with_p(_empty(df, CHI_SCHEMA), "chi", p_values)
    return _with_p(chi_square_from_counts(contingency(df, pairs)), "chi", p_values)


# ---------------------------------------------------------------- HYP-10
def _with_p(df: DataFrame, kind: str, on: bool) -> DataFrame:
    if not on:
        return df
    if kind == "t":
        p = t_pvalue(F.col("t_stat"), F.col("df"))
    elif kind == "f":
        p = f_pvalue(F.col("f_stat"), F.col("df1"), F.col("df2"))
    else:
        p = chi2_pvalue(F.col("chi2"), F.col("df"))
    return df.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


# ---------------------------------------------------------------- HYP-9
BATTERY_SCHEMA = ("test string, name string, variable string, grouping string, statistic double, "
                  "df double, effect_type string, effect double, effect_size string")


def battery_tests(df: DataFrame, num_cols: list[str], cat_cols: list[str],
                  p_values: bool = True) -> DataFrame:
    """All t-tests, ANOVAs and chi-square tests of a table in one tall frame.

    Effects are rounded to 4 decimals (as reported) before ranking.
    """
    tt = ttests(df, num_cols, cat_cols, p_values)
    an = anovas(df, num_cols, cat_cols, p_values)
    ch = chi_squares(df, cat_cols, p_values=p_values)
    extra = ["p_value", "significant"] if p_values else []
    parts = [
        tt.select("test", F.concat_ws("", "variable", F.lit(" vs "), "group1", F.lit("/"), "group2").alias("name"),
                  "variable", "grouping", F.col("t_stat").alias("statistic"), F.col("df").cast("double").alias("df"),
                  F.lit("cohens_d").alias("effect_type"), F.round("cohens_d", 4).alias("effect"),
                  "effect_size", *extra, F.lit(0).alias("_o")),
        an.select("test", F.concat_ws("", "variable", F.lit(" by "), "grouping").alias("name"),
                  "variable", "grouping", F.col("f_stat").alias("statistic"), F.col("df1").cast("double").alias("df"),
                  F.lit("eta_squared").alias("effect_type"), F.round("eta_squared", 4).alias("effect"),
                  "effect_size", *extra, F.lit(1).alias("_o")),
        ch.select("test", F.concat_ws("", "variable1", F.lit(" x "), "variable2").alias("name"),
                  F.col("variable1").alias("variable"), F.col("variable2").alias("grouping"),
                  F.col("chi2").alias("statistic"), F.col("df").cast("double").alias("df"),
                  F.lit("cramers_v").alias("effect_type"), F.round("cramers_v", 4).alias("effect"),
                  "effect_size", *extra, F.lit(2).alias("_o")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out


def top_effects(battery: DataFrame, k: int = 5) -> DataFrame:
    """``(rank, name, effect)``: the ``k`` largest effects by absolute size."""
    w = Window.orderBy(F.abs("effect").desc(), "_o", "name")
    return (battery.select("name", F.abs("effect").alias("effect"), "_o")
                   .orderBy(F.col("effect").desc(), "_o", "name").limit(k)
                   .withColumn("rank", F.row_number().over(w).cast("long"))
                   .select("rank", "name", "effect"))


def battery_summary(battery: DataFrame) -> DataFrame:
    """``(total_tests, significant_count)``."""
    return battery.agg(F.count(F.lit(1)).cast("long").alias("total_tests"),
                       F.sum(F.col("significant").cast("long")).cast("long").alias("significant_count"))


def hypothesis_tests(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> dict[str, DataFrame]:
    """The full battery: the three test tables, the union, a summary and top effects."""
    b = battery_tests(df, num_cols, cat_cols, True)
    return {"t_tests": ttests(df, num_cols, cat_cols), "anovas": anovas(df, num_cols, cat_cols),
            "chi_squares": chi_squares(df, cat_cols), "battery": b.drop("_o"),
            "summary": battery_summary(b), "top_effects": top_effects(b)}

"""Registered queries: hypothesis tests (HYP-1..10)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.frames import r4 as fr4
from ..operators import hypothesis as H
from .profile_queries import LI_NUM, LINEITEM_NULLS_SQL, ORDERS_NULLS_SQL, lineitem_nulls, orders_nulls
from .registry import register, t
from .sqlgen import r4

LI_CAT = ["l_returnflag", "l_linestatus"]


def _group_tall_sql(src, nums, cats):
    return "\nUNION ALL\n".join(
        f"SELECT '{v}' AS variable, '{g}' AS grouping, CAST({g} AS VARCHAR) AS level, "
        f"CAST({v} AS DOUBLE) AS x FROM {src}" for g in cats for v in nums)


def _moments_sql(src, nums, cats, levels_sql):
    return f"""
WITH t AS (SELECT * FROM ({_group_tall_sql(src, nums, cats)}) WHERE level IS NOT NULL AND x IS NOT NULL),
lv AS ({levels_sql}),
m AS (SELECT variable, grouping, level, COUNT(*) AS n, AVG(x) AS mean, VAR_SAMP(x) AS var
      FROM t WHERE grouping IN (SELECT grouping FROM lv) GROUP BY ALL HAVING COUNT(*) >= 3)"""


def _levels_sql(src, cats, lo, hi):
    return "\nUNION ALL\n".join(
        f"SELECT '{g}' AS grouping FROM {src} HAVING COUNT(DISTINCT {g}) BETWEEN {lo} AND {hi}" for g in cats)


def _ttest_sql(src, nums, cats):
    return _moments_sql(src, nums, cats, _levels_sql(src, cats, 2, 2)) + f""",
k AS (SELECT variable, grouping FROM m GROUP BY ALL HAVING COUNT(*) = 2),
p AS (SELECT a.variable, a.grouping, a.level AS group1, b.level AS group2, a.n AS n1, b.n AS n2,
             a.mean AS m1, b.mean AS m2, a.var AS v1, b.var AS v2
      FROM m a JOIN m b ON a.variable = b.variable AND a.grouping = b.grouping AND a.level < b.level
      JOIN k ON k.variable = a.variable AND k.grouping = a.grouping),
s AS (SELECT *, (m1 - m2) / SQRT(v1 / n1 + v2 / n2) AS t,
             POWER(v1 / n1 + v2 / n2, 2) / (POWER(v1 / n1, 2) / (n1 - 1) + POWER(v2 / n2, 2) / (n2 - 1)) AS dfw,
             SQRT(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sp FROM p),
d AS (SELECT *, CASE WHEN sp = 0 THEN 0.0 ELSE (m1 - m2) / sp END AS d FROM s)
SELECT 'Independent t-test' AS test, variable, grouping, group1, group2, CAST(n1 AS BIGINT) AS n1,
       CAST(n2 AS BIGINT) AS n2, {r4('m1')} AS mean1, {r4('m2')} AS mean2, {r4('t')} AS t_stat,
       {r4('dfw')} AS df, {r4('d')} AS cohens_d,
       CASE WHEN ABS(d) < 0.2 THEN 'Negligible' WHEN ABS(d) < 0.5 THEN 'Small'
            WHEN ABS(d) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect_size
FROM d"""


def _round_t(df):
    return df.select("test", "variable", "grouping", "group1", "group2", "n1", "n2",
                     fr4("mean1").alias("mean1"), fr4("mean2").alias("mean2"),
                     fr4("t_stat").alias("t_stat"), fr4("df").alias("df"),
                     fr4("cohens_d").alias("cohens_d"), "effect_size")


@register("ttest_lineitem", "HYP-1 HYP-2 HYP-8 FLT-3", _ttest_sql(LINEITEM_NULLS_SQL, LI_NUM, LI_CAT))
def ttest_lineitem(spark, sf):
    return _round_t(H.ttests(lineitem_nulls(spark, sf), LI_NUM, LI_CAT, p_values=False))


def _anova_sql(src, nums, cats):
    return _moments_sql(src, nums, cats, _levels_sql(src, cats, 3, 20)) + f""",
g AS (SELECT *, SUM(n) OVER w AS nn, COUNT(*) OVER w AS k,
             SUM(n * mean) OVER w / SUM(n) OVER w AS grand
      FROM m WINDOW w AS (PARTITION BY variable, grouping)),
a AS (SELECT variable, grouping, ANY_VALUE(k) AS k, ANY_VALUE(nn) AS nn,
             SUM(n * POWER(mean - grand, 2)) AS ssb, SUM((n - 1) * var) AS ssw
      FROM g WHERE k >= 2 GROUP BY ALL),
f AS (SELECT *, (ssb / (k - 1)) / (ssw / (nn - k)) AS f FROM a),
e AS (SELECT *, f * (k - 1) / (f * (k - 1) + (nn - k)) AS eta FROM f)
SELECT 'One-way ANOVA' AS test, variable, grouping, CAST(k AS BIGINT) AS groups, CAST(nn AS BIGINT) AS n,
       {r4('f')} AS f_stat, CAST(k - 1 AS BIGINT) AS df1, CAST(nn - k AS BIGINT) AS df2,
       {r4('eta')} AS eta_squared,
       CASE WHEN eta < 0.01 THEN 'Negligible' WHEN eta < 0.06 THEN 'Small'
            WHEN eta < 0.14 THEN 'Medium' ELSE 'Large' END AS effect_size
FROM e"""


def _round_a(df):
    return df.select("test", "variable", "grouping", "groups", "n", fr4("f_stat").alias("f_stat"),
                     "df1", "df2", fr4("eta_squared").alias("eta_squared"), "effect_size")


@register("anova_lineitem", "HYP-3 HYP-4 HYP-8", _anova_sql(LINEITEM_NULLS_SQL, LI_NUM, LI_CAT))
def anova_lineitem(spark, sf):
    return _round_a(H.anovas(lineitem_nulls(spark, sf), LI_NUM, LI_CAT, p_values=False))


@register("anova_events", "HYP-3 HYP-4", _anova_sql("events", ["value", "user_id"], ["event_type", "props"]))
def anova_events(spark, sf):
    return _round_a(H.anovas(t(spark, sf, "events"), ["value", "user_id"], ["event_type", "props"],
                             p_values=False))


@register("anova_documents", "HYP-3 HYP-4", _anova_sql("documents", ["n_chars"], ["lang", "source"]))
def anova_documents(spark, sf):
    return _round_a(H.anovas(t(spark, sf, "documents"), ["n_chars"], ["lang", "source"], p_values=False))


def _chi_sql(src, pairs):
    parts = []
    for x, y in pairs:
        parts.append(f"""
(WITH d AS (SELECT CAST({x} AS VARCHAR) AS a, CAST({y} AS VARCHAR) AS b FROM {src}
            WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
o AS (SELECT a, b, COUNT(*) AS o FROM d GROUP BY ALL),
ra AS (SELECT a, COUNT(*) AS ra FROM d GROUP BY a), cb AS (SELECT b, COUNT(*) AS cb FROM d GROUP BY b),
sh AS (SELECT (SELECT COUNT(*) FROM ra) AS r, (SELECT COUNT(*) FROM cb) AS c, (SELECT COUNT(*) FROM d) AS n),
g AS (SELECT ra.a, cb.b, ra.ra * cb.cb * 1.0 / sh.n AS e, COALESCE(o.o, 0) AS o, sh.r, sh.c, sh.n
      FROM ra CROSS JOIN cb CROSS JOIN sh LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
s AS (SELECT ANY_VALUE(r) AS r, ANY_VALUE(c) AS c, ANY_VALUE(n) AS n,
             SUM(CASE WHEN (r - 1) * (c - 1) = 1
                      THEN POWER(ABS(o - e) - LEAST(0.5, ABS(o - e)), 2) / e
                      ELSE POWER(o - e, 2) / e END) AS chi2 FROM g),
v AS (SELECT *, SQRT(chi2 / (n * (LEAST(r, c) - 1))) AS v FROM s WHERE r >= 2 AND c >= 2)
SELECT 'Chi-square' AS test, '{x}' AS variable1, '{y}' AS variable2, CAST(n AS BIGINT) AS n,
       CAST(r AS BIGINT) AS n_rows, CAST(c AS BIGINT) AS n_cols, {r4('chi2')} AS chi2,
       CAST((r - 1) * (c - 1) AS BIGINT) AS df, (r - 1) * (c - 1) = 1 AS yates, {r4('v')} AS cramers_v,
       CASE WHEN v < 0.1 THEN 'Negligible' WHEN v < 0.3 THEN 'Small' WHEN v < 0.5 THEN 'Medium'
            ELSE 'Large' END AS effect_size FROM v)""")
    return "\nUNION ALL\n".join(parts)


def _round_c(df):
    return df.select("test", "variable1", "variable2", "n", "n_rows", "n_cols", fr4("chi2").alias("chi2"),
                     "df", "yates", fr4("cramers_v").alias("cramers_v"), "effect_size")


@register("chi_square_orders_nulls", "HYP-5 HYP-6 HYP-7 HYP-8",
          _chi_sql(ORDERS_NULLS_SQL, [("o_orderstatus", "o_orderpriority")]))
def chi_square_orders_nulls(spark, sf):
    return _round_c(H.chi_squares(orders_nulls(spark, sf), ["o_orderstatus", "o_orderpriority"],
                                  p_values=False))


LI_FLAGS_SQL = ("(SELECT l_returnflag, l_linestatus, "
                "CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS l_size, "
                "CASE WHEN l_discount >= 0.09 THEN 'deep' ELSE 'shallow' END AS l_disc FROM lineitem)")


def lineitem_flags(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_returnflag", "l_linestatus",
                     F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("l_size"),
                     F.when(F.col("l_discount") >= 0.09, "deep").otherwise("shallow").alias("l_disc"))


_LI_FLAG_COLS = ["l_returnflag", "l_linestatus", "l_size", "l_disc"]


@register("chi_square_lineitem_flags", "HYP-5 HYP-7",
          _chi_sql(LI_FLAGS_SQL, list(combinations(_LI_FLAG_COLS, 2))))
def chi_square_lineitem_flags(spark, sf):
    return _round_c(H.chi_squares(lineitem_flags(spark, sf), _LI_FLAG_COLS, p_values=False))


@register("crosstab_orders", "HYP-6", """
SELECT CAST(o_orderstatus AS VARCHAR) AS o_orderstatus,
       CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS "1-URGENT",
       CAST(SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS "2-HIGH",
       CAST(SUM(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS "3-MEDIUM",
       CAST(SUM(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS BIGINT) AS "4-NOT SPECIFIED",
       CAST(SUM(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS "5-LOW"
FROM orders GROUP BY o_orderstatus""")
def crosstab_orders(spark, sf):
    ct = H.crosstab(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return ct.select(*[F.col(c).cast("long").alias(c) if c != "o_orderstatus" else F.col(c)
                       for c in ct.columns])


# p-values have no SQL oracle: rows-only, plus literature values in tests/.
@register("hypothesis_pvalues_lineitem", "HYP-9 HYP-10")
def hypothesis_pvalues_lineitem(spark, sf):
    b = H.battery_tests(lineitem_nulls(spark, sf), LI_NUM, LI_CAT, p_values=True)
    return b.select("test", "name", fr4("statistic").alias("statistic"), fr4("df").alias("df"),
                    fr4("p_value").alias("p_value"), "significant")


def _top_effects_sql(src, nums, cats, k=5):
    tt = _ttest_sql(src, nums, cats)
    an = _anova_sql(src, nums, cats)
    pairs = list(combinations(cats[:4], 2))
    ch = _chi_sql(src, pairs) if pairs else None
    parts = [f"SELECT variable || ' vs ' || group1 || '/' || group2 AS name, ABS(cohens_d) AS effect, 0 AS o FROM ({tt})",
             f"SELECT variable || ' by ' || grouping AS name, eta_squared AS effect, 1 AS o FROM ({an})"]
    if ch:
        parts.append(f"SELECT variable1 || ' x ' || variable2 AS name, cramers_v AS effect, 2 AS o FROM ({ch})")
    u = "\nUNION ALL\n".join(parts)
    return f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY effect DESC, o, name) AS BIGINT) AS rank, name, effect
FROM ({u}) QUALIFY rank <= {k}"""


@register("hypothesis_top_effects_lineitem", "HYP-9",
          _top_effects_sql(LINEITEM_NULLS_SQL, LI_NUM, LI_CAT))
def hypothesis_top_effects_lineitem(spark, sf):
    b = H.battery_tests(lineitem_nulls(spark, sf), LI_NUM, LI_CAT, p_values=False)
    return H.top_effects(b).select("rank", "name", fr4("effect").alias("effect"))


@register("hypothesis_top_effects_orders", "HYP-9",
          _top_effects_sql(ORDERS_NULLS_SQL, ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]))
def hypothesis_top_effects_orders(spark, sf):
    b = H.battery_tests(orders_nulls(spark, sf), ["o_totalprice", "o_custkey"],
                        ["o_orderstatus", "o_orderpriority"], p_values=False)
    return H.top_effects(b).select("rank", "name", fr4("effect").alias("effect"))


@register("hypothesis_summary_orders", "HYP-9 HYP-10")
def hypothesis_summary_orders(spark, sf):
    b = H.battery_tests(orders_nulls(spark, sf), ["o_totalprice", "o_custkey"],
                        ["o_orderstatus", "o_orderpriority"], p_values=True)
    return H.battery_summary(b)


@register("crosstab_cells_orders", "HYP-6", """
WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS "row", o_orderpriority AS col, COUNT(*) AS count FROM orders GROUP BY ALL)
SELECT "row", col, DENSE_RANK() OVER (ORDER BY "row") - 1 AS row_code, DENSE_RANK() OVER (ORDER BY col) - 1 AS col_code, count FROM c""")
def crosstab_cells_orders(spark, sf):
    """A table with a row for each customer."""
    return H.crosstab_cells(t(spark, sf, "orders"), "o_custkey", "o_orderpriority")

"""Registered queries: chart data and correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.frames import r4 as fr4
from ..functions.normal import norm_ppf_sql
from ..operators import charts as C
from ..operators import correlation as K
from .profile_queries import LI_NUM, LINEITEM_NULLS_SQL, ORDERS_NULLS_SQL, lineitem_nulls, orders_nulls
from .registry import register, t
from .sqlgen import r4, tall_sql



def _hist_sql(src, cols, bins=30):
    w = f"((hi - lo) / {bins})"
    return f"""
WITH t AS (SELECT * FROM ({tall_sql(src, cols)}) WHERE value IS NOT NULL),
b AS (SELECT variable, CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
             CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi
      FROM t GROUP BY variable),
g AS (SELECT variable, lo, hi, UNNEST(range(0, {bins})) AS bin FROM b),
c AS (SELECT variable, CAST(LEAST(FLOOR((value - lo) / {w}), {bins - 1}) AS BIGINT) AS bin, COUNT(*) AS cnt
      FROM t JOIN b USING (variable) GROUP BY ALL)
SELECT g.variable, CAST(g.bin AS BIGINT) AS bin, {r4(f'lo + g.bin * {w}')} AS bin_lo,
       {r4(f'lo + (g.bin + 1) * {w}')} AS bin_hi, CAST(COALESCE(cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.variable = c.variable AND g.bin = c.bin"""


@register("histogram_lineitem", "CHT-1", _hist_sql(LINEITEM_NULLS_SQL, LI_NUM))
def histogram_lineitem(spark, sf):
    return C.histogram(lineitem_nulls(spark, sf), LI_NUM)


CONST_SQL = "(SELECT o_totalprice, CAST(1 AS DOUBLE) AS one FROM orders)"


@register("histogram_orders_const", "CHT-1 FLT-4", _hist_sql(CONST_SQL, ["o_totalprice", "one"]))
def histogram_orders_const(spark, sf):
    o = t(spark, sf, "orders").select("o_totalprice", F.lit(1.0).alias("one"))
    return C.histogram(o, ["o_totalprice", "one"])


def _box_sql(src, cols):
    return f"""
WITH t AS (SELECT * FROM ({tall_sql(src, cols)}) WHERE value IS NOT NULL),
q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3 FROM t GROUP BY variable),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT variable, {r4('ANY_VALUE(q1)')} AS q1, {r4('ANY_VALUE(med)')} AS median, {r4('ANY_VALUE(q3)')} AS q3,
       {r4('MIN(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_lo,
       {r4('MAX(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_hi,
       CAST(SUM(CASE WHEN value >= lo AND value <= hi THEN 0 ELSE 1 END) AS BIGINT) AS n_fliers
FROM t JOIN b USING (variable) GROUP BY variable"""


@register("boxplot_lineitem", "CHT-2", _box_sql(LINEITEM_NULLS_SQL, LI_NUM))
def boxplot_lineitem(spark, sf):
    return C.box_stats(lineitem_nulls(spark, sf), LI_NUM)


def _bars_sql(src, cols, top=20):
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS category FROM {src} WHERE {c} IS NOT NULL"
        for c in cols)
    return f"""
WITH c AS (SELECT column_name, category, COUNT(*) AS cnt FROM ({parts}) GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY cnt DESC, category) AS rk FROM c)
SELECT column_name, CAST(rk AS BIGINT) AS rank, category, CAST(cnt AS BIGINT) AS count FROM r WHERE rk <= {top}"""


@register("bars_orders_nulls", "CHT-3", _bars_sql(ORDERS_NULLS_SQL, ["o_orderstatus", "o_orderpriority"]))
def bars_orders_nulls(spark, sf):
    return C.bar_counts(orders_nulls(spark, sf), ["o_orderstatus", "o_orderpriority"])


@register("bars_part", "CHT-3", _bars_sql("part", ["p_name", "p_brand", "p_type"]))
def bars_part(spark, sf):
    return C.bar_counts(t(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@register("scatter_sample_lineitem", "CHT-4", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)) AS sample_key
FROM lineitem ORDER BY sample_key LIMIT 1000""")
def scatter_sample_lineitem(spark, sf):
    li = t(spark, sf, "lineitem")
    return C.scatter_sample(li, LI_NUM, ["l_orderkey", "l_linenumber"], k=1000)


def _qq_sql(src, cols):
    m = ("CASE WHEN i = n THEN POWER(0.5, 1.0 / n) WHEN i = 1 THEN 1 - POWER(0.5, 1.0 / n) "
         "ELSE (i - 0.3175) / (n + 0.365) END")
    return f"""
WITH t AS (SELECT * FROM ({tall_sql(src, cols)}) WHERE value IS NOT NULL),
r AS (SELECT variable, value, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY value) AS i,
             COUNT(*) OVER (PARTITION BY variable) AS n FROM t),
p AS (SELECT variable, n, i, value, {m} AS m FROM r WHERE n >= 5),
q AS (SELECT variable, n, i, value, {norm_ppf_sql('m')} AS x FROM p)"""


@register("qq_fit_lineitem", "CHT-5", _qq_sql(LINEITEM_NULLS_SQL, LI_NUM) + f"""
SELECT variable, CAST(COUNT(*) AS BIGINT) AS n, {r4('REGR_SLOPE(value, x)', 3)} AS slope,
       {r4('REGR_INTERCEPT(value, x)', 3)} AS intercept, {r4('CORR(value, x)', 3)} AS r
FROM q GROUP BY variable""")
def qq_fit_lineitem(spark, sf):
    return C.qq_fit(lineitem_nulls(spark, sf), LI_NUM)


@register("qq_points_customer", "CHT-5", _qq_sql("customer", ["c_acctbal", "c_nationkey"]) + f"""
SELECT variable, CAST(i AS BIGINT) AS i, {r4('x')} AS theoretical, {r4('value')} AS sample FROM q""")
def qq_points_customer(spark, sf):
    p = C.qq_points(t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return p.select("variable", F.col("i").cast("long").alias("i"),
                    fr4("theoretical").alias("theoretical"), fr4("sample").alias("sample"))


# ---------------------------------------------------------------- correlation
def _pearson_sql(src, cols):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = "1.0" if i == j else f"CORR({a}, {b})"
            frm = "" if i == j else f" FROM {src}"
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({i} AS BIGINT) AS i, "
                         f"CAST({j} AS BIGINT) AS j, {r4(v)} AS r{frm}")
    return "\nUNION ALL\n".join(parts)


@register("pearson_lineitem", "COR-1", _pearson_sql(LINEITEM_NULLS_SQL, LI_NUM))
def pearson_lineitem(spark, sf):
    m = K.pearson_matrix(lineitem_nulls(spark, sf), LI_NUM)
    return m.select("var1", "var2", "i", "j", fr4("r").alias("r"))


SP_COLS = LI_NUM


def _spearman_sql(src, cols):
    parts = []
    for (i, a), (j, b) in combinations(list(enumerate(cols)), 2):
        parts.append(f"""SELECT '{a}' AS var1, '{b}' AS var2, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j,
  CORR(rx, ry) AS r FROM (
  SELECT RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src}
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL))""")
    up = "\nUNION ALL\n".join(parts)
    diag = "\nUNION ALL\n".join(
        f"SELECT '{c}', '{c}', CAST({i} AS BIGINT), CAST({i} AS BIGINT), 1.0" for i, c in enumerate(cols))
    return f"""
WITH u AS ({up})
SELECT var1, var2, i, j, {r4('r')} AS r FROM u
UNION ALL SELECT var2, var1, j, i, {r4('r')} FROM u
UNION ALL {diag}"""


@register("spearman_lineitem", "COR-2", _spearman_sql(LINEITEM_NULLS_SQL, SP_COLS))
def spearman_lineitem(spark, sf):
    m = K.spearman_matrix(lineitem_nulls(spark, sf), SP_COLS)
    return m.select("var1", "var2", "i", "j", fr4("r").alias("r"))


@register("spearman_part", "COR-2", _spearman_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def spearman_part(spark, sf):
    m = K.spearman_matrix(t(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"])
    return m.select("var1", "var2", "i", "j", fr4("r").alias("r"))


def _pairs_raw_sql(src, cols):
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {i} AS i, {j} AS j, CORR({a}, {b}) AS r FROM {src}"
        for (i, a), (j, b) in combinations(list(enumerate(cols)), 2))


@register("top_pairs_lineitem", "COR-4 COR-5", f"""
SELECT var1, var2, {r4('r')} AS r,
       CASE WHEN ABS(r) > 0.7 THEN 'strong' WHEN ABS(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength
FROM ({_pairs_raw_sql(LINEITEM_NULLS_SQL, LI_NUM)}) ORDER BY ABS(r) DESC, i, j LIMIT 10""")
def top_pairs_lineitem(spark, sf):
    m = K.pearson_matrix(lineitem_nulls(spark, sf), LI_NUM)
    return K.top_pairs(m, 10)


def _kendall_sql(src, cols):
    parts = []
    for (i, a), (j, b) in combinations(list(enumerate(cols)), 2):
        parts.append(f"""SELECT '{a}' AS var1, '{b}' AS var2, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, r FROM (
  WITH d AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
  s AS (SELECT SUM(SIGN(p.x - q.x) * SIGN(p.y - q.y)) / 2 AS s FROM d p, d q),
  n AS (SELECT COUNT(*) * (COUNT(*) - 1) / 2 AS n0 FROM d),
  tx AS (SELECT SUM(c * (c - 1) / 2) AS n1 FROM (SELECT COUNT(*) AS c FROM d GROUP BY x)),
  ty AS (SELECT SUM(c * (c - 1) / 2) AS n2 FROM (SELECT COUNT(*) AS c FROM d GROUP BY y))
  SELECT s / SQRT((n0 - n1) * (n0 - n2)) AS r FROM s, n, tx, ty)""")
    up = "\nUNION ALL\n".join(parts)
    diag = "\nUNION ALL\n".join(
        f"SELECT '{c}', '{c}', CAST({i} AS BIGINT), CAST({i} AS BIGINT), 1.0" for i, c in enumerate(cols))
    return f"""
WITH u AS ({up})
SELECT var1, var2, i, j, {r4('r')} AS r FROM u
UNION ALL SELECT var2, var1, j, i, {r4('r')} FROM u
UNION ALL {diag}"""


@register("kendall_part", "COR-3", _kendall_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def kendall_part(spark, sf):
    m = K.correlation_matrix(t(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"], "kendall")
    return m.select("var1", "var2", "i", "j", fr4("r").alias("r"))


@register("melt_lineitem", "PRJ-1", tall_sql("lineitem", LI_NUM))
def melt_lineitem(spark, sf):
    from ..functions.quantiles import tall
    return tall(t(spark, sf, "lineitem"), LI_NUM)

"""Registered queries: roles, profile, descriptive statistics, frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import roles as R
from .registry import register, t
from .sqlgen import r4, tall_sql, tall_str_sql

# ---------------------------------------------------------------- variants
# Rule-made nulls, outliers and duplicates: the same rule in Spark and SQL.
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]
LI_NUM = LINEITEM_COLS[:8]

LINEITEM_NULLS_SQL = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "CASE WHEN l_discount = 0.0 THEN NULL ELSE l_quantity END AS l_quantity, "
    "CASE WHEN l_discount = 0.1 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)")


def lineitem_nulls(spark, sf):
    li = t(spark, sf, "lineitem")
    return (li.withColumn("l_quantity", F.when(F.col("l_discount") == 0.0, F.lit(None))
                          .otherwise(F.col("l_quantity")))
              .withColumn("l_extendedprice", F.when(F.col("l_discount") == 0.1,
                                                    F.col("l_extendedprice") * 20)
                          .otherwise(F.col("l_extendedprice"))))


ORDERS_NULLS_SQL = (
    "(SELECT o_orderkey, o_custkey, "
    "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS o_orderstatus, "
    "o_totalprice, o_orderdate, o_orderpriority FROM orders)")


def orders_nulls(spark, sf):
    o = t(spark, sf, "orders")
    return o.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None))
                        .otherwise(F.col("o_orderstatus")))


LINEITEM_PROJ_SQL = ("(SELECT l_returnflag, l_linestatus, l_linenumber, "
                     "CASE WHEN l_discount = 0.0 THEN NULL ELSE l_quantity END AS l_quantity "
                     "FROM lineitem)")


def lineitem_proj(spark, sf):
    return lineitem_nulls(spark, sf).select("l_returnflag", "l_linestatus", "l_linenumber",
                                            "l_quantity")


# ---------------------------------------------------------------- roles
def _roles_sql(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, base) in enumerate(cols):
        if base == "string":
            role = (f"CASE WHEN COUNT(DISTINCT {c}) * 1.0 / GREATEST(COUNT(*), 1) < 0.5 "
                    f"THEN 'categorical' ELSE 'text' END")
            parts.append(f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, "
                         f"{role} AS role FROM {src}")
        else:
            parts.append(f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, "
                         f"'{base}' AS role")
    return "\nUNION ALL\n".join(parts)


def _roles_q(name):
    def q(spark, sf):
        return R.infer_roles(t(spark, sf, name)).select(
            F.col("position").cast("long").alias("position"), "column_name", "role")
    return q


_ROLE_TABLES = {
    "lineitem": [(c, "numeric") for c in LI_NUM] + [("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "datetime")],
    "documents": [("doc_id", "numeric"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "numeric")],
    "nation": [("n_nationkey", "numeric"), ("n_name", "string"), ("n_regionkey", "numeric")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "embeddings": [("vec_id", "numeric"), ("embedding", "other"), ("label", "numeric")],
    "conversations": [("conv_id", "numeric"), ("turn", "numeric"), ("role", "string"),
                      ("text", "string")],
}
for _name, _cols in _ROLE_TABLES.items():
    register(f"roles_{_name}", "SCH-1 SCH-2", _roles_sql(_name, _cols))(_roles_q(_name))


@register("role_flags_part", "SCH-2", f"""
SELECT position, column_name, role, column_name = 'p_retailprice' AS is_target,
       role = 'numeric' AND column_name <> 'p_retailprice' AS is_predictor
FROM ({_roles_sql("part", _ROLE_TABLES["part"])})""")
def role_flags_part(spark, sf):
    """Target and predictor flags beside the roles."""
    return R.column_roles(t(spark, sf, "part"), "p_retailprice").select(
        F.col("position").cast("long").alias("position"), "column_name", "role", "is_target", "is_predictor")


ORDERS_COLS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"),
               ("o_orderpriority", "string")]


def _overview_sql():
    roles = _roles_sql(ORDERS_NULLS_SQL, ORDERS_COLS)
    miss = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing "
        f"FROM {ORDERS_NULLS_SQL}" for c, _ in ORDERS_COLS)
    return (f"SELECT r.position, r.column_name, r.role, m.missing FROM ({roles}) r "
            f"JOIN ({miss}) m USING (column_name)")


@register("overview_orders_nulls", "SCH-3 FLT-2", _overview_sql())
def overview_orders_nulls(spark, sf):
    return R.column_overview(orders_nulls(spark, sf)).select(
        F.col("position").cast("long").alias("position"), "column_name", "role", "missing")


# ---------------------------------------------------------------- profile
@register("profile_summary_lineitem", "AGG-1 AGG-4 AGG-5", f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_cols,
       CAST(SUM((l_returnflag IS NULL)::INT + (l_linestatus IS NULL)::INT
                + (l_linenumber IS NULL)::INT + (l_quantity IS NULL)::INT) AS BIGINT) AS total_missing,
       CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {LINEITEM_PROJ_SQL})) AS BIGINT)
         AS duplicate_rows
FROM {LINEITEM_PROJ_SQL}""")
def profile_summary_lineitem(spark, sf):
    return P.profile_summary(lineitem_proj(spark, sf))


def _missing_sql():
    return "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, "
        f"CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_count, "
        f"ROUND((COUNT(*) - COUNT({c})) * 100.0 / GREATEST(COUNT(*), 1), 2) AS missing_pct "
        f"FROM {ORDERS_NULLS_SQL}" for i, (c, _) in enumerate(ORDERS_COLS))


@register("missing_orders_nulls", "AGG-3", _missing_sql())
def missing_orders_nulls(spark, sf):
    return P.missing_values(orders_nulls(spark, sf)).select(
        F.col("position").cast("long").alias("position"), "column_name", "missing_count", "missing_pct")


@register("missing_table_orders_nulls", "FND-2",
          f"SELECT * FROM ({_missing_sql()}) WHERE missing_count > 0")
def missing_table_orders_nulls(spark, sf):
    return P.missing_table(orders_nulls(spark, sf)).select(
        F.col("position").cast("long").alias("position"), "column_name", "missing_count", "missing_pct")


def _outlier_sql(src, cols):
    return f"""
WITH t AS ({tall_sql(src, cols)}),
b AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
             COUNT(value) AS n FROM t GROUP BY variable)
SELECT t.variable AS column_name,
       CAST(SUM(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
                THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM t JOIN b USING (variable) WHERE value IS NOT NULL AND n >= 4 GROUP BY t.variable"""


@register("outliers_lineitem", "AGG-6 PRE-3", _outlier_sql(LINEITEM_NULLS_SQL, LI_NUM))
def outliers_lineitem(spark, sf):
    return P.outlier_counts(lineitem_nulls(spark, sf), LI_NUM)


def _describe_sql(src, cols):
    return f"""
WITH t AS (SELECT * FROM ({tall_sql(src, cols)}) WHERE value IS NOT NULL),
m AS (SELECT variable, COUNT(*) AS n, AVG(value) AS mu, STDDEV_SAMP(value) AS sd,
             MIN(value) AS mn, MAX(value) AS mx, quantile_cont(value, 0.25) AS q25,
             quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
      FROM t GROUP BY variable),
c AS (SELECT t.variable, AVG(POWER(value - mu, 2)) AS m2, AVG(POWER(value - mu, 3)) AS m3,
             AVG(POWER(value - mu, 4)) AS m4 FROM t JOIN m USING (variable) GROUP BY t.variable)
SELECT variable, CAST(n AS BIGINT) AS count, {r4('mu')} AS mean, {r4('q50')} AS median,
       {r4('sd')} AS std, {r4('mn')} AS min, {r4('q25')} AS q25, {r4('q50')} AS q50,
       {r4('q75')} AS q75, {r4('mx')} AS max,
       {r4('CASE WHEN m2 > 0 THEN m3 / POWER(m2, 1.5) END')} AS skewness,
       {r4('CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END')} AS kurtosis
FROM m JOIN c USING (variable)"""


@register("describe_lineitem", "AGG-7 AGG-8 AGG-9 AGG-10 PRJ-3",
          _describe_sql(LINEITEM_NULLS_SQL, LI_NUM))
def describe_lineitem(spark, sf):
    return P.describe(lineitem_nulls(spark, sf), LI_NUM)


_ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("describe_orders", "AGG-7 AGG-8 AGG-9 AGG-10", _describe_sql("orders", _ORD_NUM))
def describe_orders(spark, sf):
    return P.describe(t(spark, sf, "orders"))


_CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("describe_customer", "AGG-7 AGG-8 AGG-9 AGG-10", _describe_sql("customer", _CUST_NUM))
def describe_customer(spark, sf):
    return P.describe(t(spark, sf, "customer"))


@register("skew_g1_lineitem", "AGG-11", f"""
WITH t AS (SELECT * FROM ({tall_sql(LINEITEM_NULLS_SQL, LI_NUM)}) WHERE value IS NOT NULL),
m AS (SELECT variable, COUNT(*) AS n, AVG(value) AS mu FROM t GROUP BY variable),
c AS (SELECT t.variable, AVG(POWER(value - mu, 2)) AS m2, AVG(POWER(value - mu, 3)) AS m3
      FROM t JOIN m USING (variable) GROUP BY t.variable)
SELECT variable, CAST(n AS BIGINT) AS n,
       {r4('m3 / POWER(m2, 1.5) * SQRT(n * (n - 1.0)) / (n - 2)')} AS g1
FROM m JOIN c USING (variable)""")
def skew_g1_lineitem(spark, sf):
    g = P.skew_bias_corrected(lineitem_nulls(spark, sf), LI_NUM)
    from ..functions.frames import r4 as fr4
    return g.select("variable", "n", fr4("g1").alias("g1"))


# ---------------------------------------------------------------- frequency
def _freq_sql(src, cols, top=20):
    return f"""
WITH t AS ({tall_str_sql(src, cols)}),
c AS (SELECT column_name, category, COUNT(*) AS cnt FROM t GROUP BY column_name, category),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY cnt DESC, category ASC NULLS LAST) AS rk,
             SUM(cnt) OVER (PARTITION BY column_name) AS total FROM c)
SELECT column_name, CAST(rk AS BIGINT) AS rank, category, CAST(cnt AS BIGINT) AS count,
       ROUND(cnt * 100.0 / total, 2) AS percent FROM r WHERE rk <= {top}"""


@register("frequency_orders_nulls", "AGG-12",
          _freq_sql(ORDERS_NULLS_SQL, ["o_orderstatus", "o_orderpriority"]))
def frequency_orders_nulls(spark, sf):
    return P.frequency_table(orders_nulls(spark, sf), ["o_orderstatus", "o_orderpriority"]) \
        .withColumn("rank", F.col("rank").cast("long"))


@register("frequency_part", "AGG-12", _freq_sql("part", ["p_name", "p_brand", "p_type"]))
def frequency_part(spark, sf):
    return P.frequency_table(t(spark, sf, "part"), ["p_name", "p_brand", "p_type"]) \
        .withColumn("rank", F.col("rank").cast("long"))


@register("distinct_part", "AGG-13", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS n_distinct FROM part"
    for c in ["p_name", "p_brand", "p_type", "p_size"]))
def distinct_part(spark, sf):
    return P.distinct_table(t(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size"])


def _mode_sql(src, cols):
    parts = []
    for c, kind in cols:
        v = f"CAST({c} AS DOUBLE)" if kind == "num" else f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS column_name, CAST(v AS VARCHAR) AS mode, CAST(cnt AS BIGINT) AS mode_count
FROM (SELECT {v} AS v, COUNT(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1
      ORDER BY cnt DESC, v ASC LIMIT 1)""")
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


@register("mode_orders_nulls", "AGG-15",
          _mode_sql(ORDERS_NULLS_SQL, [("o_orderstatus", "str"), ("o_orderpriority", "str")]))
def mode_orders_nulls(spark, sf):
    return P.mode_values(orders_nulls(spark, sf), ["o_orderstatus", "o_orderpriority"])


@register("mode_part", "AGG-15",
          _mode_sql("part", [("p_size", "num"), ("p_brand", "str"), ("p_type", "str")]))
def mode_part(spark, sf):
    return P.mode_values(t(spark, sf, "part"), ["p_size", "p_brand", "p_type"])


@register("dtypes_lineitem", "AGG-2")
def dtypes_lineitem(spark, sf):
    return P.column_dtypes(t(spark, sf, "lineitem"))

"""Registered queries: preprocessing, splits and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import r4 as fr4
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import split as S
from ..operators.isoforest import isolation_forest_table
from ..operators.profile import outlier_counts
from .profile_queries import LI_NUM, LINEITEM_NULLS_SQL, ORDERS_NULLS_SQL, lineitem_nulls, orders_nulls
from .registry import register, t
from .sqlgen import r4, tall_sql


# ---------------------------------------------------------------- PRE-1, 2
@register("fill_values_lineitem_nulls", "PRE-1", f"""
WITH t AS ({tall_sql(LINEITEM_NULLS_SQL, LI_NUM, 'column_name')})
SELECT column_name, {r4('AVG(value)')} AS mean, {r4('quantile_cont(value, 0.5)')} AS median
FROM t GROUP BY column_name""")
def fill_values_lineitem_nulls(spark, sf):
    fv = P.fill_values(lineitem_nulls(spark, sf), LI_NUM, [])
    return fv.select("column_name", fr4("mean").alias("mean"), fr4("median").alias("median"))


@register("impute_lineitem_nulls", "PRE-2 FLT-1", f"""
SELECT l_orderkey, l_linenumber,
       {r4(f'COALESCE(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {LINEITEM_NULLS_SQL}))')} AS l_quantity
FROM {LINEITEM_NULLS_SQL}""")
def impute_lineitem_nulls(spark, sf):
    li = lineitem_nulls(spark, sf)
    num = P.split_kinds(li)[0]
    out = P.impute(li, num, [c for c in li.columns if c not in num])
    return out.select(F.col("l_orderkey"), F.col("l_linenumber"), fr4("l_quantity").alias("l_quantity"))


@register("impute_orders_nulls", "PRE-2 AGG-15", f"""
WITH m AS (SELECT o_orderstatus AS v FROM {ORDERS_NULLS_SQL} WHERE o_orderstatus IS NOT NULL
           GROUP BY 1 ORDER BY COUNT(*) DESC, v LIMIT 1)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, COALESCE(o_orderstatus, (SELECT v FROM m)) AS o_orderstatus
FROM {ORDERS_NULLS_SQL}""")
def impute_orders_nulls(spark, sf):
    o = orders_nulls(spark, sf)
    num, other = P.split_kinds(o)
    return P.impute(o, num, other).select(F.col("o_orderkey").cast("long").alias("o_orderkey"),
                                          "o_orderstatus")


# ---------------------------------------------------------------- PRE-3, 5
@register("outlier_gate_lineitem_nulls", "PRE-3 PRE-5", f"""
WITH t AS ({tall_sql(LINEITEM_NULLS_SQL, LI_NUM)}),
b AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, COUNT(value) AS n
      FROM t GROUP BY variable),
o AS (SELECT SUM(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS k
      FROM t JOIN b USING (variable) WHERE value IS NOT NULL AND n >= 4)
SELECT CAST(k AS BIGINT) AS iqr_total, CAST((SELECT COUNT(*) FROM lineitem) AS BIGINT) AS n_rows,
       k >= 0.01 * (SELECT COUNT(*) FROM lineitem) AS treat FROM o""")
def outlier_gate_lineitem_nulls(spark, sf):
    li = lineitem_nulls(spark, sf)
    oc = outlier_counts(li, LI_NUM).agg(F.sum("outliers").alias("iqr_total"))
    n = li.agg(F.count(F.lit(1)).alias("n_rows"))
    from ..functions.frames import attach_scalars
    return attach_scalars(oc, n).select(F.col("iqr_total").cast("long").alias("iqr_total"),
                                        F.col("n_rows").cast("long").alias("n_rows"),
                                        (F.col("iqr_total") >= 0.01 * F.col("n_rows")).alias("treat"))


# ---------------------------------------------------------------- PRE-4 (rows only)
@register("isoforest_lineitem", "PRE-4")
def isoforest_lineitem(spark, sf):
    li = t(spark, sf, "lineitem")
    return isolation_forest_table(li, LI_NUM) \
        .select("rows", "flagged")


# ---------------------------------------------------------------- PRE-6
@register("winsorize_lineitem_nulls", "PRE-6", f"""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi,
                  quantile_cont(l_quantity, 0.01) AS qlo, quantile_cont(l_quantity, 0.99) AS qhi
           FROM {LINEITEM_NULLS_SQL})
SELECT l_orderkey, l_linenumber, {r4('LEAST(GREATEST(l_extendedprice, lo), hi)')} AS l_extendedprice,
       CASE WHEN l_quantity IS NULL THEN NULL ELSE {r4('LEAST(GREATEST(l_quantity, qlo), qhi)')} END AS l_quantity
FROM {LINEITEM_NULLS_SQL}, b""")
def winsorize_lineitem_nulls(spark, sf):
    w = P.winsorize(lineitem_nulls(spark, sf), ["l_extendedprice", "l_quantity"])
    return w.select("l_orderkey", "l_linenumber", fr4("l_extendedprice").alias("l_extendedprice"),
                    fr4("l_quantity").alias("l_quantity"))


# ---------------------------------------------------------------- PRE-7..10
def _g1_sql(src, cols):
    return f"""
WITH t AS (SELECT * FROM ({tall_sql(src, cols)}) WHERE value IS NOT NULL),
m AS (SELECT variable, COUNT(*) AS n, AVG(value) AS mu FROM t GROUP BY variable),
c AS (SELECT t.variable, AVG(POWER(value - mu, 2)) AS m2, AVG(POWER(value - mu, 3)) AS m3
      FROM t JOIN m USING (variable) GROUP BY t.variable),
g AS (SELECT MAX(ABS(m3 / POWER(m2, 1.5) * SQRT(n * (n - 1.0)) / (n - 2))) AS g FROM m JOIN c USING (variable))"""


@register("scaler_choice_lineitem_nulls", "PRE-7 AGG-11", _g1_sql(LINEITEM_NULLS_SQL, LI_NUM) + f"""
SELECT CASE WHEN g > 1 THEN 'RobustScaler' WHEN g > 0.5 THEN 'StandardScaler' ELSE 'MinMaxScaler' END AS chosen,
       {r4('g')} AS max_abs_skew FROM g""")
def scaler_choice_lineitem_nulls(spark, sf):
    name, g = P.choose_scaler(lineitem_nulls(spark, sf), LI_NUM)
    return spark.createDataFrame([(name, g)], "chosen string, max_abs_skew double") \
        .select("chosen", fr4("max_abs_skew").alias("max_abs_skew"))


_SC = ["l_quantity", "l_extendedprice", "l_discount"]


def _scale_sql(kind):
    if kind == "robust":
        a, b = "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"
    elif kind == "standard":
        a, b = "AVG({c})", "STDDEV_POP({c})"
    else:
        a, b = "MIN({c})", "MAX({c}) - MIN({c})"
    consts = ", ".join(f"{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}" for c in _SC)
    cols = ", ".join(
        r4(f"({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END") + f" AS {c}" for c in _SC)
    return f"""WITH k AS (SELECT {consts} FROM {LINEITEM_NULLS_SQL})
SELECT l_orderkey, l_linenumber, {cols} FROM {LINEITEM_NULLS_SQL}, k"""


def _scale_q(method):
    def q(spark, sf):
        s = P.scale(lineitem_nulls(spark, sf), _SC, method)
        return s.select("l_orderkey", "l_linenumber", *[fr4(c).alias(c) for c in _SC])
    return q


register("scale_robust_lineitem_nulls", "PRE-8", _scale_sql("robust"))(_scale_q("RobustScaler"))
register("scale_standard_lineitem_nulls", "PRE-9 CLS-3", _scale_sql("standard"))(_scale_q("StandardScaler"))
register("scale_minmax_lineitem_nulls", "PRE-10", _scale_sql("minmax"))(_scale_q("MinMaxScaler"))


# ---------------------------------------------------------------- PRE-11, 12
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("one_hot_orders", "PRE-11", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, " + ", ".join(
    f"CAST(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS \"o_orderpriority_{v}\""
    for v in _PRIO[1:]) + ", CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS o_orderstatus_O"
    ", CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS INTEGER) AS o_orderstatus_P FROM orders")
def one_hot_orders(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    enc, _ = P.encode_categoricals(o, ["o_orderpriority", "o_orderstatus"])
    return enc.select(F.col("o_orderkey").cast("long").alias("o_orderkey"),
                      *[c for c in enc.columns if c != "o_orderkey"])


PART_NULLS_SQL = "(SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS p_name FROM part)"


@register("label_codes_part_nulls", "PRE-12", f"""
WITH d AS (SELECT p_name, DENSE_RANK() OVER (ORDER BY p_name) - 1 AS code
           FROM (SELECT DISTINCT p_name FROM {PART_NULLS_SQL} WHERE p_name IS NOT NULL))
SELECT CAST(p.p_partkey AS BIGINT) AS p_partkey, CAST(COALESCE(d.code, -1) AS BIGINT) AS p_name
FROM {PART_NULLS_SQL} p LEFT JOIN d USING (p_name)""")
def label_codes_part_nulls(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 45, F.lit(None))
                                    .otherwise(F.col("p_name")).alias("p_name"))
    out, _ = P.encode_categoricals(p, ["p_name"])
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")


@register("auto_preprocess_log_lineitem", "PRE-13 PRE-4 PRE-5")
def auto_preprocess_log_lineitem(spark, sf):
    _, log = P.auto_preprocess(lineitem_nulls(spark, sf))
    return log


@register("auto_preprocess_data_orders", "PRE-2 PRE-7 PRE-11 PRE-12")
def auto_preprocess_data_orders(spark, sf):
    data, _ = P.auto_preprocess(orders_nulls(spark, sf))
    return data


# ---------------------------------------------------------------- CLS-1, 2
@register("feature_frame_orders_nulls", "CLS-1 FLT-2 FLT-4 PRJ-2", f"""
WITH s AS ({ORDERS_NULLS_SQL}),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS mp, quantile_cont(o_custkey, 0.5) AS mc FROM s)
SELECT o_orderpriority, {r4('COALESCE(o_totalprice, mp)')} AS o_totalprice, {r4('COALESCE(o_custkey, mc)')} AS o_custkey,
       CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS DOUBLE) AS o_orderstatus_O,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS DOUBLE) AS o_orderstatus_P
FROM s, m WHERE o_orderpriority IS NOT NULL""")
def feature_frame_orders_nulls(spark, sf):
    o = orders_nulls(spark, sf)
    x, names = P.feature_frame(o, "o_orderpriority", ["o_totalprice", "o_custkey"],
                               ["o_orderstatus"])
    return x.select("o_orderpriority", *[fr4(c).alias(c) if not c.startswith("o_orderstatus") else F.col(c)
                                         for c in names])


@register("encode_labels_orders", "CLS-2", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
       CAST(DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders""")
def encode_labels_orders(spark, sf):
    o, _ = P.encode_labels(t(spark, sf, "orders"), "o_orderpriority")
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "label")


# ---------------------------------------------------------------- CV-1..5
def _h(keys, seed=42):
    return "md5('" + str(seed) + "' || " + " || ".join(f"'|' || CAST({k} AS VARCHAR)" for k in keys) + ")"


def _split_sql(src, keys, strat_sql, test=0.2):
    return f"""
WITH d AS (SELECT *, CAST({strat_sql} AS VARCHAR) AS s, {_h(keys)} AS h FROM {src}),
c AS (SELECT s, COUNT(*) AS n FROM d GROUP BY s),
a AS (SELECT *, CEIL(CAST({test} AS DOUBLE) * SUM(n) OVER ()) AS nt, SUM(n) OVER () AS nn FROM c),
b AS (SELECT *, nt * n / nn AS q, FLOOR(nt * n / nn) AS f FROM a),
e AS (SELECT *, f + CASE WHEN ROW_NUMBER() OVER (ORDER BY q - f DESC, s) <= nt - SUM(f) OVER () THEN 1 ELSE 0 END
             AS alloc FROM b),
r AS (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY d.s ORDER BY h) - 1 AS i FROM d)
SELECT r.i < e.alloc AS is_test, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM({keys[0]}) AS BIGINT) AS key_sum
FROM r JOIN e USING (s) GROUP BY 1"""


def _split_out(df, key):
    return df.groupBy("is_test").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                     F.sum(key).cast("long").alias("key_sum"))


# (l_orderkey, l_linenumber) repeats in the generated lineitem; these six columns are unique
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@register("split_lineitem", "CV-1", _split_sql("lineitem", LI_KEY, "0"))
def split_lineitem(spark, sf):
    s = S.train_test_split(t(spark, sf, "lineitem"), LI_KEY)
    return _split_out(s, "l_orderkey")


@register("split_stratified_orders", "CV-1 CV-5",
          _split_sql("orders", ["o_orderkey"], "o_orderpriority"))
def split_stratified_orders(spark, sf):
    s = S.train_test_split(t(spark, sf, "orders"), ["o_orderkey"], stratify=F.col("o_orderpriority"))
    return _split_out(s, "o_orderkey")


def _qbins_sql(col, src):
    e = f"(SELECT list_distinct(quantile_cont({col}, [0.2, 0.4, 0.6, 0.8])) FROM {src})"
    return f"len(list_filter({e}, lambda x: {col} > x))"


@register("split_qbins_part", "CV-1", _split_sql("part", ["p_partkey"], _qbins_sql("p_retailprice", "part")))
def split_qbins_part(spark, sf):
    p = t(spark, sf, "part")
    s = S.train_test_split(p, ["p_partkey"], stratify=S.quantile_strata(p, "p_retailprice", 5))
    return _split_out(s, "p_partkey")


def _kfold_sql(src, keys, strat_sql, k=5):
    return f"""
WITH d AS (SELECT *, CAST({strat_sql} AS VARCHAR) AS s, {_h(keys)} AS h FROM {src}),
r AS (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY s ORDER BY h) - 1 AS i, COUNT(*) OVER (PARTITION BY s) AS n FROM d),
f AS (SELECT *, n // {k} AS q, n % {k} AS rr FROM r),
g AS (SELECT *, CASE WHEN i < rr * (q + 1) THEN i // (q + 1) ELSE rr + (i - rr * (q + 1)) // q END AS fold FROM f)
SELECT CAST(fold AS INTEGER) AS fold, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM({keys[0]}) AS BIGINT) AS key_sum
FROM g GROUP BY fold"""


def _fold_out(df, key):
    return df.groupBy("fold").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                  F.sum(key).cast("long").alias("key_sum"))


@register("kfold_lineitem", "CV-2", _kfold_sql("lineitem", LI_KEY, "0"))
def kfold_lineitem(spark, sf):
    return _fold_out(S.kfold(t(spark, sf, "lineitem"), LI_KEY, 5), "l_orderkey")


@register("kfold_stratified_orders", "CV-3", _kfold_sql("orders", ["o_orderkey"], "o_orderpriority"))
def kfold_stratified_orders(spark, sf):
    f = S.kfold(t(spark, sf, "orders"), ["o_orderkey"], 5, stratify=F.col("o_orderpriority"))
    return _fold_out(f, "o_orderkey")


@register("cv_ols_part", "CV-4 REG-10", f"""
WITH d AS (SELECT p_partkey AS x, p_retailprice AS y, {_h(['p_partkey'])} AS h FROM part),
r AS (SELECT d.*, ROW_NUMBER() OVER (ORDER BY h) - 1 AS i, COUNT(*) OVER () AS n FROM d),
f AS (SELECT *, n // 5 AS q, n % 5 AS rr FROM r),
g AS (SELECT x, y, CASE WHEN i < rr * (q + 1) THEN i // (q + 1) ELSE rr + (i - rr * (q + 1)) // q END AS fold FROM f),
m AS (SELECT k.fold, REGR_SLOPE(g.y, g.x) AS b, REGR_INTERCEPT(g.y, g.x) AS a
      FROM (SELECT DISTINCT fold FROM g) k JOIN g ON g.fold <> k.fold GROUP BY k.fold),
s AS (SELECT g.fold, 1 - SUM(POWER(y - (a + b * x), 2)) / (VAR_POP(y) * COUNT(*)) AS r2
      FROM g JOIN m USING (fold) GROUP BY g.fold)
SELECT {r4('AVG(r2)')} AS mean, {r4('STDDEV_POP(r2)')} AS std, CAST(COUNT(*) AS BIGINT) AS n_splits FROM s""")
def cv_ols_part(spark, sf):
    from ..operators.regress import kfold_simple_ols
    sc = kfold_simple_ols(t(spark, sf, "part"), "p_partkey", "p_retailprice", ["p_partkey"], k=5)
    return S.cv_summary(sc, "r2").select(fr4("mean").alias("mean"), fr4("std").alias("std"),
                                         F.col("n_splits").cast("long").alias("n_splits"))


# ---------------------------------------------------------------- CV-4: any estimator, any score
def _fold_sql(rows, key, cols):
    return f"""d AS ({rows}), r AS (SELECT d.*, ROW_NUMBER() OVER (ORDER BY {_h([key])}) - 1 AS i, COUNT(*) OVER () AS n FROM d),
g AS (SELECT {cols}, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM r)"""


def _score_rows(names):
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS scorer, {r4(f'AVG({c})')} AS mean, {r4(f'STDDEV_POP({c})')} AS std, "
                                 f"CAST(COUNT(*) AS BIGINT) AS n_splits FROM s" for n, c in names.items())


@register("cv_scores_linear_part", "CV-4 REG-10", f"""
WITH {_fold_sql("SELECT p_partkey, p_partkey AS x, p_retailprice AS y FROM part", "p_partkey", "x, y")},
m AS (SELECT k.fold, REGR_SLOPE(g.y, g.x) AS b, REGR_INTERCEPT(g.y, g.x) AS a
      FROM (SELECT DISTINCT fold FROM g) k JOIN g ON g.fold <> k.fold GROUP BY k.fold),
s AS (SELECT g.fold, 1 - SUM(POWER(y - (a + b * x), 2)) / (VAR_POP(y) * COUNT(*)) AS r2,
      -AVG(ABS(y - (a + b * x))) AS mae, -SQRT(AVG(POWER(y - (a + b * x), 2))) AS rmse FROM g JOIN m USING (fold) GROUP BY g.fold)
{_score_rows({"r2": "r2", "neg_mean_absolute_error": "mae", "neg_root_mean_squared_error": "rmse"})}""")
def cv_scores_linear_part(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from ..operators.crossval import cross_validate, score_summary
    part = t(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(solver="normal")])
    got = score_summary(cross_validate(part, model, ["r2", "neg_mean_absolute_error", "neg_root_mean_squared_error"], ["p_partkey"]))
    return got.select("scorer", fr4("mean").alias("mean"), fr4("std").alias("std"), F.col("n_splits").cast("long").alias("n_splits"))


@register("cv_scores_rule_documents", "CV-4 EVL-1 EVL-2 EVL-5", f"""
WITH {_fold_sql("SELECT d.doc_id, l.quality AS y, d.n_chars AS z FROM documents d JOIN labels l USING (doc_id)", "doc_id", "doc_id, y, z")},
c AS (SELECT k.fold, AVG(g.z) AS cut FROM (SELECT DISTINCT fold FROM g) k JOIN g ON g.fold <> k.fold GROUP BY k.fold),
p AS (SELECT g.*, CASE WHEN z > cut THEN 1 ELSE 0 END AS p,
      RANK() OVER (PARTITION BY fold ORDER BY z) + (COUNT(*) OVER (PARTITION BY fold, z) - 1) / 2.0 AS rk FROM g JOIN c USING (fold)),
s AS (SELECT fold, AVG((y = p)::INT) AS acc, 2.0 * SUM((y = 1 AND p = 1)::INT) / (SUM(p) + SUM(y)) AS f1,
      (SUM(CASE WHEN y = 1 THEN rk END) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * (COUNT(*) - SUM(y))) AS roc FROM p GROUP BY fold)
{_score_rows({"accuracy": "acc", "f1": "f1", "roc_auc": "roc"})}""")
def cv_scores_rule_documents(spark, sf):
    """A rule that learns the mean length of its training rows: longer texts are called good."""
    from ..operators.crossval import Fitted, cross_validate, score_summary

    def learn(train):
        cut = train.agg(F.avg("n_chars")).first()[0]
        return lambda rows: rows.withColumn("prediction", (F.col("n_chars") > cut).cast("int")).withColumn("score", F.col("n_chars"))
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", F.col("quality").alias("label"))
    got = score_summary(cross_validate(rows, Fitted(learn), ["accuracy", "f1", "roc_auc"], ["doc_id"]))
    return got.select("scorer", fr4("mean").alias("mean"), fr4("std").alias("std"), F.col("n_splits").cast("long").alias("n_splits"))


# ---------------------------------------------------------------- EVL-1..6 on fixed predictions
DOC_PRED_SQL = """(SELECT d.doc_id, l.quality AS label, l.toxic, d.n_chars AS score,
  CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS prediction FROM documents d JOIN labels l USING (doc_id))"""


def doc_pred(spark, sf):
    d = t(spark, sf, "documents")
    lab = t(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "toxic", F.col("n_chars").alias("score"),
        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction"))


def _prf_sql(src, average):
    cls = f"(SELECT label AS c FROM {src} UNION SELECT prediction FROM {src})"
    per = f"""SELECT c.c,
  COALESCE(SUM(CASE WHEN p.label = c.c AND p.prediction = c.c THEN 1 ELSE 0 END), 0) AS tp,
  COALESCE(SUM(CASE WHEN p.prediction = c.c THEN 1 ELSE 0 END), 0) AS np,
  COALESCE(SUM(CASE WHEN p.label = c.c THEN 1 ELSE 0 END), 0) AS nt
  FROM {cls} c, {src} p GROUP BY c.c"""
    m = """CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS re,
           CASE WHEN np + nt > 0 THEN 2.0 * tp / (np + nt) ELSE 0 END AS f1"""
    where = "WHERE c = 1" if average == "binary" else ""
    return f"""WITH per AS ({per}), x AS (SELECT {m} FROM per {where})
SELECT {r4(f'(SELECT AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM {src})')} AS accuracy,
       {r4('AVG(pr)')} AS precision, {r4('AVG(re)')} AS recall, {r4('AVG(f1)')} AS f1 FROM x"""


def _rm(df):
    return df.select(*[fr4(c).alias(c) for c in df.columns])


@register("metrics_binary_documents", "EVL-1 EVL-2", _prf_sql(DOC_PRED_SQL, "binary"))
def metrics_binary_documents(spark, sf):
    return _rm(M.classification_metrics(doc_pred(spark, sf), average="binary")
               .select("accuracy", "precision", "recall", "f1"))


ORD_PRED_SQL = """(SELECT o_orderpriority AS label,
  CASE WHEN o_totalprice > 200000 THEN '1-URGENT' WHEN o_totalprice > 100000 THEN '3-MEDIUM' ELSE '5-LOW' END
  AS prediction FROM orders)"""


def ord_pred(spark, sf):
    o = t(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("label"),
                    F.when(F.col("o_totalprice") > 200000, "1-URGENT")
                     .when(F.col("o_totalprice") > 100000, "3-MEDIUM").otherwise("5-LOW").alias("prediction"))


@register("metrics_macro_orders", "EVL-1 EVL-2", _prf_sql(ORD_PRED_SQL, "macro"))
def metrics_macro_orders(spark, sf):
    return _rm(M.classification_metrics(ord_pred(spark, sf), average="macro")
               .select("accuracy", "precision", "recall", "f1"))


@register("confusion_orders", "EVL-3", f"""
SELECT label, prediction, CAST(COUNT(*) AS BIGINT) AS count FROM {ORD_PRED_SQL} GROUP BY ALL""")
def confusion_orders(spark, sf):
    return M.confusion_cells(ord_pred(spark, sf)).select("label", "prediction",
                                                        F.col("count").cast("long").alias("count"))


@register("confusion_matrix_orders", "EVL-3", f"""
SELECT label, """ + ", ".join(
    f"CAST(SUM(CASE WHEN prediction = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{v}\"" for v in _PRIO) +
    f" FROM {ORD_PRED_SQL} GROUP BY label")
def confusion_matrix_orders(spark, sf):
    m = M.confusion_matrix(ord_pred(spark, sf), _PRIO)
    return m.select("label", *[F.col(f"`{v}`").cast("long").alias(v) for v in _PRIO])


def _roc_sql(src, label="label"):
    return f"""
WITH g AS (SELECT CAST(score AS DOUBLE) AS threshold, SUM(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos,
                  SUM(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY 1),
c AS (SELECT *, SUM(pos) OVER (ORDER BY threshold DESC) AS cp, SUM(neg) OVER (ORDER BY threshold DESC) AS cn,
             SUM(pos) OVER () AS pp, SUM(neg) OVER () AS nn FROM g)"""


@register("roc_documents", "EVL-4", _roc_sql(DOC_PRED_SQL) + f"""
SELECT threshold, {r4('cn / nn')} AS fpr, {r4('cp / pp')} AS tpr FROM c
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_documents(spark, sf):
    r = M.roc_points(doc_pred(spark, sf))
    return r.select("threshold", fr4("fpr").alias("fpr"), fr4("tpr").alias("tpr"))


@register("auc_documents", "EVL-5", f"""
SELECT {r4('a.auc')} AS auc_quality, {r4('b.auc')} AS auc_toxic FROM
({_roc_sql(DOC_PRED_SQL)} SELECT SUM(neg * (cp - pos + pos / 2.0)) / (ANY_VALUE(pp) * ANY_VALUE(nn)) AS auc FROM c) a,
({_roc_sql(DOC_PRED_SQL, 'toxic')} SELECT SUM(neg * (cp - pos + pos / 2.0)) / (ANY_VALUE(pp) * ANY_VALUE(nn)) AS auc FROM c) b""")
def auc_documents(spark, sf):
    p = doc_pred(spark, sf)
    from ..functions.frames import attach_scalars
    a = M.auc(p).select(F.col("auc").alias("auc_quality"))
    b = M.auc(p.withColumn("label", F.col("toxic"))).select(F.col("auc").alias("auc_toxic"))
    return attach_scalars(a, b).select(fr4("auc_quality").alias("auc_quality"),
                                       fr4("auc_toxic").alias("auc_toxic"))


@register("best_threshold_documents", "EVL-6 REG-7 CLU-3", """
WITH p AS (SELECT t.m AS model, l.quality AS label, CASE WHEN d.n_chars > t.m THEN 1 ELSE 0 END AS prediction
           FROM documents d JOIN labels l USING (doc_id), (SELECT UNNEST([500, 1000, 2000, 5000, 10000]) AS m) t),
s AS (SELECT model, SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
             SUM(prediction) AS np, SUM(label) AS nt FROM p GROUP BY model),
f AS (SELECT model, CASE WHEN np + nt > 0 THEN 2.0 * tp / (np + nt) ELSE 0 END AS f1 FROM s)
SELECT CAST(model AS BIGINT) AS model, ROUND(f1, 4) + 0.0 AS f1 FROM f ORDER BY f1 DESC, model LIMIT 1""")
def best_threshold_documents(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    grid = F.explode(F.array(*[F.lit(m) for m in (500, 1000, 2000, 5000, 10000)])).alias("model")
    p = d.select(F.col("quality").alias("label"), "n_chars", grid) \
         .select(F.col("model").cast("long").alias("model"), "label",
                 (F.col("n_chars") > F.col("model")).cast("int").alias("prediction"))
    f = M.prf(p, ["model"], "binary").select("model", fr4("f1").alias("f1"))
    return M.best_row(f, "f1", "model")


@register("regression_metrics_lineitem", "REG-10", f"""
SELECT {r4('1 - SUM(POWER(y - p, 2)) / (VAR_POP(y) * COUNT(*))')} AS r2, {r4('SQRT(AVG(POWER(y - p, 2)))')} AS rmse,
       {r4('AVG(ABS(y - p))')} AS mae
FROM (SELECT l_extendedprice * (1 - l_discount) AS y, l_extendedprice * 0.95 AS p FROM lineitem)""")
def regression_metrics_lineitem(spark, sf):
    li = t(spark, sf, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("label"),
                                         (F.col("l_extendedprice") * 0.95).alias("prediction"))
    return _rm(M.regression_metrics(li).select("r2", "rmse", "mae"))


@register("davies_bouldin_lineitem", "CLU-6 CLU-7 AGG-14", """
WITH p AS (SELECT l_linenumber % 3 AS cluster, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem),
c AS (SELECT cluster, AVG(a) AS ca, AVG(b) AS cb FROM p GROUP BY cluster),
s AS (SELECT p.cluster, AVG(SQRT(POWER(a - ca, 2) + POWER(b - cb, 2))) AS s FROM p JOIN c USING (cluster) GROUP BY p.cluster),
x AS (SELECT c.*, s.s FROM c JOIN s USING (cluster)),
r AS (SELECT i.cluster, MAX((i.s + j.s) / SQRT(POWER(i.ca - j.ca, 2) + POWER(i.cb - j.cb, 2))) AS m
      FROM x i JOIN x j ON i.cluster <> j.cluster GROUP BY i.cluster)
SELECT ROUND(AVG(m), 4) + 0.0 AS davies_bouldin FROM r""")
def davies_bouldin_lineitem(spark, sf):
    li = t(spark, sf, "lineitem").select((F.col("l_linenumber") % 3).alias("cluster"),
                                         F.col("l_quantity").alias("a"),
                                         (F.col("l_extendedprice") / 1000).alias("b"))
    return M.davies_bouldin(li, ["a", "b"]).select(fr4("davies_bouldin").alias("davies_bouldin"))


@register("cluster_profile_lineitem", "CLU-7 AGG-14", """
SELECT CAST(l_linenumber % 3 AS INTEGER) AS cluster, CAST(COUNT(*) AS BIGINT) AS size,
       ROUND(AVG(l_quantity), 3) + 0.0 AS l_quantity_mean, ROUND(STDDEV_SAMP(l_quantity), 3) + 0.0 AS l_quantity_std,
       ROUND(AVG(l_extendedprice), 3) + 0.0 AS l_extendedprice_mean,
       ROUND(STDDEV_SAMP(l_extendedprice), 3) + 0.0 AS l_extendedprice_std
FROM lineitem GROUP BY 1""")
def cluster_profile_lineitem(spark, sf):
    from ..operators.cluster import cluster_profiles
    li = t(spark, sf, "lineitem").withColumn("cluster", (F.col("l_linenumber") % 3).cast("int"))
    return cluster_profiles(li, ["l_quantity", "l_extendedprice"])

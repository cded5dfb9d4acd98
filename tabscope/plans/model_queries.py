"""Registered queries: regression, classification, k-NN, clustering, features, auto-ML.

Model fits with a closed form (OLS with one predictor, penalised
one-predictor fits, exact k-NN, two-column PCA) carry a DuckDB oracle; tree
ensembles and iterative fits are rows-only; the comparisons of classifiers use
small sizes here (the reference sizes are the function defaults).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import r4 as fr4
from ..operators import automl as A
from ..operators import classify as C
from ..operators import cluster as K
from ..operators import features as X
from ..operators import regress as G
from ..operators import split as S
from .registry import register, t
from .sqlgen import r4


# ---------------------------------------------------------------- REG-1, 2
def _ols1_sql(src, y, x):
    return f"""
WITH d AS (SELECT CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x FROM {src} WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
s AS (SELECT COUNT(*) AS n, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, AVG(x) AS mx,
             REGR_SXX(y, x) AS sxx, REGR_SYY(y, x) AS syy, REGR_SXY(y, x) AS sxy FROM d),
e AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s)"""


def _ols_coef_q(tbl, y, xs):
    def q(spark, sf):
        coefs, _ = G.ols(t(spark, sf, tbl), y, xs)
        return coefs.select("term", fr4("coef").alias("coef"), fr4("std_err").alias("std_err"),
                            fr4("t_value").alias("t_value"))
    return q


register("ols_coef_part", "REG-1", _ols1_sql("part", "p_retailprice", "p_partkey") + f"""
SELECT 'const' AS term, {r4('a')} AS coef, {r4('SQRT(s2 * (1.0 / n + mx * mx / sxx))')} AS std_err,
       {r4('a / SQRT(s2 * (1.0 / n + mx * mx / sxx))')} AS t_value FROM e
UNION ALL
SELECT 'p_partkey', {r4('b')}, {r4('SQRT(s2 / sxx)')}, {r4('b / SQRT(s2 / sxx)')} FROM e""")(
    _ols_coef_q("part", "p_retailprice", ["p_partkey"]))


@register("ols_stats_part", "REG-2 REG-4", _ols1_sql("part", "p_retailprice", "p_partkey") + f""",
f AS (SELECT *, 1 - (syy - b * sxy) / syy AS r2, syy - b * sxy AS sse FROM e)
SELECT CAST(n AS BIGINT) AS n, CAST(1 AS BIGINT) AS df_model, CAST(n - 2 AS BIGINT) AS df_resid,
       {r4('r2')} AS r2, {r4('1 - (1 - r2) * (n - 1) / (n - 2)')} AS adj_r2,
       {r4('r2 / ((1 - r2) / (n - 2))')} AS f_stat,
       {r4('-n / 2.0 * (LN(2 * PI()) + LN(sse / n) + 1)')} AS log_likelihood,
       {r4('n * (LN(2 * PI()) + LN(sse / n) + 1) + 4')} AS aic FROM f""")
def ols_stats_part(spark, sf):
    _, st = G.ols(t(spark, sf, "part"), "p_retailprice", ["p_partkey"])
    return st.select("n", "df_model", "df_resid", *[fr4(c).alias(c) for c in
                                                     ("r2", "adj_r2", "f_stat", "log_likelihood", "aic")])


COLLINEAR_SQL = "(SELECT l_extendedprice, l_quantity, l_quantity * 2 AS l_quantity2 FROM lineitem)"


@register("ols_collinear_lineitem", "REG-1 FLT-1", _ols1_sql("lineitem", "l_extendedprice", "l_quantity") + f"""
SELECT 'const' AS term, {r4('a')} AS coef, {r4('SQRT(s2 * (1.0 / n + mx * mx / sxx))')} AS std_err,
       {r4('a / SQRT(s2 * (1.0 / n + mx * mx / sxx))')} AS t_value FROM e
UNION ALL SELECT 'l_quantity', {r4('b')}, {r4('SQRT(s2 / sxx)')}, {r4('b / SQRT(s2 / sxx)')} FROM e
UNION ALL SELECT 'l_quantity2', NULL, NULL, NULL""")
def ols_collinear_lineitem(spark, sf):
    li = t(spark, sf, "lineitem").select("l_extendedprice", "l_quantity",
                                         (F.col("l_quantity") * 2).alias("l_quantity2"))
    coefs, _ = G.ols(li, "l_extendedprice", ["l_quantity", "l_quantity2"])
    return coefs.select("term", fr4("coef").alias("coef"), fr4("std_err").alias("std_err"),
                        fr4("t_value").alias("t_value"))


@register("ols_pvalues_part", "REG-1 REG-5 HYP-10")
def ols_pvalues_part(spark, sf):
    coefs, _ = G.ols(t(spark, sf, "part"), "p_retailprice", ["p_partkey", "p_size"])
    return G.significant_predictors(coefs).select("term", fr4("p_value").alias("p_value"),
                                                  fr4("ci_low").alias("ci_low"), fr4("ci_high").alias("ci_high"))


# ---------------------------------------------------------------- REG-3, 4
@register("residuals_part", "REG-3", _ols1_sql("part", "p_retailprice", "p_partkey") + f"""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {r4('a + b * p_partkey')} AS fitted,
       {r4('p_retailprice - (a + b * p_partkey)')} AS residual FROM part, e""")
def residuals_part(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice")
    rows, _ = G.residual_diagnostics(p, "p_retailprice", ["p_partkey"])
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), fr4("fitted").alias("fitted"),
                       fr4("residual").alias("residual"))


@register("residual_stats_part", "REG-3 REG-4", _ols1_sql("part", "p_retailprice", "p_partkey") + f""",
r AS (SELECT p_partkey, p_retailprice - (a + b * p_partkey) AS e FROM part, e),
m AS (SELECT COUNT(*) AS n, AVG(e) AS mu FROM r),
c AS (SELECT AVG(POWER(e - mu, 2)) AS m2, AVG(POWER(e - mu, 3)) AS m3, AVG(POWER(e - mu, 4)) AS m4 FROM r, m),
dw AS (SELECT SUM(POWER(e - pe, 2)) AS num FROM (SELECT e, LAG(e) OVER (ORDER BY p_partkey) AS pe FROM r)),
ss AS (SELECT SUM(e * e) AS den FROM r)
SELECT CAST(n AS BIGINT) AS n, {r4('m3 / POWER(m2, 1.5)')} AS skew, {r4('m4 / (m2 * m2)')} AS kurtosis,
       {r4('n / 6.0 * (POWER(m3 / POWER(m2, 1.5), 2) + POWER(m4 / (m2 * m2) - 3, 2) / 4)')} AS jarque_bera,
       {r4('num / den')} AS durbin_watson FROM m, c, dw, ss""")
def residual_stats_part(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice")
    _, st = G.residual_diagnostics(p, "p_retailprice", ["p_partkey"], order="p_partkey")
    return st.select(F.col("n").cast("long").alias("n"),
                     *[fr4(c).alias(c) for c in ("skew", "kurtosis", "jarque_bera", "durbin_watson")])


@register("residual_histogram_part", "REG-3 CHT-1")
def residual_histogram_part(spark, sf):
    from ..operators.charts import histogram
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice")
    rows, _ = G.residual_diagnostics(p, "p_retailprice", ["p_partkey"])
    return histogram(rows, ["residual", "scale_location"], bins=20)


# ---------------------------------------------------------------- REG-9 (one predictor, closed form)
def _pen_sql(kind, alpha, rho=0.5):
    base = """
WITH d AS (SELECT CAST(p_retailprice AS DOUBLE) AS y, CAST(p_partkey AS DOUBLE) / 1000 AS x FROM part),
s AS (SELECT COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, REGR_SXX(y, x) AS sxx, REGR_SXY(y, x) AS sxy FROM d)"""
    if kind == "ridge":
        b = f"sxy / (sxx + {alpha})"
    else:
        l1, l2 = (alpha, 0.0) if kind == "lasso" else (alpha * rho, alpha * (1 - rho))
        b = (f"SIGN(sxy / n) * GREATEST(ABS(sxy / n) - {l1}, 0) / (sxx / n + {l2})")
    return base + f"""
SELECT {r4(f'my - ({b}) * mx', 3)} AS intercept, {r4(b, 3)} AS coef FROM s"""


def _pen_q(kind, alpha):
    def q(spark, sf):
        from pyspark.ml.feature import VectorAssembler
        d = t(spark, sf, "part").select(F.col("p_retailprice").cast("double").alias("label"),
                                        (F.col("p_partkey") / 1000).alias("x"))
        n = d.count()
        sig = d.agg(F.stddev_pop("label")).first()[0]
        name = {"ridge": "Ridge", "lasso": "Lasso", "elasticnet": "ElasticNet"}[kind]
        est = G.regression_estimators([name], n, sig)[name]
        m = est.fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(d))
        return spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))],
                                     "intercept double, coef double") \
            .select(fr4("intercept", 3).alias("intercept"), fr4("coef", 3).alias("coef"))
    return q


register("ridge_part", "REG-9", _pen_sql("ridge", 1.0))(_pen_q("ridge", 1.0))
register("lasso_part", "REG-9", _pen_sql("lasso", 0.1))(_pen_q("lasso", 0.1))
register("elasticnet_part", "REG-9", _pen_sql("elasticnet", 0.1))(_pen_q("elasticnet", 0.1))


# ---------------------------------------------------------------- REG-6, 8 (rows only)
@register("compare_regressors_part", "REG-6 REG-7 REG-8")
def compare_regressors_part(spark, sf):
    """Default sizes; a model without a result is an error, not a row of nulls."""
    cmp, _ = G.compare_regressors(t(spark, sf, "part"), "p_retailprice", ["p_partkey", "p_size"], ["p_partkey"])
    return G.all_fitted(cmp).select("model", fr4("r2").alias("r2"), fr4("cv_r2_mean").alias("cv_r2_mean"))


@register("regression_importance_part", "REG-8 CHT-6")
def regression_importance_part(spark, sf):
    """Default sizes; a model without a result is an error, not a sum over fewer models."""
    from ..operators.charts import importance_bars
    cmp, imp = G.compare_regressors(t(spark, sf, "part"), "p_retailprice", ["p_partkey", "p_size"], ["p_partkey"])
    G.all_fitted(cmp)
    return importance_bars(imp)


# ---------------------------------------------------------------- CLS (rows only)
def _docs(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id") \
        .select("doc_id", "n_chars", "lang", "source", F.col("quality").cast("string").alias("quality"))


@register("compare_classifiers_documents", "CLS-1 CLS-2 CLS-3 CLS-4 CLS-5 CLS-6 CLS-9 CV-3 CV-5 EVL-1 EVL-2 EVL-4 EVL-5 EVL-6")
def compare_classifiers_documents(spark, sf):
    out = C.compare_classifiers(_docs(spark, sf), "quality", ["n_chars"], ["lang", "source"], ["doc_id"],
                                trees=10, boost_iter=5, max_iter=30)
    return out["comparison"].select("model", fr4("accuracy").alias("accuracy"), fr4("f1_score").alias("f1_score"),
                                    fr4("cv_mean").alias("cv_mean"), fr4("auc").alias("auc"))


@register("classifier_importance_documents", "EVL-7")
def classifier_importance_documents(spark, sf):
    out = C.compare_classifiers(_docs(spark, sf), "quality", ["n_chars"], ["lang", "source"], ["doc_id"],
                                trees=10, boost_iter=5, max_iter=30)
    return out["importance"].select("model", "feature", "rank")


@register("margin_classifier_documents", "CLS-8 CV-5")
def margin_classifier_documents(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from ..operators import metrics as M
    from ..operators import prep as P
    x, names = P.feature_frame(_docs(spark, sf), "quality", ["n_chars"], ["lang", "source"], standardize=True,
                               keep=["doc_id"])
    lab, _ = P.encode_labels(x, "quality")
    sp = S.train_test_split(lab, ["doc_id"], 0.2, 42, F.col("label"))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(sp)
    train = data.where(~F.col("is_test"))
    m = C.classifier("SVM", train.count(), 2).fit(train)
    return M.binary_metrics(m.transform(data.where(F.col("is_test")))).select(
        fr4("accuracy").alias("accuracy"), fr4("f1").alias("f1"))


@register("compare_classifiers_embeddings", "CLS-6 CLS-9 EVL-3")
def compare_classifiers_embeddings(spark, sf):
    e = t(spark, sf, "embeddings")
    e = e.select("vec_id", F.col("label").cast("string").alias("label_s"),
                 *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    out = C.compare_classifiers(e, "label_s", [f"e{i}" for i in range(8)], [], ["vec_id"],
                                models=["Logistic Regression", "Gradient Boosting"], boost_iter=2, max_iter=30)
    return out["confusion"]


# ---------------------------------------------------------------- KNN-1, CLS-7, REG-11 (exact, with oracle)
def _knn_sql(task):
    h = "md5('42|' || CAST(p_partkey AS VARCHAR))"
    agg = ("AVG(y)" if task == "regression" else "y")
    pred = f"""
WITH d AS (SELECT p_partkey AS id, p_retailprice / 100 AS f1, p_partkey / 100.0 AS f2, CAST(p_size AS DOUBLE) AS y,
                  ROW_NUMBER() OVER (ORDER BY {h}) - 1 AS i, COUNT(*) OVER () AS n FROM part),
s AS (SELECT *, i < CEIL(CAST(0.2 AS DOUBLE) * n) AS is_test FROM d),
nb AS (SELECT q.id, r.y, ROW_NUMBER() OVER (PARTITION BY q.id ORDER BY SQRT(POWER(q.f1 - r.f1, 2) + POWER(q.f2 - r.f2, 2)), r.y) AS rk
       FROM s q JOIN s r ON q.is_test AND NOT r.is_test),
k AS (SELECT id, y FROM nb WHERE rk <= 5)"""
    if task == "regression":
        return pred + f"\nSELECT CAST(id AS BIGINT) AS p_partkey, {r4(agg)} AS prediction FROM k GROUP BY id"
    return pred + """,
v AS (SELECT id, y, COUNT(*) AS c FROM k GROUP BY id, y)
SELECT CAST(id AS BIGINT) AS p_partkey, y AS prediction FROM v
QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY c DESC, y) = 1"""


def _knn_q(task):
    def q(spark, sf):
        p = t(spark, sf, "part").select(F.col("p_partkey"), (F.col("p_retailprice") / 100).alias("f1"),
                                        (F.col("p_partkey") / 100.0).alias("f2"),
                                        F.col("p_size").cast("double").alias("label"))
        s = S.train_test_split(p, ["p_partkey"])
        pred = C.knn_predict(s.where(~F.col("is_test")), s.where(F.col("is_test")), ["f1", "f2"], "p_partkey",
                             5, task)
        return pred.select(F.col("p_partkey").cast("long").alias("p_partkey"),
                           fr4("prediction").alias("prediction"))
    return q


_TIES_SQL = f"""
WITH d AS (SELECT p_partkey AS id, CAST(p_size // 10 AS DOUBLE) AS f, CAST(p_retailprice AS DOUBLE) AS y, p_partkey % 5 = 0 AS is_test FROM part),
nb AS (SELECT q.id, r.y, ROW_NUMBER() OVER (PARTITION BY q.id ORDER BY ABS(q.f - r.f), r.y) AS rk FROM d q JOIN d r ON q.is_test AND NOT r.is_test)
SELECT CAST(id AS BIGINT) AS p_partkey, {r4('AVG(y)')} AS prediction FROM nb WHERE rk <= 5 GROUP BY id"""


@register("knn_ties_part", "KNN-1 REG-11", _TIES_SQL)
def knn_ties_part(spark, sf):
    """Hundreds of training rows at distance 0: the five smallest labels among them count."""
    p = t(spark, sf, "part").select("p_partkey", F.floor(F.col("p_size") / 10).cast("double").alias("f"), F.col("p_retailprice").alias("label"))
    test = F.col("p_partkey") % 5 == 0
    pred = C.knn_predict(p.where(~test), p.where(test), ["f"], "p_partkey", 5, "regression")
    return pred.select(F.col("p_partkey").cast("long").alias("p_partkey"), fr4("prediction").alias("prediction"))


@register("feature_frame_part", "CLS-1 FLT-4", """
WITH l AS (SELECT lv, ROW_NUMBER() OVER (ORDER BY lv) AS i FROM (SELECT DISTINCT p_brand AS lv FROM part)),
t AS (SELECT lv, ROW_NUMBER() OVER (ORDER BY lv) AS i FROM (SELECT DISTINCT p_type AS lv FROM part))
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'p_brand_' || lv AS feature, CAST(p_brand = lv AS DOUBLE) AS value FROM part, l WHERE i > 1
UNION ALL SELECT p_partkey, 'p_type_' || lv, CAST(p_type = lv AS DOUBLE) FROM part, t WHERE i > 1
UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE) FROM part""")
def feature_frame_part(spark, sf):
    """Every level of a column with more than 15 levels has its feature."""
    from ..functions.frames import col
    from ..operators.prep import feature_frame
    x, names = feature_frame(t(spark, sf, "part"), "p_retailprice", ["p_size"], ["p_brand", "p_type"], keep=["p_partkey"])
    return x.select(F.col("p_partkey").cast("long").alias("p_partkey"), *[col(c) for c in names]) \
        .unpivot(["p_partkey"], [col(c) for c in names], "feature", "value")


register("knn_regressor_part", "KNN-1 REG-11", _knn_sql("regression"))(_knn_q("regression"))
register("knn_classifier_part", "KNN-1 CLS-7", _knn_sql("classification"))(_knn_q("classification"))


# ---------------------------------------------------------------- CLU
@register("cluster_scores_lineitem", "CLU-1 CLU-2 CLU-3 CLU-4 CHT-7")
def cluster_scores_lineitem(spark, sf):
    """Default sizes: k 2 to 10, ten restarts each."""
    res = K.cluster_analysis(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return res["scores"].select("k", F.round("inertia", 2).alias("inertia"), fr4("silhouette").alias("silhouette"))


_CENTRES = {2: [[-1.0, 0.5], [1.0, -0.5]], 3: [[-1.0, -1.0], [0.0, 1.0], [1.2, 0.1]], 4: [[-1.0, -1.0], [-1.0, 1.0], [1.0, -1.0], [1.0, 1.0]]}


def _centre_sql():
    cs = ", ".join(f"({k}, {j}, {a}, {b})" for k, c in _CENTRES.items() for j, (a, b) in enumerate(c))
    return f"""
WITH z AS (SELECT s_suppkey AS id, (s_nationkey - AVG(s_nationkey) OVER ()) / STDDEV_POP(s_nationkey) OVER () AS x,
             (s_acctbal - AVG(s_acctbal) OVER ()) / STDDEV_POP(s_acctbal) OVER () AS y FROM supplier),
c AS (SELECT * FROM (VALUES {cs}) v(k, j, a, b)),
a AS (SELECT k, id, x, y, j, POWER(x - a, 2) + POWER(y - b, 2) AS d,
        ROW_NUMBER() OVER (PARTITION BY k, id ORDER BY POWER(x - a, 2) + POWER(y - b, 2), j) AS r FROM z, c),
m AS (SELECT k, id, x, y, j, d FROM a WHERE r = 1),
p AS (SELECT m.k, m.id, m.j AS own, o.j AS other, SUM(POWER(m.x - o.x, 2) + POWER(m.y - o.y, 2)) AS s, COUNT(*) AS n
      FROM m JOIN m o USING (k) GROUP BY ALL),
s AS (SELECT k, id, MAX(CASE WHEN own = other THEN s / GREATEST(n - 1, 1) END) AS ina, MAX(CASE WHEN own = other THEN n END) AS size,
        MIN(CASE WHEN own <> other THEN s / n END) AS out FROM p GROUP BY k, id)
SELECT CAST(s.k AS INTEGER) AS k, {r4('MAX(i.inertia)')} AS inertia,
  {r4('AVG(CASE WHEN size > 1 THEN (out - ina) / GREATEST(out, ina) ELSE 0 END)')} AS silhouette
FROM s JOIN (SELECT k, SUM(d) AS inertia FROM m GROUP BY k) i USING (k) GROUP BY s.k"""


@register("centre_scores_supplier", "CLU-1 CLU-2 CLU-4", _centre_sql())
def centre_scores_supplier(spark, sf):
    """Inertia and silhouette of given centres, against all pairs of rows."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    data, _ = K.prepare(t(spark, sf, "supplier"), ["s_nationkey", "s_acctbal"])
    got = K.centre_scores(data.select(vector_to_array("features").alias("x")), {k: np.array(c) for k, c in _CENTRES.items()})
    return got.select("k", fr4("inertia").alias("inertia"), fr4("silhouette").alias("silhouette"))


@register("cluster_summary_embeddings", "CLU-5 CLU-6 CLU-7 CLU-8")
def cluster_summary_embeddings(spark, sf):
    e = t(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    res = K.cluster_analysis(e, [f"e{i}" for i in range(64)], method="bisecting")
    return res["summary"].select("best_k", "method")


@register("pca_ratio_part", "CLU-5", """
SELECT ROUND((1 + ABS(CORR(p_partkey, p_retailprice))) / 2, 4) + 0.0 AS pc1_ratio,
       ROUND((1 - ABS(CORR(p_partkey, p_retailprice))) / 2, 4) + 0.0 AS pc2_ratio FROM part""")
def pca_ratio_part(spark, sf):
    data, _ = K.prepare(t(spark, sf, "part"), ["p_partkey", "p_retailprice"])
    _, ratio = K.pca(data, 2)
    return spark.createDataFrame([tuple(ratio)], "pc1_ratio double, pc2_ratio double") \
        .select(fr4("pc1_ratio").alias("pc1_ratio"), fr4("pc2_ratio").alias("pc2_ratio"))


# ---------------------------------------------------------------- FEA
@register("target_correlation_lineitem", "FEA-3", f"""
WITH r AS (SELECT 'l_extendedprice' AS feature, CORR(l_extendedprice, y) AS c FROM (SELECT *, l_extendedprice * (1 - l_discount) AS y FROM lineitem)
  UNION ALL SELECT 'l_quantity', CORR(l_quantity, y) FROM (SELECT *, l_extendedprice * (1 - l_discount) AS y FROM lineitem)
  UNION ALL SELECT 'l_discount', CORR(l_discount, y) FROM (SELECT *, l_extendedprice * (1 - l_discount) AS y FROM lineitem)
  UNION ALL SELECT 'l_tax', CORR(l_tax, y) FROM (SELECT *, l_extendedprice * (1 - l_discount) AS y FROM lineitem))
SELECT CAST(ROW_NUMBER() OVER (ORDER BY ABS(c) DESC, feature) AS INTEGER) AS rank, feature, {r4('c')} AS correlation FROM r""")
def target_correlation_lineitem(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("y", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    tc = X.target_correlation(li, "y", ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    return tc.select("rank", "feature", fr4("correlation").alias("correlation"))


def _mi_sql():
    cols = ["o_totalprice", "o_custkey"]
    parts = []
    for c in cols:
        e = f"(SELECT list_distinct(quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) FROM orders)"
        parts.append(f"SELECT '{c}' AS feature, len(list_filter({e}, lambda z: {c} > z)) AS x, "
                     f"o_orderpriority AS y FROM orders WHERE {c} IS NOT NULL AND o_orderpriority IS NOT NULL")
    u = "\nUNION ALL\n".join(parts)
    return f"""
WITH c AS (SELECT feature, x, y, COUNT(*) AS nxy FROM ({u}) GROUP BY ALL),
w AS (SELECT *, SUM(nxy) OVER (PARTITION BY feature) AS n, SUM(nxy) OVER (PARTITION BY feature, x) AS nx,
             SUM(nxy) OVER (PARTITION BY feature, y) AS ny FROM c),
m AS (SELECT feature, SUM(nxy / n * LN(nxy * n / (nx * ny))) AS mi FROM w GROUP BY feature)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank, feature, {r4('mi')} AS mutual_info FROM m"""


@register("mutual_info_orders", "FEA-2", _mi_sql())
def mutual_info_orders(spark, sf):
    mi = X.mutual_information(t(spark, sf, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"], "o_orderkey")
    return mi.select("rank", "feature", fr4("mutual_info").alias("mutual_info"))


@register("rf_importance_part", "FEA-1")
def rf_importance_part(spark, sf):
    return X.rf_importance(t(spark, sf, "part"), "p_retailprice", ["p_partkey", "p_size"], ["p_brand", "p_type"]).select("rank", "feature")


# ---------------------------------------------------------------- AML
@register("detect_task_tables", "AML-1", """
SELECT 'labels.quality' AS target, 'binary_classification' AS task
UNION ALL SELECT 'embeddings.label', CASE WHEN (SELECT COUNT(DISTINCT label) FROM embeddings) <= 20
                                          THEN 'multiclass_classification' ELSE 'regression' END
UNION ALL SELECT 'orders.o_orderpriority', 'multiclass_classification'
UNION ALL SELECT 'part.p_retailprice', CASE WHEN (SELECT COUNT(DISTINCT p_retailprice) FROM part) <= 20
                                            THEN 'multiclass_classification' ELSE 'regression' END""")
def detect_task_tables(spark, sf):
    rows = [("labels.quality", A.detect_task(t(spark, sf, "labels"), "quality")),
            ("embeddings.label", A.detect_task(t(spark, sf, "embeddings"), "label")),
            ("orders.o_orderpriority", A.detect_task(t(spark, sf, "orders"), "o_orderpriority")),
            ("part.p_retailprice", A.detect_task(t(spark, sf, "part"), "p_retailprice"))]
    return spark.createDataFrame(rows, "target string, task string")


@register("auto_ml_documents", "AML-2 AML-3 AML-4 AML-5 AML-6 AML-7")
def auto_ml_documents(spark, sf):
    """Default sizes; a model without a result is an error, not a row of nulls."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    res = A.auto_analyze(d.select("doc_id", "n_chars", "lang", "quality"), "quality", ["n_chars"], ["lang"],
                         "doc_id")
    return G.all_fitted(res["leaderboard"]).select("model", fr4("f1_score").alias("f1_score"), fr4("cv_mean").alias("cv_mean"))


VOTES_SQL = "SELECT o_orderkey AS k, CAST(o_orderkey % 3 AS DOUBLE) AS a, CAST(o_custkey % 3 AS DOUBLE) AS b, CAST(length(o_orderpriority) % 3 AS DOUBLE) AS c FROM orders"


def _votes(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).cast("double").alias("a"),
                                         (F.col("o_custkey") % 3).cast("double").alias("b"),
                                         (F.length("o_orderpriority") % 3).cast("double").alias("c"))


def _vote_q(task, score):
    def q(spark, sf):
        v = _votes(spark, sf)
        preds = [v.select("k", F.col(c).alias("prediction"), *([(F.col(c) / 2).alias("score")] if score else [])) for c in "abc"]
        return A.vote(preds, "k", task).select("k", fr4("prediction").alias("prediction"))
    return q


# voting on three fixed prediction columns: majority (ties to the smallest), mean, mean probability over a half
register("vote_hard_orders", "AML-6", f"""
WITH v AS ({VOTES_SQL}), u AS (SELECT k, a AS p FROM v UNION ALL SELECT k, b FROM v UNION ALL SELECT k, c FROM v),
n AS (SELECT k, p, COUNT(*) AS n FROM u GROUP BY ALL)
SELECT k, p AS prediction FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY n DESC, p) = 1""")(
    _vote_q("multiclass_classification", False))
register("vote_mean_orders", "AML-6", f"SELECT k, {r4('(a + b + c) / 3')} AS prediction FROM ({VOTES_SQL})")(_vote_q("regression", False))
register("vote_soft_orders", "AML-6", f"SELECT k, CAST((a / 2 + b / 2 + c / 2) / 3 > 0.5 AS DOUBLE) AS prediction FROM ({VOTES_SQL})")(
    _vote_q("binary_classification", True))


@register("auto_ml_part", "AML-3 AML-4 AML-6 REG-9 REG-11")
def auto_ml_part(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    res = A.auto_analyze(p, "p_retailprice", ["p_partkey", "p_size"], ["p_type"], "p_partkey",
                         models=["Linear Regression", "Ridge", "KNN"])
    return res["summary"].select("task", "n_rows", "ensemble_models")

"""Regression (REG-1..11).

OLS is solved from one aggregate of co-moments (``avg`` and ``covar_samp``
for every pair, Spark's numerically stable merge), so the driver only sees a
p x p matrix; the table is scanned once for the fit and once for the
residual statistics.  Model comparison uses MLlib estimators on a cached
feature frame, with folds from ``split.kfold``.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, together
from ..functions.distributions import betainc, f_sf, t_sf2
from ..functions.frames import spread
from .split import kfold

COEF_SCHEMA = ("term string, coef double, std_err double, t_value double, p_value double, "
               "ci_low double, ci_high double, significant boolean")


def t_ppf(q: float, df: float) -> float:
    """Quantile of Student's t by bisection on the incomplete beta (q > .5)."""
    lo, hi = 0.0, 1e3
    target = 2 * (1 - q)
    for _ in range(200):
        mid = (lo + hi) / 2
        if betainc(df / 2, 0.5, df / (df + mid * mid)) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _moments(df: DataFrame, y: str, xs: list[str]):
    cols = [y] + xs
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.covar_samp(cols[i], cols[j]).alias(f"c_{i}_{j}"))
    r = df.agg(*aggs).first()
    k = len(cols)
    n = int(r["n"])
    mean = np.array([r[f"m_{i}"] or 0.0 for i in range(k)])
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = r[f"c_{i}_{j}"] or 0.0
    return n, mean, cov


def independent_columns(cov: np.ndarray, names: list[str], tol: float = 1e-10) -> list[int]:
    """Greedy rank check on the predictor covariance: keep a column only if it
    adds rank (a collinear column would make the p-values meaningless)."""
    keep: list[int] = []
    scale = np.sqrt(np.clip(np.diag(cov), 0, None))
    for j in range(len(names)):
        if scale[j] == 0:
            continue
        trial = keep + [j]
        sub = cov[np.ix_(trial, trial)] / np.outer(scale[trial], scale[trial])
        if np.linalg.matrix_rank(sub, tol=tol) == len(trial):
            keep = trial
    return keep


def ols(df: DataFrame, y: str, xs: list[str], alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """REG-1, 2, 4: ``(coefficients, model_stats)`` on complete cases.

    Needs ``n >= p + 10``; otherwise both frames are empty.  Dependent
    predictors are dropped before solving (reported with null estimates).
    """
    spark = df.sparkSession
    d = df.select(F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in xs]).na.drop()
    n, mean, cov = _moments(d, y, xs)
    empty = (spark.createDataFrame([], COEF_SCHEMA), spark.createDataFrame([], STATS_SCHEMA))
    if n < len(xs) + 10 or n < 3:
        return empty
    sxx = cov[1:, 1:] * (n - 1)
    sxy = cov[1:, 0] * (n - 1)
    syy = cov[0, 0] * (n - 1)
    keep = independent_columns(cov[1:, 1:], xs)
    p = len(keep)
    b = np.zeros(len(xs))
    inv = np.zeros((len(xs), len(xs)))
    if p:
        sk = sxx[np.ix_(keep, keep)]
        ik = np.linalg.inv(sk)
        b[keep] = ik @ sxy[keep]
        inv[np.ix_(keep, keep)] = ik
    xbar = mean[1:]
    b0 = mean[0] - float(b @ xbar)
    sse = max(syy - float(b[keep] @ sxy[keep]) if p else syy, 0.0)
    dfr = n - p - 1
    s2 = sse / dfr
    se = np.sqrt(np.clip(np.diag(inv) * s2, 0, None))
    se0 = math.sqrt(s2 * (1.0 / n + float(xbar[keep] @ inv[np.ix_(keep, keep)] @ xbar[keep]))) if p \
        else math.sqrt(s2 / n)
    tq = t_ppf(1 - alpha / 2, dfr)
    rows = []
    for term, coef, err, ok in [("const", b0, se0, True)] + \
            [(c, b[i], se[i], i in keep) for i, c in enumerate(xs)]:
        if not ok:
            rows.append((term, None, None, None, None, None, None, None))
            continue
        tv = coef / err if err > 0 else float("inf")
        pv = float(t_sf2(tv, dfr)) if err > 0 else 0.0
        rows.append((term, float(coef), float(err), float(tv), pv, float(coef - tq * err),
                     float(coef + tq * err), pv < alpha))
    r2 = 1 - sse / syy if syy > 0 else 0.0
    adj = 1 - (1 - r2) * (n - 1) / dfr
    fst = (r2 / p) / ((1 - r2) / dfr) if p and r2 < 1 else float("inf")
    fp = float(f_sf(fst, p, dfr)) if p else None
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1) if sse > 0 else float("inf")
    aic = -2 * llf + 2 * (p + 1)
    bic = -2 * llf + math.log(n) * (p + 1)
    # condition number of the design with constant (uncentred X'X)
    xtx = np.zeros((p + 1, p + 1))
    xtx[0, 0] = n
    if p:
        xk = xbar[keep]
        xtx[0, 1:] = xtx[1:, 0] = n * xk
        xtx[1:, 1:] = sxx[np.ix_(keep, keep)] + n * np.outer(xk, xk)
    ev = np.linalg.eigvalsh(xtx)
    cond = float(math.sqrt(ev.max() / ev.min())) if ev.min() > 0 else float("inf")
    stats = [(n, p, dfr, float(r2), float(adj), float(fst), fp, float(llf), float(aic), float(bic), cond)]
    coefs = spark.createDataFrame(rows, COEF_SCHEMA)
    return coefs, spark.createDataFrame(stats, STATS_SCHEMA)


STATS_SCHEMA = ("n bigint, df_model bigint, df_resid bigint, r2 double, adj_r2 double, f_stat double, "
                "f_pvalue double, log_likelihood double, aic double, bic double, condition_number double")


def fitted(df: DataFrame, y: str, coefs: DataFrame) -> DataFrame:
    """Adds ``fitted`` and ``residual`` from a coefficient table (p rows, collected)."""
    c = {r["term"]: r["coef"] for r in coefs.collect() if r["coef"] is not None}
    pred = F.lit(c.get("const", 0.0))
    for term, v in c.items():
        if term != "const":
            pred = pred + F.lit(v) * F.col(term).cast("double")
    return df.withColumn("fitted", pred).withColumn("residual", F.col(y).cast("double") - F.col("fitted"))


def residual_diagnostics(df: DataFrame, y: str, xs: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """REG-3, REG-4: per-row ``(fitted, residual, scale_location)`` and one row of
    residual statistics: skew, kurtosis, Jarque–Bera, Durbin–Watson (over ``order``)."""
    d = df.select(*([order] if order and order not in [y] + xs else []), y, *xs).na.drop()
    coefs, _ = ols(d, y, xs)
    f = fitted(d, y, coefs)
    sd = f.agg(F.stddev_pop("residual")).first()[0] or 1.0
    rows = f.withColumn("scale_location", F.sqrt(F.abs(F.col("residual") / F.lit(sd))))
    st = f.agg(F.count(F.lit(1)).alias("n"), F.skewness("residual").alias("skew"),
               (F.kurtosis("residual") + 3).alias("kurtosis"))
    st = st.withColumn("jarque_bera", F.col("n") / 6.0 * (F.col("skew") ** 2 + (F.col("kurtosis") - 3) ** 2 / 4))
    one = st.first()  # one row of residual moments
    if one["n"] and one["n"] >= 8 and one["skew"] is not None:
        k2, pk = omnibus(int(one["n"]), float(one["skew"]), float(one["kurtosis"]))
        st = st.withColumn("omnibus", F.lit(k2)).withColumn("omnibus_pvalue", F.lit(pk))
    if order:
        from ..functions.frames import attach_scalars
        st = attach_scalars(st, durbin_watson(f, order))
    return rows, st


def durbin_watson(df: DataFrame, order: str, resid: str = "residual", rows_per_part: int = 1_000_000) -> DataFrame:
    """``sum((e_t - e_{t-1})^2) / sum(e_t^2)`` in ``order`` without a one-task sort.

    Rows of equal order keys stand by residual, so the order is total and the result
    repeatable.  Rows are range-partitioned on both (checkpointed, so the bounds
    are fixed under retries); differences inside a partition come from a
    partition-local ``lag``, and the pair across each partition boundary from
    a table of first / last residuals (one row per partition).
    """
    from pyspark.sql import Window
    from ..functions.frames import quoted
    from ..session import cut_lineage
    n = df.count()
    parts = max(1, -(-n // rows_per_part))
    d = df.select(F.col(quoted(order)).alias("_at"), F.col(quoted(resid)).alias("_e"))
    d = cut_lineage(d.repartitionByRange(parts, "_at", "_e").withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy("_at", "_e")
    place = F.struct("_at", "_e")
    inner = (d.withColumn("_prev", F.lag("_e").over(w))
              .groupBy("_pid").agg(F.sum((F.col("_e") - F.col("_prev")) ** 2).alias("_in"),
                                   F.sum(F.col("_e") ** 2).alias("_ss"),
                                   F.min_by("_e", place).alias("_first"),
                                   F.max_by("_e", place).alias("_last")))
    wp = Window.partitionBy(F.lit(1)).orderBy("_pid")  # one row per partition
    edge = inner.withColumn("_edge", (F.col("_first") - F.lag("_last").over(wp)) ** 2)
    return edge.agg(((F.sum("_in") + F.coalesce(F.sum("_edge"), F.lit(0.0))) / F.sum("_ss"))
                    .alias("durbin_watson"))


def omnibus(n: int, skew: float, kurt: float) -> tuple[float, float]:
    """D'Agostino-Pearson K^2 from population skewness and (Pearson) kurtosis, and its
    chi-square(2) p-value (the published z-transforms of both moments)."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    y = y if y != 0 else 1.0
    z1 = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5))
    x = (kurt - e) / math.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + math.sqrt(1 + 4.0 / sb1 ** 2))
    t1 = 1 - 2 / (9.0 * a)
    den = 1 + x * math.sqrt(2 / (a - 4.0))
    t2 = math.copysign(1, den) * ((1 - 2 / a) / abs(den)) ** (1 / 3.0) if den != 0 else 0.0
    z2 = (t1 - t2) / math.sqrt(2 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    from ..functions.distributions import chi2_sf
    return k2, float(chi2_sf(k2, 2))


def significant_predictors(coefs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """REG-5."""
    return coefs.where((F.col("term") != "const") & (F.col("p_value") < alpha))


# ---------------------------------------------------------------- CV-4 (closed form, one predictor)
def kfold_simple_ols(df: DataFrame, x: str, y: str, key_cols: list[str], k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Per-fold hold-out r2 of ``y ~ x``.

    One pass gives each fold's moments; the line of a fold's training rows follows from the other
    folds' moments together, so no row is copied.
    """
    f = kfold(df.select(*key_cols, F.col(x).cast("double").alias("_x"),
                        F.col(y).cast("double").alias("_y")), key_cols, k, seed)
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    parts = f.where(both).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("x"), F.avg("_y").alias("y"),
                                              F.var_pop("_x").alias("xx"), F.covar_pop("_x", "_y").alias("xy")).collect()  # k rows
    lines = []
    for held in range(k):
        rest = [p for p in parts if p["fold"] != held]
        n = sum(p["n"] for p in rest)
        if n:
            mx, my = (sum(p["n"] * p[c] for p in rest) / n for c in ("x", "y"))
            xx = sum(p["n"] * (p["xx"] + (p["x"] - mx) ** 2) for p in rest)
            xy = sum(p["n"] * (p["xy"] + (p["x"] - mx) * (p["y"] - my)) for p in rest)
            slope = xy / xx if xx > 0 else None
            lines.append((held, slope, None if slope is None else my - slope * mx))
    coef = df.sparkSession.createDataFrame(lines, "fold int, _b double, _a double")
    from .metrics import regression_metrics
    pred = f.join(F.broadcast(coef), "fold").select(
        "fold", F.col("_y").alias("label"), (F.col("_a") + F.col("_b") * F.col("_x")).alias("prediction"))
    return regression_metrics(pred, ["fold"])


# ---------------------------------------------------------------- REG-6, 8, 9, 11
def penalized_params(kind: str, alpha: float, l1_ratio: float, n: int, sigma_y: float) -> dict:
    """MLlib ``regParam`` / ``elasticNetParam`` equal to the sklearn objectives.

    sklearn minimises ``1/(2n) |y - Xb|^2 + a |b|_1 + b/2 |b|^2`` (Ridge: ``alpha |b|^2``
    over the sum, so ``b = alpha / n`` per sample); MLlib scales its L2 part by
    the population std of y, hence ``regParam = a + sigma_y * b``.
    """
    if kind == "ridge":
        a, b = 0.0, alpha / n
    elif kind == "lasso":
        a, b = alpha, 0.0
    elif kind == "elasticnet":
        a, b = alpha * l1_ratio, alpha * (1 - l1_ratio)
    else:
        raise ValueError(kind)
    reg = a + sigma_y * b
    return {"regParam": reg, "elasticNetParam": (a / reg) if reg > 0 else 0.0}


def regression_estimators(names: list[str], n: int, sigma_y: float, trees: int = 100,
                          boost_iter: int = 100, seed: int = 42, max_depth: int = 30) -> dict:
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    est = {}
    for name in names:
        if name == "Linear Regression":
            est[name] = LinearRegression(solver="normal", regParam=0.0, standardization=False)
        elif name in ("Ridge", "Lasso", "ElasticNet"):
            kind = {"Ridge": "ridge", "Lasso": "lasso", "ElasticNet": "elasticnet"}[name]
            alpha = {"Ridge": 1.0, "Lasso": 0.1, "ElasticNet": 0.1}[name]
            p = penalized_params(kind, alpha, 0.5, n, sigma_y)
            est[name] = LinearRegression(standardization=False, maxIter=500, tol=1e-9, **p)
        elif name == "Random Forest":
            est[name] = RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", maxDepth=max_depth,
                                              seed=seed)
        elif name == "Gradient Boosting":
            est[name] = GBTRegressor(maxIter=boost_iter, stepSize=0.1, maxDepth=3, seed=seed)
        else:
            raise ValueError(name)
    return est


def _importance(model, names: list[str]) -> list[tuple[str, float]]:
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        v = np.abs(model.coefficients.toArray())
    else:
        v = np.ones(len(names))
    return [(n, float(x)) for n, x in zip(names, v)]


#: A model that cannot be fitted to these rows.  Anything else (a failed task, a lost executor, a full heap) says nothing about the model.
UNFIT = (ValueError, ArithmeticError, IllegalArgumentException)


def attempt(call):
    """A call whose value is ``(result, None)``, or ``(None, problem)`` of a model that cannot be fitted; other failures are raised."""
    def run():
        try:
            return call(), None
        except UNFIT as problem:
            return None, problem
    return run


def mean_std(scores: list) -> tuple[float, float]:
    """Mean and population std of the folds' scores."""
    if any(v is None for v in scores):
        raise ValueError("a fold has no score: its labels do not vary")
    return float(np.mean(scores)), float(np.std(scores))


def all_fitted(comparison: DataFrame) -> DataFrame:
    """The comparison as it is; an error if a model failed, for readers that do not see the column ``error``."""
    failed = [(r["model"], r["error"]) for r in comparison.where(F.col("error").isNotNull()).collect()]     # a row a model
    if failed:
        raise RuntimeError("; ".join(f"{model} failed: {error}" for model, error in failed))
    return comparison


def compare_regressors(df: DataFrame, y: str, xs: list[str], key_cols: list[str],
                       models: list[str] | None = None, trees: int = 100, boost_iter: int = 100,
                       seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """REG-6, REG-8: in-sample r2 / rmse / mae and k-fold r2 (mean, population std).

    ``k = min(5, n // 5)``; needs ``n >= 20`` (else empty frames).  Returns
    ``(comparison, importance)`` with importance summed over models.  A model that cannot be fitted is a row with its
    ``error`` and adds no importance; a failure of Spark is raised.
    """
    from pyspark.ml.feature import VectorAssembler
    from .metrics import regression_metrics
    spark = df.sparkSession
    models = models or ["Linear Regression", "Random Forest", "Gradient Boosting"]
    d = df.select(*key_cols, F.col(y).cast("double").alias("label"),
                  *[F.col(c).cast("double").alias(c) for c in xs if c not in key_cols]).na.drop()
    feats = [c for c in xs]
    n = d.count()
    cmp_schema = "model string, r2 double, rmse double, mae double, cv_r2_mean double, cv_r2_std double, error string"
    if n < 20:
        return spark.createDataFrame([], cmp_schema), spark.createDataFrame([], "feature string, importance double")
    k = min(5, n // 5)
    va = VectorAssembler(inputCols=feats, outputCol="features")
    data = cut_lineage(spread(va.transform(kfold(d, key_cols, k, seed)).select("label", "features", "fold"), n))     # read by every fit
    sigma = data.agg(F.stddev_pop("label")).first()[0] or 1.0
    # a set of estimators for each fit: fits run side by side
    whole, *parts = [regression_estimators(models, n, sigma, trees, boost_iter, seed) for _ in range(k + 1)]

    def in_sample(e):
        m = e.fit(data)
        return regression_metrics(m.transform(data)).first(), _importance(m, feats)

    def held_out(e, f):
        return e.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f)).select("fold", "label", "prediction")

    calls = [attempt(partial(in_sample, e)) for e in whole.values()]
    calls += [attempt(partial(held_out, parts[f][name], f)) for name in whole for f in range(k)]
    done = together(spark, calls)
    rows, imps = [], []
    for i, name in enumerate(whole):
        fit, *folds = [done[i], *done[len(whole) + i * k:len(whole) + (i + 1) * k]]
        problem = next((p for _, p in (fit, *folds) if p), None)
        if not problem:
            # the held-out predictions of all folds are scored in one grouped pass
            r2 = regression_metrics(reduce(DataFrame.unionByName, [p for p, _ in folds]), ["fold"]).collect()
            cv, problem = attempt(partial(mean_std, [r["r2"] for r in r2]))()
        if problem:      # a model that fails is a row of the comparison
            rows.append((name,) + (None,) * 5 + (str(problem)[:300],))
            continue
        ins, importance = fit[0]
        rows.append((name, ins["r2"], ins["rmse"], ins["mae"], *cv, None))
        imps.extend(importance)
    cmp = spark.createDataFrame(rows, cmp_schema)
    imp = (spark.createDataFrame(imps, "feature string, importance double")
                .groupBy("feature").agg(F.sum("importance").alias("importance")))
    return cmp, imp

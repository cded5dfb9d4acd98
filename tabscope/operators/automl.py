"""Auto-ML with a voting ensemble (AML-1..7).

Task detection from one distinct count, a feature frame (not standardised,
target encoded), a hold-out split (stratified when <= 10 classes), the model
grid as MLlib estimators (k-NN as the exact blocked join), hold-out metrics
plus shuffled k-fold CV, best-model choice, and a top-3 vote: soft (mean
probability) for binary targets, hard (majority) for multiclass, mean for
regression — all votes are grouped aggregates over predictions joined on the
row key.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import spread
from ..session import cut_lineage, together
from .classify import classifier, knn_predict
from .metrics import accuracy, classification_metrics, regression_metrics
from .prep import encode_labels, feature_frame
from .regress import attempt, mean_std, regression_estimators
from .roles import distinct_counts
from .split import kfold, train_test_split

BOARD_SCHEMA = ("model string, accuracy double, precision double, recall double, f1_score double, "
                "r2 double, rmse double, mae double, cv_mean double, cv_std double, error string")


def detect_task(df: DataFrame, target: str) -> str:
    """AML-1: <= 2 distinct -> binary, <= 20 -> multiclass, strings -> multiclass, else regression."""
    n = distinct_counts(df, [target]).first()
    n = n["n_distinct"] if n else 0
    is_str = not isinstance(df.schema[target].dataType, T.NumericType)
    if n <= 2:
        return "binary_classification"
    if n <= 20 or is_str:
        return "multiclass_classification"
    return "regression"


def _predict(name, model_or_none, train, test, names, task, key):
    """Predictions ``(key, prediction[, score])`` on ``test``."""
    from pyspark.ml.functions import vector_to_array
    if name == "KNN":
        tr = train.select(key, *names, "label")
        te = test.select(key, *names)
        kind = {"regression": "regression", "binary_classification": "binary"}.get(task, "classification")
        return knn_predict(tr, te, names, key, 5, kind)
    p = model_or_none.transform(test)
    cols = [key, "prediction"]
    if name == "SVM" and task == "binary_classification":
        # a margin has no probability of its own: a logistic fit of the label on the training margins gives one
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorSlicer
        margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
        fit = LogisticRegression(featuresCol="margin", probabilityCol="probability", rawPredictionCol="platt", predictionCol="platt_label")
        p = fit.fit(margin.transform(model_or_none.transform(train))).transform(margin.transform(p))
    if "probability" in p.columns and task == "binary_classification":
        p = p.withColumn("score", vector_to_array("probability")[1])
        cols.append("score")
    return p.select(*cols)


def auto_analyze(df: DataFrame, target: str, numeric_cols: list[str], other_cols: list[str], key: str,
                 test_size: float = 0.2, seed: int = 42, models: list[str] | None = None,
                 trees: int = 150, boost_iter: int = 100, max_iter: int = 300) -> dict[str, DataFrame]:
    from pyspark.ml.feature import VectorAssembler
    spark = df.sparkSession
    task = detect_task(df, target)
    is_cls = task != "regression"
    x, names = feature_frame(df, target, numeric_cols, other_cols, keep=[key])
    if is_cls:
        x, classes = encode_labels(x, target)
    else:
        x = x.withColumn("label", F.col(target).cast("double"))
        classes = []
    n = x.count()
    strat = F.col("label") if is_cls and len(classes) <= 10 else None
    sp = train_test_split(x, [key], test_size, seed, strat)
    k = max(2, min(5, n // 5))
    folds = kfold(sp, [key], k, seed)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(folds) \
        .select(key, *names, "label", "features", "is_test", "fold")
    data = cut_lineage(spread(data, n))      # read by every fit
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    n_train = train.count()
    fold_sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}  # k rows
    if models is None:
        models = (["Logistic Regression", "Random Forest", "Gradient Boosting", "KNN"] +
                  (["SVM"] if task == "binary_classification" else [])) if is_cls else \
                 ["Linear Regression", "Ridge", "Lasso", "ElasticNet", "Random Forest",
                  "Gradient Boosting", "KNN"]
    sigma = data.agg(F.stddev_pop("label")).first()[0] or 1.0
    avg = "binary" if task == "binary_classification" else "macro"

    def make(name, nt):
        if name == "KNN":
            return None
        if is_cls:
            return classifier(name, nt, len(classes), trees, boost_iter, seed, max_iter)
        return regression_estimators([name], nt, sigma, trees, boost_iter, seed)[name]

    def predicted(name, nt, fit_rows, rest):
        est = make(name, nt)
        return _predict(name, est.fit(fit_rows) if est is not None else None, fit_rows, rest, names, task, key)

    def score(pred, truth):
        j = pred.join(truth.select(key, "label"), key)
        if is_cls:
            return classification_metrics(j, average=avg).first()
        return regression_metrics(j).first()

    def scored(p, fold_preds):
        s = score(p, test)
        # all held-out folds are scored together in one grouped pass
        allp = reduce(DataFrame.unionByName, [fp.select(key, "prediction").withColumn("fold", F.lit(f)) for f, fp in enumerate(fold_preds)])
        allp = allp.join(data.select(key, "label"), key)
        cvm = accuracy(allp, ["fold"]) if is_cls else regression_metrics(allp, ["fold"])
        return s, mean_std([r["accuracy" if is_cls else "r2"] for r in cvm.collect()])

    # the fits of all models, on the train rows and on each fold's, run side by side
    calls = [attempt(partial(predicted, name, n_train, train, test)) for name in models]
    calls += [attempt(partial(predicted, name, n - fold_sizes[f], data.where(F.col("fold") != f), data.where(F.col("fold") == f)))
              for name in models for f in range(k)]
    done = together(spark, calls)
    held = {name: [done[i], *done[len(models) + i * k:len(models) + (i + 1) * k]] for i, name in enumerate(models)}
    unfit = {name: next((problem for _, problem in got if problem), None) for name, got in held.items()}
    fitted = [name for name in models if unfit[name] is None]
    preds = {name: held[name][0][0] for name in fitted}
    scores = dict(zip(fitted, together(spark, [attempt(partial(scored, preds[name], [p for p, _ in held[name][1:]])) for name in fitted])))
    rows = []
    for name in models:
        found, problem = scores.get(name, (None, unfit[name]))
        if problem:     # a failing model is a leaderboard row, as in the reference
            rows.append((name,) + (None,) * 9 + (str(problem)[:500],))
            continue
        s, cv = found
        if is_cls:
            rows.append((name, s["accuracy"], s["precision"], s["recall"], s["f1"], None, None, None,
                         *cv, None))
        else:
            rows.append((name, None, None, None, None, s["r2"], s["rmse"], s["mae"],
                         *cv, None))
    board = spark.createDataFrame(rows, BOARD_SCHEMA)
    metric = "f1_score" if is_cls else "r2"
    ranked = board.where(F.col("cv_mean").isNotNull()).orderBy(F.col(metric).desc(), "model").collect()
    best_name = ranked[0]["model"] if ranked else None
    best_score = ranked[0][metric] if ranked else None
    top = [r["model"] for r in ranked[:3]]
    ens_score, used = None, False
    if len(top) >= 2:
        ens = vote([preds[m] for m in top], key, task)
        es = score(ens, test)
        ens_score = es["f1"] if is_cls else es["r2"]
        if ens_score is not None and best_score is not None and ens_score > best_score:
            best_name, best_score, used = f"Ensemble ({' + '.join(top)})", ens_score, True
    summary = spark.createDataFrame(
        [(task, n, len(names), best_name, best_score, ", ".join(top), ens_score, used)],
        "task string, n_rows bigint, n_features int, best_model string, best_score double, "
        "ensemble_models string, ensemble_score double, ensemble_used boolean")
    return {"leaderboard": board, "summary": summary}


def vote(preds: list[DataFrame], key: str, task: str) -> DataFrame:
    """AML-6: combine model predictions joined on the row key."""
    frames = []
    for i, p in enumerate(preds):
        cols = [key, "prediction"] + (["score"] if "score" in p.columns else [])
        frames.append(p.select(*cols).withColumn("_m", F.lit(i)))
    if task == "binary_classification" and all("score" in f.columns for f in frames):
        u = frames[0]
        for f in frames[1:]:
            u = u.unionByName(f)
        return u.groupBy(key).agg((F.avg("score") > 0.5).cast("double").alias("prediction"))
    u = frames[0].select(key, "prediction", "_m")
    for f in frames[1:]:
        u = u.unionByName(f.select(key, "prediction", "_m"))
    if task == "regression":
        return u.groupBy(key).agg(F.avg("prediction").alias("prediction"))
    c = u.groupBy(key, "prediction").count()
    w = Window.partitionBy(key).orderBy(F.col("count").desc(), "prediction")
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(key, "prediction")

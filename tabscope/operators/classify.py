"""Classification model comparison (CLS-4..9, KNN-1, EVL-7).

The feature frame (CLS-1..3) is built once and cached; every estimator is an
MLlib job on it.  Hold-out and cross-validation folds come from the
hash-ordered splits, metrics from ``operators.metrics``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import col, first_by_hash, spread, top_k_per_group
from ..session import cut_lineage
from .metrics import accuracy, auc, classification_metrics, confusion_cells, roc_points
from .prep import encode_labels, feature_frame
from .roles import distinct_counts
from .split import kfold, train_test_split

CMP_SCHEMA = ("model string, accuracy double, precision double, recall double, f1_score double, "
              "cv_mean double, cv_std double, auc double, error string")


MAX_DEPTH = 30      # MLlib's limit; the reference grows trees to the end


def classifier(name: str, n_train: int, n_classes: int, trees: int = 100, boost_iter: int = 100,
               seed: int = 42, max_iter: int = 300, max_depth: int = MAX_DEPTH):
    """MLlib estimator for a reference model name (sklearn defaults mapped)."""
    from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                           RandomForestClassifier)
    if name == "Logistic Regression":
        # sklearn C = 1: mean log-loss + ||w||^2 / (2 n)  ->  regParam = 1 / n
        return LogisticRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, maxIter=max_iter, tol=1e-8,
                                  family="binomial" if n_classes == 2 else "multinomial")
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=max_depth,
                                      seed=seed)
    if name == "Gradient Boosting":
        g = GBTClassifier(maxIter=boost_iter, stepSize=0.1, maxDepth=3, seed=seed)
        return g if n_classes == 2 else OneVsRest(classifier=g)
    if name == "SVM":
        return LinearSVC(regParam=1.0 / max(n_train, 1), maxIter=max_iter)
    raise ValueError(name)


def importance_vector(model, n_features: int) -> np.ndarray:
    """EVL-7: importances, or mean |coef| over classes, else ones."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    if hasattr(model, "models"):  # one-vs-rest of trees
        return np.mean([m.featureImportances.toArray() for m in model.models], axis=0)
    return np.ones(n_features)


def _score_col(pred: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    if "probability" in pred.columns:
        return pred.withColumn("score", vector_to_array("probability")[1])
    if "rawPrediction" in pred.columns:
        return pred.withColumn("score", vector_to_array("rawPrediction")[1])
    return pred.withColumn("score", F.col("prediction"))


def compare_classifiers(df: DataFrame, target: str, numeric_cols: list[str], other_cols: list[str],
                        key_cols: list[str], models: list[str] | None = None, test_size: float = 0.2,
                        trees: int = 100, boost_iter: int = 100, seed: int = 42,
                        max_iter: int = 300) -> dict[str, DataFrame] | None:
    """CLS-9: hold-out metrics, stratified k-fold accuracy, confusion cells,
    importance and ROC/AUC (binary).  ``None`` outside 2..50 classes."""
    from pyspark.ml.feature import VectorAssembler
    spark = df.sparkSession
    models = models or ["Logistic Regression", "Random Forest", "Gradient Boosting"]
    keyed, names = feature_frame(df, target, numeric_cols, other_cols, standardize=True, keep=key_cols)
    n_levels = distinct_counts(keyed, [target]).first()
    if n_levels is None or not 2 <= n_levels["n_distinct"] <= 50:
        return None
    lab, classes = encode_labels(keyed, target)
    k_cls = len(classes)
    strat = F.col("label") if k_cls <= 10 else None
    sp = train_test_split(lab, key_cols, test_size, seed, strat)
    va = VectorAssembler(inputCols=names, outputCol="features")
    data = va.transform(sp).select(*key_cols, "label", "features", "is_test")
    counts = [r["count"] for r in lab.groupBy("label").count().collect()]
    data = cut_lineage(spread(data, sum(counts)))      # read by every fit
    n_splits = max(2, min(5, min(counts)))
    folds = cut_lineage(kfold(data, key_cols, n_splits, seed, F.col("label")))
    train = data.where(~F.col("is_test"))
    test = data.where(F.col("is_test"))
    n_train = train.count()
    avg = "binary" if k_cls == 2 else "macro"
    rows, imps, cms, rocs = [], [], [], []
    for name in models:
        try:
            est = classifier(name, n_train, k_cls, trees, boost_iter, seed, max_iter)
            m = est.fit(train)
            pred = m.transform(test)
            met = classification_metrics(pred, average=avg).first()
            # k fits; the held-out predictions of all folds are scored in one grouped pass
            fold_preds = []
            for f in range(n_splits):
                mf = classifier(name, n_train, k_cls, trees, boost_iter, seed, max_iter) \
                    .fit(folds.where(F.col("fold") != f))
                fold_preds.append(mf.transform(folds.where(F.col("fold") == f)).select("fold", "label", "prediction"))
            cv = [r["accuracy"] for r in accuracy(_union(fold_preds), ["fold"]).collect()]
            a = None
            if k_cls == 2 and name != "SVM":
                sc = _score_col(pred).select("label", "score")
                a = auc(sc).first()["auc"]
                rocs.append(roc_points(sc).withColumn("model", F.lit(name)))
            rows.append((name, met["accuracy"], met["precision"], met["recall"], met["f1"],
                         float(np.mean(cv)), float(np.std(cv)), a, None))
            iv = importance_vector(m, len(names))
            imps.extend((name, f, float(v)) for f, v in zip(names, iv))
            cms.append(confusion_cells(pred).withColumn("model", F.lit(name)))
        except Exception as e:      # a model that fails is a row of the comparison
            rows.append((name,) + (None,) * 7 + (str(e)[:300],))
    cmp = spark.createDataFrame(rows, CMP_SCHEMA)
    imp = spark.createDataFrame(imps, "model string, feature string, importance double")
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")
    imp = imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 20)
    out = {"comparison": cmp, "importance": imp, "classes": spark.createDataFrame(
        [(i, c) for i, c in enumerate(classes)], "label int, class string")}
    if cms:
        out["confusion"] = _union(cms)
    if rocs:
        out["roc"] = _union(rocs)
    out["best"] = cmp.where(F.col("error").isNull()).orderBy(F.col("f1_score").desc(), "model").limit(1)
    return out


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- KNN-1
QUERY_CELLS = 1 << 22      # entries of the largest distance matrix inside a task (32 MB)


def nearest_labels(x: np.ndarray, y: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, distance, label) of the k nearest rows of x for each query; equal distances by label.

    The expanded form of the distance only bounds the candidates: every row that could be among the k
    nearest, ties included, gets its exact distance before the choice.
    """
    step = max(1, QUERY_CELLS // max(1, len(x)))
    k, xx, out = min(k, len(x)), (x * x).sum(axis=1), []
    for i in range(0, len(q), step):
        part = q[i:i + step]
        near = (part * part).sum(axis=1)[:, None] - 2 * part @ x.T + xx
        size = (part * part).sum(axis=1) + xx.max(initial=0.0)
        bound = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-12 * size
        r, c = np.nonzero(near <= bound[:, None])
        d = np.sqrt(((part[r] - x[c]) ** 2).sum(axis=1))
        order = np.lexsort((y[c], d, r))
        r, d, label = r[order], d[order], y[c][order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[first] + i, d[first], label[first]))
    return tuple(np.concatenate(z) for z in zip(*out))


PIVOTS = 1024       # most balls that the train rows are cut into


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows to the pivots."""
    return np.sqrt(np.maximum(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0.0))


def _strips(x: np.ndarray, pivots: np.ndarray):
    """(first row, distances to the pivots) of strips of rows."""
    step = max(1, QUERY_CELLS // max(1, pivots.size))
    for i in range(0, len(x), step):
        yield i, _to_pivots(x[i:i + step], pivots)


class _Balls:
    """Train rows by nearest pivot: pivots, radius and size of each ball; test rows by theirs."""

    def __init__(self, train: DataFrame, test: DataFrame, names: list[str], pivots: int):
        self.names = names
        n = train.count()
        hashed = first_by_hash(train, names, max(1, min(pivots, n // 64)))
        self.pivots = np.array([tuple(r) for r in hashed.collect()], float).reshape(-1, len(names))     # PIVOTS rows at most
        self.train, self.test = cut_lineage(self._dealt(train)), cut_lineage(self._dealt(test))
        k = len(self.pivots)
        self.radius, self.size = np.zeros(k), np.zeros(k, int)
        for r in self.train.groupBy("_ball").agg(F.max("_from").alias("r"), F.count(F.lit(1)).alias("n")).collect():
            self.radius[r["_ball"]], self.size[r["_ball"]] = r["r"], r["n"]

    def _dealt(self, df: DataFrame) -> DataFrame:
        names, pivots = self.names, self.pivots

        def deal(frames):
            for pdf in frames:
                x = pdf[names].to_numpy(dtype=float)
                ball, far = np.zeros(len(x), np.int32), np.zeros(len(x))
                for i, d in _strips(x, pivots):
                    ball[i:i + len(d)], far[i:i + len(d)] = d.argmin(axis=1), d.min(axis=1)
                yield pdf.assign(_ball=ball, _from=far)
        return df.mapInPandas(deal, df.select("*").schema.add("_ball", "integer").add("_from", "double"))

    def visits(self, bounded: DataFrame) -> DataFrame:
        """Test rows with ``_bound`` (distance of the k-th neighbour so far), once for each further ball that may hold a nearer
        row: its pivot is not farther than the bound and its radius together (triangle inequality)."""
        names, pivots, radius, size = self.names, self.pivots, self.radius, self.size

        def visit(frames):
            for pdf in frames:
                home, bound = pdf["_ball"].to_numpy(), pdf["_bound"].to_numpy()
                for i, d in _strips(pdf[names].to_numpy(dtype=float), pivots):
                    reach = radius + bound[i:i + len(d), None]
                    go = (d - reach <= 1e-9 * (d + np.where(np.isfinite(reach), reach, 0.0))) & (size > 0)
                    go[np.arange(len(d)), home[i:i + len(d)]] = False
                    row, ball = np.nonzero(go)
                    yield pdf.iloc[row + i].assign(_ball=ball.astype(np.int32))
        return bounded.mapInPandas(visit, bounded.schema)


def _compared(balls: _Balls, asked: DataFrame, id_col: str, k: int, block_rows: int) -> DataFrame:
    """``(id, _d, _y)``: the k nearest train rows of the ball that each row of ``asked`` names.

    A ball's train rows and the rows that ask for it are both cut by hash into parts of about ``block_rows``; every pair of
    parts is one ``cogroup`` task, so neither a large ball nor one asked for by many rows meets in one task.
    """
    names = balls.names
    asks = np.zeros(len(balls.size), int)
    for r in asked.groupBy("_ball").count().collect():      # a row a ball
        asks[r["_ball"]] = r["count"]

    def parts(n):
        return F.array(*[F.lit(int(max(1, -(-v // block_rows)))) for v in n])[F.col("_ball")]

    def every(n):
        return F.explode(F.sequence(F.lit(0), parts(n) - 1))
    wanted = F.array(*[F.lit(bool(v)) for v in asks])[F.col("_ball")]
    tr = (balls.train.where(wanted).select(*names, "_y", "_ball", F.pmod(F.xxhash64("_row"), parts(balls.size)).cast("int").alias("_bt"))
               .select("*", every(asks).alias("_bq")))
    te = (asked.select(col(id_col), *names, "_ball", F.pmod(F.xxhash64(col(id_col)), parts(asks)).cast("int").alias("_bq"))
               .select("*", every(balls.size).alias("_bt")))
    schema = asked.select(col(id_col)).schema.add("_d", "double").add("_y", "double")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:  # a part with no partner rows
            return pd.DataFrame({id_col: right[id_col].iloc[:0], "_d": np.zeros(0), "_y": np.zeros(0)})
        at, d, y = nearest_labels(left[names].to_numpy(dtype=float), left["_y"].to_numpy(dtype=float),
                                  right[names].to_numpy(dtype=float), k)
        return pd.DataFrame({id_col: right[id_col].to_numpy()[at], "_d": d, "_y": y})

    key = ["_ball", "_bt", "_bq"]
    return tr.groupBy(*key).cogroup(te.groupBy(*key)).applyInPandas(cell, schema)


def _best(found: DataFrame, id_col: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(col(id_col)).orderBy("_d", "_y"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _mostly_copies(rows: DataFrame, names: list[str]) -> bool:
    """Are there fewer than half as many different points as rows (about)?"""
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*names)).alias("points")).first()
    return 2 * one["points"] < one["n"]


def _few_labels(train: DataFrame, names: list[str], k: int) -> DataFrame:
    """Of train rows at one point, the ``k`` with the smallest labels: no other can be among the k nearest of any row."""
    return top_k_per_group(train, names, [F.col("_y").asc_nulls_last(), F.col("_row")], k, salt_col="_row", rank_name="_copy").drop("_copy")


BROADCAST_POINTS = 20_000      # most points whose neighbours are broadcast to their copies


def _for_copies(test: DataFrame, points: DataFrame, best: DataFrame, names: list[str], id_col: str, k: int) -> DataFrame:
    """The neighbours of each point (``best`` by ``_q``), for all test rows at the point."""
    found = points.join(best.groupBy("_q").agg(F.collect_list(F.struct("_d", "_y")).alias("_near")), "_q").drop("_q")
    if points.count() <= BROADCAST_POINTS:
        found = F.broadcast(found)
    rows = test.join(found, names).select(col(id_col), F.explode("_near").alias("_n")).select(col(id_col), "_n._d", "_n._y")
    return _best(rows, id_col, k)


def nearest_train(train: DataFrame, test: DataFrame, features: list[str], id_col: str, k: int, label: str,
                  block_rows: int = 8_192, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``(id, _d, _y)`` of the exact k nearest train rows, and the further visits ``(id, _ball)`` that were needed."""
    names = [f"_f{i}" for i in range(len(features))]
    of = [col(c).cast("double").alias(n) for c, n in zip(features, names)]
    row = [col(id_col)] if id_col in train.columns else [col(c) for c in [*features, label]]
    there = ~F.exists(F.array(*names), lambda v: v.isNull() | F.isnan(v))      # a missing feature is near to nothing
    train = train.select(*of, col(label).cast("double").alias("_y"), F.xxhash64(*row).alias("_row")).where(there)
    test = test.select(col(id_col), *of).where(there)
    if _mostly_copies(train, names):
        train = _few_labels(train, names, k)
    if _mostly_copies(test, names):
        points = cut_lineage(test.select(*names).distinct().withColumn("_q", F.monotonically_increasing_id()))
        best, more = _nearest(train, points, names, "_q", k, block_rows, pivots)
        return _for_copies(test, points, best, names, id_col, k), more.select(F.col("_q").alias(id_col), "_ball")
    return _nearest(train, test, names, id_col, k, block_rows, pivots)


def _nearest(train: DataFrame, test: DataFrame, names: list[str], id_col: str, k: int, block_rows: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """``nearest_train`` on prepared rows, train (names, _y, _row) and test (id, names)."""
    balls = _Balls(train, test, names, pivots)
    if len(balls.pivots) == 0:      # no train rows
        none = test.select(col(id_col), F.lit(0.0).alias("_d"), F.lit(0.0).alias("_y")).limit(0)
        return none, none.select(col(id_col), F.lit(0).alias("_ball"))
    home = cut_lineage(_best(_compared(balls, balls.test, id_col, k, block_rows), id_col, k))
    full = home.groupBy(col(id_col)).agg(F.max("_d").alias("_bound"), F.count(F.lit(1)).alias("_n"))
    full = full.select(col(id_col), F.when(F.col("_n") < k, float("inf")).otherwise(F.col("_bound")).alias("_bound"))
    bounded = balls.test.join(full, id_col, "left").na.fill(float("inf"), ["_bound"])
    more = cut_lineage(balls.visits(bounded))
    return _best(home.unionByName(_compared(balls, more, id_col, k, block_rows)), id_col, k), more.select(col(id_col), "_ball")


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], id_col: str, k: int = 5,
                task: str = "classification", label: str = "label",
                block_rows: int = 8_192, pivots: int = PIVOTS) -> DataFrame:
    """Exact k nearest neighbours (Euclidean): ``(id, prediction)`` per test row.

    Train rows are dealt into balls around pivots (distinct points, the smallest by hash).  A test row is compared with
    the ball of its nearest pivot; the distance of its k-th neighbour there then rules out every ball that
    lies farther off, and only the others are compared too.  Equal distances rank the smaller label first.
    Classification: majority vote, ties to the smallest label; ``binary`` adds the share of ones as ``score``;
    regression: mean label.  Where most rows are copies of a point, each point is compared once, with its k smallest
    labels, so a crowd at one distance costs no more than k rows.
    """
    best, _ = nearest_train(train, test, features, id_col, k, label, block_rows, pivots)
    if task == "regression":
        return best.groupBy(col(id_col)).agg(F.avg("_y").alias("prediction"))
    if task == "binary":        # labels 0 and 1: the share of ones is the probability
        share = F.avg("_y")
        return best.groupBy(col(id_col)).agg((share > 0.5).cast("double").alias("prediction"), share.alias("score"))
    votes = best.groupBy(col(id_col), "_y").count()
    w = Window.partitionBy(col(id_col)).orderBy(F.col("count").desc(), F.col("_y"))
    return (votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                 .select(col(id_col), F.col("_y").alias("prediction")))

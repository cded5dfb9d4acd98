"""Cross-validation of any estimator by any scores (CV-2..4).

An estimator is anything with ``fit(DataFrame)`` whose result has ``transform(DataFrame)`` that adds ``prediction`` (and, for
``roc_auc``, ``probability``, ``rawPrediction`` or ``score``): MLlib's estimators and pipelines, or a pair of functions as
``Fitted``.  Rows get their fold by hash, the k models predict the rows they have not seen, and these rows of
all folds are kept in one checkpointed frame, over which every score is one aggregate by fold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import auc, binary_metrics, classification_metrics, regression_metrics
from .split import kfold


def _column(table: Callable, name: str, sign: int = 1) -> Callable:
    def score(pred: DataFrame, keys: list[str]) -> DataFrame:
        return table(pred, keys).select(*keys, (sign * F.col(name)).alias("score"))
    return score


def _macro(pred: DataFrame, keys: list[str]) -> DataFrame:
    return classification_metrics(pred, keys, average="macro")


def _squared(pred: DataFrame, keys: list[str]) -> DataFrame:
    return regression_metrics(pred, keys).withColumn("mse", F.col("rmse") * F.col("rmse"))


# scores by their usual names: (held-out rows, key columns) -> (keys..., score)
SCORERS: dict[str, Callable] = {
    "accuracy": _column(binary_metrics, "accuracy"),
    **{s: _column(binary_metrics, s) for s in ("precision", "recall", "f1")},
    **{f"{s}_macro": _column(_macro, s) for s in ("precision", "recall", "f1")},
    "roc_auc": _column(auc, "auc"),
    "r2": _column(regression_metrics, "r2"),
    "neg_mean_absolute_error": _column(regression_metrics, "mae", -1),
    "neg_root_mean_squared_error": _column(regression_metrics, "rmse", -1),
    "neg_mean_squared_error": _column(_squared, "mse", -1),
}


@dataclass
class Fitted:
    """An estimator from a function: ``learn(train)`` returns ``predict(rows)``, which adds ``prediction``."""

    learn: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]

    def fit(self, train: DataFrame) -> "Fitted":
        out = Fitted(self.learn)
        out.transform = self.learn(train)
        return out


def _with_score(pred: DataFrame) -> DataFrame:
    """``score`` for rankings: the given one, else the second class's probability or margin, else the prediction."""
    from pyspark.ml.functions import vector_to_array
    if "score" in pred.columns:
        return pred
    for name in ("probability", "rawPrediction"):
        if name in pred.columns:
            return pred.withColumn("score", vector_to_array(name)[1])
    return pred.withColumn("score", F.col("prediction").cast("double"))


def held_out(estimator, folds: DataFrame, k: int, label: str = "label", fold: str = "fold") -> DataFrame:
    """``(fold, label, prediction, score)`` of every row, by the model that was fitted without the row's fold."""
    parts = []
    for i in range(k):
        model = estimator.fit(folds.where(F.col(fold) != i))
        rows = _with_score(model.transform(folds.where(F.col(fold) == i)))
        parts.append(rows.select(F.lit(i).alias("fold"), F.col(label).cast("double").alias("label"),
                                 F.col("prediction").cast("double").alias("prediction"), F.col("score").cast("double").alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out)


def cross_validate(data: DataFrame, estimator, scoring, key_cols: list[str], *, k: int = 5, seed: int = 42,
                   label: str = "label", stratified: bool = False) -> DataFrame:
    """``(scorer, fold, score)`` for each score in ``scoring`` (names of ``SCORERS`` or ``{name: function}``).

    ``stratified`` deals each label's rows over the folds.  Rows without a label take no part; a fold in which a
    score is not defined (one class only) has a null.
    """
    named = scoring if isinstance(scoring, dict) else {s: SCORERS[s] for s in ([scoring] if isinstance(scoring, str) else scoring)}
    rows = data.where(F.col(label).isNotNull())
    folds = cut_lineage(kfold(rows, key_cols, k, seed, F.col(label) if stratified else None))
    pred = held_out(estimator, folds, k, label)
    out = None
    for name, score in named.items():
        one = score(pred, ["fold"]).select(F.lit(name).alias("scorer"), F.col("fold").cast("int").alias("fold"), F.col("score").cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def score_summary(scores: DataFrame) -> DataFrame:
    """``(scorer, scores, mean, std, n_splits)``: list by fold, mean and population standard deviation."""
    return scores.groupBy("scorer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]).alias("scores"),
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n_splits"))

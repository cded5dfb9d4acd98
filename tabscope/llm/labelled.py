"""Bounded samples of labelled rows and the small logistic fits of the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def training_labels(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
                    folds: int | None = None, held_out: int = 0) -> DataFrame:
    """At most ``per_class`` ids per class (1: label > 0), the first in the order of a hash of the id.

    Rows of the held-out fold, null ids and null labels are left out; an id with several labels takes
    the largest.  Columns: the id, y (0/1), weight (training rows of the class for each sampled one, so that weighted
    shares are those of all training labels), half (0/1, by another hash).
    """
    rows = labels.select(F.col(id_col), F.col(label).alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isNotNull())
    if folds:
        rows = rows.where(crc_mod(id_col, folds) != held_out)
    rows = rows.groupBy(id_col).agg((F.max("y") > 0).cast("int").alias("y"))
    # one top-k per class: every task keeps its own best, none gets a whole class
    order = [F.xxhash64(F.lit(17), F.col(id_col)), F.col(id_col)]
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    first = [rows.where(F.col("y") == y).orderBy(*order).limit(per_class)
             .withColumn("weight", F.lit(max(1.0, counts.get(y, 0) / per_class))) for y in (0, 1)]
    return first[0].union(first[1]).withColumn("half", F.abs(F.xxhash64(F.lit(29), F.col(id_col)) % 2).cast("int"))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def mean_one(weight: np.ndarray) -> np.ndarray:
    """Weights scaled to a mean of 1."""
    weight = np.asarray(weight, float)
    return weight / weight.mean() if len(weight) else weight


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Shift-and-scale weighted logistic fit of y on one measure: (slope, offset, centre) by Newton steps.

    Without rows of both classes the slope is 0 and the offset gives the smoothed share of ones.
    """
    y, weight = np.asarray(y, float), mean_one(weight)
    prior = ((weight * y).sum() + 0.5) / (len(y) + 1.0)
    centre = float(np.mean(x)) if len(x) else 0.0
    scale = float(np.std(x)) if len(x) else 0.0
    if len(y) == 0 or y.min() == y.max() or scale == 0:
        return 0.0, float(np.log(prior / (1 - prior))), centre
    a = np.column_stack([(np.asarray(x, float) - centre) / scale, np.ones(len(x))])
    w = np.array([0.0, np.log(prior / (1 - prior))])
    ridge = np.array([1e-2, 1e-6])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (weight * (p - y)) + ridge * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1]), centre

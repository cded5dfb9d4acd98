"""Evaluation metrics (EVL-1..6, REG-10, CLU-6) over prediction frames.

Inputs are ``(label, prediction[, score])`` frames, optionally with model /
fold key columns; every metric is a grouped aggregate over them, so many
models and folds are scored in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import attach_scalars
from ..functions.quantiles import running_sums


# ---------------------------------------------------------------- EVL-1
def accuracy(pred: DataFrame, keys: list[str] | None = None, label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    keys = keys or []
    return pred.groupBy(*keys).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


# ---------------------------------------------------------------- EVL-3
def confusion_cells(pred: DataFrame, keys: list[str] | None = None, label: str = "label",
                    prediction: str = "prediction") -> DataFrame:
    """Non-zero cells ``(keys..., label, prediction, count)``; rows are the truth."""
    keys = keys or []
    return pred.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
               .agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(pred: DataFrame, labels: list, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Wide matrix: one row per true label (sorted), one column per predicted label.

    ``labels`` is the sorted union of true and predicted labels (at most the
    class limit, 50), so the pivot has a fixed, bounded set of columns.
    """
    cells = confusion_cells(pred, [], label, prediction)
    wide = cells.groupBy("label").pivot("prediction", labels).agg(F.sum("count")).na.fill(0)
    ltype = cells.schema["label"].dataType.simpleString()
    rows = pred.sparkSession.createDataFrame([(v,) for v in labels], f"label {ltype}")
    return rows.join(wide, "label", "left").na.fill(0).orderBy("label")


# ---------------------------------------------------------------- EVL-2
def prf(pred: DataFrame, keys: list[str] | None = None, average: str = "binary", pos_label=1,
        label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1: ``binary`` (class ``pos_label``) or ``macro`` over the
    union of true and predicted labels; zero division gives 0."""
    keys = keys or []
    cells = confusion_cells(pred, keys, label, prediction)
    tp = cells.where(F.col("label") == F.col("prediction")).groupBy(*keys, F.col("label").alias("c")) \
              .agg(F.sum("count").alias("tp"))
    pc = cells.groupBy(*keys, F.col("prediction").alias("c")).agg(F.sum("count").alias("npred"))
    tc = cells.groupBy(*keys, F.col("label").alias("c")).agg(F.sum("count").alias("ntrue"))
    per = (tc.join(pc, keys + ["c"], "full").join(tp, keys + ["c"], "left")
             .na.fill(0, ["tp", "npred", "ntrue"]))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("ntrue") > 0, F.col("tp") / F.col("ntrue")).otherwise(0.0)
    f1 = F.when(F.col("npred") + F.col("ntrue") > 0,
                2 * F.col("tp") / (F.col("npred") + F.col("ntrue"))).otherwise(0.0)
    per = per.select(*keys, "c", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))
    if average == "binary":
        base = pred.select(*keys).distinct()
        got = per.where(F.col("c") == F.lit(pos_label)).drop("c")
        return base.join(got, keys, "left").na.fill(0.0, ["precision", "recall", "f1"]) \
            if keys else _binary_global(pred, got)
    return per.groupBy(*keys).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                  F.avg("f1").alias("f1"))


def _binary_global(pred: DataFrame, got: DataFrame) -> DataFrame:
    one = pred.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    return one.join(got.withColumn("_one", F.lit(1)), "_one", "left").select(
        F.coalesce("precision", F.lit(0.0)).alias("precision"),
        F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def binary_metrics(pred: DataFrame, keys: list[str] | None = None, pos_label=1, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 for the positive class in one aggregate."""
    keys = keys or []
    y, p = F.col(label) == F.lit(pos_label), F.col(prediction) == F.lit(pos_label)
    a = pred.groupBy(*keys).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        F.sum((y & p).cast("long")).alias("_tp"), F.sum(p.cast("long")).alias("_np"),
        F.sum(y.cast("long")).alias("_nt"))
    return a.select(*keys, "accuracy",
                    F.when(F.col("_np") > 0, F.col("_tp") / F.col("_np")).otherwise(0.0).alias("precision"),
                    F.when(F.col("_nt") > 0, F.col("_tp") / F.col("_nt")).otherwise(0.0).alias("recall"),
                    F.when(F.col("_np") + F.col("_nt") > 0, 2 * F.col("_tp") / (F.col("_np") + F.col("_nt")))
                     .otherwise(0.0).alias("f1"))


def classification_metrics(pred: DataFrame, keys: list[str] | None = None, average: str = "binary",
                           label: str = "label", prediction: str = "prediction") -> DataFrame:
    keys = keys or []
    if average == "binary":
        return binary_metrics(pred, keys, 1, label, prediction)
    a = accuracy(pred, keys, label, prediction)
    p = prf(pred, keys, average, 1, label, prediction)
    return a.join(p, keys) if keys else attach_scalars(a, p)


# ---------------------------------------------------------------- EVL-4, 5
def roc_points(pred: DataFrame, keys: list[str] | None = None, label: str = "label",
               score: str = "score") -> DataFrame:
    """``(keys..., threshold, fpr, tpr)``: one point per distinct score (descending),
    plus the origin; positives are ``label = 1``."""
    keys = keys or []
    base = pred.select(*keys, F.col(score).cast("double").alias("threshold"),
                       (F.col(label) == 1).cast("long").alias("pos"),
                       (F.col(label) != 1).cast("long").alias("neg"))
    rs = running_sums(base, keys, "threshold", ["pos", "neg"], descending=True)
    tot = base.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = rs.join(F.broadcast(tot), keys) if keys else attach_scalars(rs, tot)
    curve = pts.select(*keys, "threshold",
                       F.try_divide(F.col("cum_neg") + F.col("neg"), F.col("N")).alias("fpr"),
                       F.try_divide(F.col("cum_pos") + F.col("pos"), F.col("P")).alias("tpr"))
    origin = tot.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                        F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)


def auc(pred: DataFrame, keys: list[str] | None = None, label: str = "label",
        score: str = "score") -> DataFrame:
    """Trapezoid area under the ROC curve, ties as one step (Mann-Whitney form):
    ``sum(neg_g * (pos_above_g + pos_g / 2)) / (P * N)`` over distinct scores."""
    keys = keys or []
    base = pred.select(*keys, F.col(score).cast("double").alias("threshold"),
                       (F.col(label) == 1).cast("long").alias("pos"),
                       (F.col(label) != 1).cast("long").alias("neg"))
    rs = running_sums(base, keys, "threshold", ["pos", "neg"], descending=True)
    return rs.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("cum_pos") + F.col("pos") / 2.0)),
                     F.sum("pos") * F.sum("neg")).alias("auc"))


# ---------------------------------------------------------------- REG-10
def regression_metrics(pred: DataFrame, keys: list[str] | None = None, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """``r2, rmse, mae`` (r2 = 1 - SSE / SST, SST about the label mean)."""
    keys = keys or []
    e = F.col(label) - F.col(prediction)
    a = pred.groupBy(*keys).agg(F.sum(e * e).alias("_sse"), F.avg(F.abs(e)).alias("mae"),
                                F.var_pop(label).alias("_vp"), F.count(F.lit(1)).alias("_n"))
    return a.select(*keys, (1 - F.try_divide(F.col("_sse"), F.col("_vp") * F.col("_n"))).alias("r2"),
                    F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"), "mae")


# ---------------------------------------------------------------- EVL-6 / REG-7 / CLU-3
def best_row(table: DataFrame, metric: str, tie: str, keys: list[str] | None = None,
             descending: bool = True) -> DataFrame:
    """Row with the best ``metric`` (per key), ties to the smallest ``tie``."""
    keys = keys or []
    m = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(m, F.col(tie)) if keys else \
        Window.partitionBy(F.lit(1)).orderBy(m, F.col(tie))
    return table.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


# ---------------------------------------------------------------- CLU-6
def cluster_centroids(points: DataFrame, features: list[str], cluster: str = "cluster",
                      keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return points.groupBy(*keys, cluster).agg(*[F.avg(c).alias(c) for c in features],
                                              F.count(F.lit(1)).alias("size"))


def davies_bouldin(points: DataFrame, features: list[str], cluster: str = "cluster",
                   keys: list[str] | None = None) -> DataFrame:
    """Davies–Bouldin index: mean over clusters of the worst
    ``(s_i + s_j) / d(c_i, c_j)``, ``s`` = mean distance to the centroid.

    Centroids (k rows per key, k <= 10) are broadcast; the centroid pairs are
    the k x k pairs of a bounded table, not pairs of data rows.
    """
    keys = keys or []
    cen = cluster_centroids(points, features, cluster, keys)
    c = cen.select(*keys, cluster, *[F.col(f).alias(f"_c_{f}") for f in features])
    dist = F.sqrt(sum((F.col(f) - F.col(f"_c_{f}")) ** 2 for f in features))
    s = (points.join(F.broadcast(c), keys + [cluster])
               .groupBy(*keys, cluster).agg(F.avg(dist).alias("_s")))
    a = cen.join(s, keys + [cluster]).select(*keys, F.col(cluster).alias("_i"), "_s",
                                             *[F.col(f).alias(f"_a_{f}") for f in features])
    b = a.select(*keys, F.col("_i").alias("_j"), F.col("_s").alias("_sj"),
                 *[F.col(f"_a_{f}").alias(f"_b_{f}") for f in features])
    pair = a.join(b, keys, "inner") if keys else attach_scalars(a, b)
    dc = F.sqrt(sum((F.col(f"_a_{f}") - F.col(f"_b_{f}")) ** 2 for f in features))
    r = (pair.where(F.col("_i") != F.col("_j"))
             .select(*keys, "_i", F.try_divide(F.col("_s") + F.col("_sj"), dc).alias("_r"))
             .groupBy(*keys, "_i").agg(F.max("_r").alias("_m")))
    return r.groupBy(*keys).agg(F.avg("_m").alias("davies_bouldin"))

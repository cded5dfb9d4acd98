"""Toxicity classifier with counterfactual regularisation.

A text's features are the 64-bit hashes of its distinct lower-cased words and of their first 4, 5 and 6
bytes (for stems).  Features that the toxic training texts hold clearly more often than the
others are kept, and a logistic model is fitted on them.  Every training text that names an
identity group gets a twin in which the identity terms are swapped for others of their class; the loss
adds ``penalty`` times the squared difference of the two linear scores, so a weight that rests on the mention of a group is
pushed to 0.

Fitting reads at most ``per_class`` labelled rows of each class (6,000 by default, hash order; equal
texts are one row with the weight of all) and keeps at most ``features`` features, whatever the size of the tables;
the rows are weighted to the class shares of all training labels.  Scoring reads every whole text.  Feature counts are summed on Spark; the driver holds the kept features and the rows' feature numbers.

Nulls and ties: a null text counts as empty; an empty text gets the score of a text without any kept
feature; an id with several labels takes the largest; without labels of both classes the score is the smoothed share of
ones.  Equal rows are each scored.  Only id, text and the label column are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, arrow_schema, record, row_of, slices, span_hash, words, written
from .labelled import mean_one, sigmoid, training_labels

STEMS = (4, 5, 6)
# fixed values: identity terms by class; a term is swapped for the next one of its class
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("disabled", "healthy"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"),
)
SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
_TERMS = re.compile(r"\b(" + "|".join(sorted(map(re.escape, SWAP), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with each identity term replaced by the next of its class."""
    return _TERMS.sub(lambda m: SWAP[m[0].lower()], text)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of each word and stem; not yet distinct."""
    buf = LOWER[buf]
    start, end, whole, rows = words(buf, off, ALNUM)
    row = row_of(rows)
    hashes, at = [whole], [row]
    for n in STEMS:
        longer = end - start > n
        if longer.any():
            hashes.append(span_hash(buf, start[longer], start[longer] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            at.append(row[longer])
    return np.concatenate(at), np.concatenate(hashes)


class Model:
    """Kept features (sorted hashes), weights and offset."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, offset: float):
        self.keys, self.weights, self.offset = keys, weights, offset
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def found(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, kept feature number) of the rows."""
        row, h = features(buf, off)
        near = self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        row, h = row[near], h[near]
        at = np.searchsorted(self.keys, h)
        same = at < len(self.keys)
        same[same] = self.keys[at[same]] == h[same]
        pair = np.unique(row[same] * max(1, len(self.keys)) + at[same])
        return pair // max(1, len(self.keys)), pair % max(1, len(self.keys))

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, feature = self.found(buf, off)
        return sigmoid(np.bincount(row, self.weights[feature], minlength=len(off) - 1) + self.offset)


def _counts(rows: DataFrame, text_col: str) -> DataFrame:
    """Texts of either class that hold each feature (map-side sums per task, then one sum on Spark)."""
    ddl = "feature long, toxic long, other long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                y = np.array(part.column(1).to_pylist(), np.int64)
                row, h = features(buf, off)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, toxic = h[new], y[row[new]]
                if len(h):
                    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    total = np.diff(np.append(first, len(h)))
                    t = np.add.reduceat(toxic, first)
                    yield record(schema, feature=h[first].view(np.int64), toxic=t, other=total - t)

    return (rows.select(text_col, "y").mapInArrow(run, ddl).groupBy("feature")
            .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray | None]], weight: np.ndarray, n: int, penalty: float, ridge: float,
                rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights of (label, features, features of the twin or None), each row with its own weight; full-batch Adam, fixed start."""
    y, weight = np.array([r[0] for r in rows], float), mean_one(weight)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, int)
    # the twin's difference: +1 for features only in the text, -1 for features only in the twin
    twins = [(np.setdiff1d(r[1], r[2]), np.setdiff1d(r[2], r[1])) for r in rows if r[2] is not None]
    d_weight = weight[[r[2] is not None for r in rows]]
    d_at = np.repeat(np.arange(len(twins)), [len(a) + len(b) for a, b in twins])
    d_col = np.concatenate([np.concatenate(t) for t in twins]).astype(int) if twins else np.zeros(0, int)
    d_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in twins]) if twins else np.zeros(0)
    prior = ((weight * y).sum() + 0.5) / (len(y) + 1)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        g = weight * (sigmoid(np.bincount(at, w[col], minlength=len(y)) + w[n]) - y) / max(1, len(y))
        grad = np.append(np.bincount(col, g[at], minlength=n) + ridge * w[:n], g.sum())
        if len(twins):
            diff = d_weight * np.bincount(d_at, w[d_col] * d_sign, minlength=len(twins))
            grad[:n] += 2 * penalty / len(y) * np.bincount(d_col, diff[d_at] * d_sign, minlength=n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:n], float(w[n])


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", features_kept: int = 2048,
        penalty: float = 4.0, ridge: float = 2e-5, support: int = 3) -> Model:
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    # equal texts are one row, toxic if any of them is marked so; at most 2 x per_class rows
    rows = rows.groupBy(F.coalesce(text_col, F.lit("")).alias(text_col)).agg(F.max("y").alias("y"), F.sum("weight").alias("weight"))
    rows = written(rows, "toxicity-sample")
    n1, n0 = (x or 0 for x in rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1.0)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    rate = (F.col("toxic") + 0.25) / (n1 + 0.5)
    other = (F.col("other") + 0.25) / (n0 + 0.5)
    best = (_counts(rows, text_col).where(F.col("toxic") >= support).where(rate > 4 * other)
            .orderBy(F.desc(rate * F.log(rate / other)), "feature").limit(features_kept).select("feature").collect())
    keys = np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))
    model = Model(keys, np.zeros(len(keys)), 0.0)
    ddl = "y int, weight double, found array<int>, twin array<int>"
    schema = arrow_schema(ddl)

    def per_row(buf, off):
        r, f = model.found(buf, off)
        return [x.tolist() for x in np.split(f, np.searchsorted(r, np.arange(1, len(off) - 1)))]

    def run(batches):
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                texts = part.column(0).to_pylist()
                named = [i for i, t in enumerate(texts) if _TERMS.search(t)]
                twin: list = [None] * len(texts)
                if named:
                    data = [swapped(texts[i]).encode() for i in named]
                    at = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
                    for i, f in zip(named, per_row(np.frombuffer(b"".join(data), np.uint8), at)):
                        twin[i] = f
                yield record(schema, y=part.column(1), weight=part.column(2), found=per_row(buf, off), twin=twin)

    got = rows.select(text_col, "y", "weight").mapInArrow(run, ddl).collect()     # feature numbers only: 2 x per_class rows at most
    got = sorted((r.y, r.found, r.twin is None, r.twin or [], r.weight) for r in got)
    data = [(y, np.array(f, int), None if none else np.array(t, int)) for y, f, none, t, _ in got]
    weights, offset = fit_weights(data, np.array([r[-1] for r in got]), len(keys), penalty, ridge)
    return Model(keys, weights, offset)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          folds: int | None = None, held_out: int = 0, per_class: int = 6_000, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Per document: id, the columns named in ``keep``, toxicity_score (0 to 1, higher: label 1 likelier).

    A kept column of that name is replaced.
    """
    sample = training_labels(labels, label, per_class, id_col, folds, held_out)
    model = fit(docs, sample, id_col, text_col, **options)
    held = docs.sparkSession.sparkContext.broadcast(model)          # bounded by ``features_kept``
    cols = [c for c in dict.fromkeys([id_col, *keep]) if c != "toxicity_score"]
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + ", toxicity_score double"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                yield record(schema, **{c: part.column(part.schema.get_field_index(c)) for c in cols},
                             toxicity_score=held.value.score(buf, off))

    return docs.select(*dict.fromkeys([*cols, text_col])).mapInArrow(run, ddl)

"""Isolation forest outlier count (PRE-4).

Each tree is grown on ``psi = min(256, n)`` rows chosen by a seeded hash:
rows are ranked per tree by ``xxhash64(seed, tree, row, copy)`` and the ``psi``
smallest kept; equal rows are numbered as copies 1, 2, ..., so each is drawn on its own.
Only hashes below a bound that about ``4 psi`` rows of a tree pass go into the ranking, so
it gets a few hundred rows per tree whatever the table size; the draw does not
depend on the layout of the table.  Trees grow
in ``groupBy(tree).applyInPandas`` (one small task per tree), are collected
(``trees x 2 psi`` nodes, bounded), and scoring runs on every row with
``mapInPandas``.  The flag threshold is the exact ``contamination``
quantile of the scores, as in the reference's fitted offset.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import attach_scalars, top_k_per_group
from ..functions.quantiles import exact_quantiles
from ..session import cut_lineage

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree long, node long, feature long, threshold double, left long, "
               "right long, size long, depth long")


def c_factor(n):
    """Average path length of an unsuccessful BST search over ``n`` points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes = []  # feature, threshold, left, right, size, depth

    def build(idx, depth):
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx), depth])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return me
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        nodes[me][0], nodes[me][1] = f, thr
        nodes[me][2] = build(left, depth + 1)
        nodes[me][3] = build(right, depth + 1)
        return me

    build(np.arange(x.shape[0]), 0)
    return nodes


def _grower(features: list[str], seed: int, max_depth: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        x = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes = _grow(x, rng, max_depth)
        a = np.asarray(nodes, dtype=float)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(nodes)), "feature": a[:, 0].astype(int),
                             "threshold": a[:, 1], "left": a[:, 2].astype(int),
                             "right": a[:, 3].astype(int), "size": a[:, 4].astype(int),
                             "depth": a[:, 5].astype(int)})
    return grow


def draws(copies: DataFrame, features: list[str], n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """``(features..., _tree, _u, _rid)``: draws of the rows' copies below the bound, for every tree.

    ``copies`` has each distinct row once with its count ``_n`` (``n`` in all).  Each copy of a row has a uniform draw per
    tree; only draws below ``4 psi / n`` can be among the tree's ``psi`` smallest.  The smallest of a row's draws
    follows from one hash by the law of the least of ``_n`` uniforms; rows whose least draw is above the bound are done, and
    the others' next draws follow one by one until they pass it.  So a row costs the same whatever its count.
    """
    bound = min(1.0, 4 * psi / max(n, 1))       # of 4 psi draws expected below it, fewer than psi never come (12 deviations)
    pairs = (copies.select(*features, "_n", F.xxhash64(*features).alias("_row"))
                   .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("_tree")))
    pairs = pairs.withColumn("_rid", F.xxhash64(F.lit(seed), "_tree", "_row"))
    share = (F.col("_rid").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    least = -F.expm1(F.log1p(-F.least(share, F.lit(1 - 2.0 ** -53))) / F.col("_n"))
    # the same bound on the hash itself, with room for rounding: all but some 4 psi pairs of a tree end at one comparison
    loose = -F.expm1(F.col("_n") * F.lit(math.log1p(-min(bound, 1 - 2.0 ** -53)))) * (1 + 1e-9) + 2.0 ** -52
    near = pairs.where((share <= loose) | F.lit(bound >= 1.0)).withColumn("_u", least).where(F.col("_u") <= bound)

    def rest(frames):
        for pdf in frames:
            at, values = [], []
            for i, (u, n_row, rid) in enumerate(zip(pdf["_u"], pdf["_n"], pdf["_rid"])):
                rng = np.random.default_rng([seed, int(rid) & (1 << 64) - 1])
                left = int(n_row)
                while u <= bound:
                    at.append(i)
                    values.append(u)
                    left -= 1
                    if left == 0:
                        break
                    u = u - (1 - u) * np.expm1(np.log1p(-rng.random()) / left)
            yield pdf.iloc[at].assign(_u=values)
    near = near.select(*features, "_tree", "_n", "_rid", "_u")
    return near.mapInPandas(rest, near.select("*").schema).drop("_n")


def fit_forest(x: DataFrame, features: list[str], n_trees: int = 100, psi: int = 256,
               seed: int = 42) -> tuple[list[dict], int]:
    """Grow the forest; returns per-tree node arrays (driver-side, bounded) and psi."""
    n = x.count()
    psi = min(psi, n)
    copies = x.groupBy(*features).agg(F.count(F.lit(1)).alias("_n"))
    chosen = top_k_per_group(draws(copies, features, n, n_trees, psi, seed), ["_tree"], [F.col("_u"), F.col("_rid")], psi,
                             salt_col="_u", rank_name="_k")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    nodes = (chosen.select("_tree", *features)
                   .groupBy("_tree").applyInPandas(_grower(features, seed, max_depth), NODE_SCHEMA)
                   .orderBy("tree", "node").toPandas())
    trees = []
    for _, g in nodes.groupby("tree"):
        trees.append({k: g[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size", "depth")})
    return trees, psi


SCORED = 4_096      # rows that walk the trees at a time


def _full_tree(tree: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(levels, feature, threshold, path length at the last level) of the tree filled up to equal depth: the children
    of place p are 2p + 1 and 2p + 2, and all places below a leaf have its path length."""
    levels = int(tree["depth"].max())
    at = np.zeros(1, int)       # the node at each place of a level, a leaf for all places below it
    feature, threshold = [], []
    for _ in range(levels):
        f = tree["feature"][at]
        feature.append(np.maximum(f, 0))
        threshold.append(tree["threshold"][at])
        at = np.column_stack([np.where(f < 0, at, tree["left"][at]), np.where(f < 0, at, tree["right"][at])]).ravel()
    empty = np.zeros(0)
    return (levels, np.concatenate([empty, *feature]).astype(np.intp), np.concatenate([empty, *threshold]),
            tree["depth"][at] + c_factor(tree["size"][at]))


def _path_lengths(columns: np.ndarray, full: tuple) -> np.ndarray:
    """Path length of each row in a filled-up tree; ``columns`` is (features, rows)."""
    levels, feature, threshold, length = full
    n = columns.shape[1]
    flat, row = columns.ravel(), np.arange(n)
    place = np.zeros(n, np.intp)
    for _ in range(levels):
        right = flat.take(feature.take(place) * n + row) >= threshold.take(place)
        place += place
        place += 1
        place += right
    return length.take(place - len(feature))


def score(x: DataFrame, features: list[str], trees: list[dict], psi: int,
          out: str = "iso_score") -> DataFrame:
    """``score_samples`` convention: ``-2^(-E[h(x)] / c(psi))`` (lower = more anomalous)."""
    norm = float(c_factor([psi])[0]) or 1.0
    full = [_full_tree(tr) for tr in trees]

    def run(batches):
        for pdf in batches:
            a = pdf[features].to_numpy(dtype=float)
            h = np.zeros(a.shape[0])
            for i in range(0, len(h), SCORED):
                part = np.ascontiguousarray(a[i:i + SCORED].T)
                for tr in full:
                    h[i:i + SCORED] += _path_lengths(part, tr)
            pdf[out] = -np.power(2.0, -(h / len(trees)) / norm)
            yield pdf

    schema = x.select(*features).schema.add(out, "double")
    return x.select(*features).mapInPandas(run, schema)


def isolation_forest_outliers(df: DataFrame, features: list[str], contamination: float = 0.05,
                              n_trees: int = 100, seed: int = 42) -> int:
    """Number of complete rows whose score falls below the ``contamination`` quantile."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in features]).na.drop()
    if not features:
        return 0
    trees, psi = fit_forest(x, features, n_trees, seed=seed)
    s = cut_lineage(score(x, features, trees, psi).select("iso_score"))
    thr = exact_quantiles(s.select(F.col("iso_score").alias("value")), [contamination], []).first()
    if thr is None:
        return 0
    return int(s.where(F.col("iso_score") < F.lit(thr["q"])).count())


def isolation_forest_flags(df: DataFrame, features: list[str], contamination: float = 0.05,
                           n_trees: int = 100, seed: int = 42) -> DataFrame:
    """Every row of ``df`` with ``iso_score`` and ``is_outlier`` (null where a feature is missing)."""
    whole = df.withColumns({f"_x{i}": F.col(c).cast("double") for i, c in enumerate(features)})
    x = whole.select(*[f"_x{i}" for i in range(len(features))]).na.drop().distinct()
    full = whole.select(*[f"_x{i}" for i in range(len(features))]).na.drop()
    trees, psi = fit_forest(full, full.columns, n_trees, seed=seed)
    s = cut_lineage(score(x, x.columns, trees, psi))
    rows = whole.join(s, x.columns, "left").drop(*x.columns)
    thr = exact_quantiles(rows.where(F.col("iso_score").isNotNull()).select(F.col("iso_score").alias("value")), [contamination], [])
    return attach_scalars(rows, thr.agg(F.max("q").alias("_t"))).withColumn("is_outlier", F.col("iso_score") < F.col("_t")).drop("_t")


def isolation_forest_table(df: DataFrame, features: list[str], contamination: float = 0.05,
                           n_trees: int = 100, seed: int = 42) -> DataFrame:
    """One row: ``(rows, flagged, threshold)`` for reporting."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in features]).na.drop()
    trees, psi = fit_forest(x, features, n_trees, seed=seed)
    s = cut_lineage(score(x, features, trees, psi).select("iso_score"))
    thr = exact_quantiles(s.select(F.col("iso_score").alias("value")), [contamination], [])
    return (attach_scalars(s, thr.select(F.col("q").alias("_t")))
             .agg(F.count(F.lit(1)).alias("rows"),
                  F.sum((F.col("iso_score") < F.col("_t")).cast("long")).alias("flagged"),
                  F.first("_t").alias("threshold")))

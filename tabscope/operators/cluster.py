"""Clustering with k selection and PCA (CLU-1..8).

Complete cases are standardised with the population std, k-means runs for every k and restart
together (one scan an iteration for all of them), and all k are scored by the silhouette of squared Euclidean
distances, linear in n.  Profiles are plain grouped aggregates on the unscaled values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import complete, first_by_hash
from ..session import cut_lineage

from .metrics import davies_bouldin
from .prep import standardize_pop

SCORE_SCHEMA = "k int, inertia double, silhouette double"


def cluster_profiles(df: DataFrame, cols: list[str], cluster: str = "cluster", digits: int = 3) -> DataFrame:
    """CLU-7 / AGG-14: size and per-column mean / sample std per cluster, rounded."""
    aggs = [F.count(F.lit(1)).cast("long").alias("size")]
    for c in cols:
        aggs += [(F.round(F.avg(c), digits) + 0.0).alias(f"{c}_mean"),
                 (F.round(F.stddev_samp(c), digits) + 0.0).alias(f"{c}_std")]
    return df.groupBy(cluster).agg(*aggs)


def prepare(df: DataFrame, cols: list[str], key_cols: list[str] | None = None) -> tuple[DataFrame, int]:
    """CLU-1: complete cases of ``cols``, standardised, assembled as ``features``."""
    from pyspark.ml.feature import VectorAssembler
    key_cols = key_cols or []
    d = complete(df.select(*key_cols, *[F.col(c).cast("double").alias(c) for c in cols]), cols)
    n = d.count()
    z = standardize_pop(d.select(*key_cols, *[F.col(c).alias(f"_z_{c}") for c in cols], *cols),
                        [f"_z_{c}" for c in cols])
    va = VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol="features")
    return va.transform(z), n


START_ROWS = 2_048      # sample (by hash) from which starting centres are drawn


def starting_centres(points: DataFrame, ks: list[int], restarts: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """k-means++ centres for each (k, restart), drawn from the ``START_ROWS`` distinct points with the smallest hashes."""
    rows = first_by_hash(points, ["x"], START_ROWS).collect()
    x = np.array([r["x"] for r in rows], float)
    out = {}
    for k in ks:
        for r in range(restarts):
            rng = np.random.default_rng((seed, k, r))
            chosen = [int(rng.integers(len(x)))]
            far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
            while len(chosen) < min(k, len(x)):
                share = far / far.sum() if far.sum() > 0 else np.full(len(x), 1 / len(x))
                chosen.append(int(rng.choice(len(x), p=share)))
                far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            out[k, r] = x[chosen]
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


STRIP = 4_096       # most points of a block of more than FLAT columns, and rows of a matrix of points by centres
ENTRIES = 1 << 18   # entries of the largest matrix of distances inside a task (2 MB)
FLAT = 8            # most columns of points that are kept near each other
BOX, BOXES = 64, 32         # points of a small box, small boxes of a large one
TREE = BOX << 12            # most points of a block that is cut into boxes
PART = 1 << 20              # points (about) of a part of such blocks


def _blocks(points: DataFrame) -> DataFrame:
    """``(b, n)``: the points in blocks, the doubles of ``n`` points one after the other as one binary value, dealt evenly over the cores.

    Points of up to ``FLAT`` columns are dealt by place: a block holds neighbours, in runs of ``BOX`` that lie close together, so
    that most runs lie nearer to one centre as a whole.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    one = points.select(F.size("x").alias("d")).first()
    if one and 0 < one["d"] <= FLAT:
        return _by_place(points, one["d"], 2 * cores)

    def pack(batches):
        for batch in batches:
            c = batch.column(0)
            for i in range(0, len(c), STRIP):
                part = c.slice(i, STRIP)
                yield _packed([_doubles(part)])
    return points.select("x").mapInArrow(pack, "b binary, n int").repartition(2 * cores)


def _doubles(arrays: pa.Array) -> np.ndarray:
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(arrays), -1)


def _packed(xs: list[np.ndarray], **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**more, "b": pa.array([x.tobytes() for x in xs], pa.binary()), "n": pa.array([len(x) for x in xs], pa.int32())})


def _by_place(points: DataFrame, d: int, least: int) -> DataFrame:
    """``_blocks`` by place: points are packed by cell of a grid of quantiles, cells that lie together go to one part, and there the points are put in boxes."""
    bits = 12 // d
    shares = F.array(*[F.lit(i / 2 ** bits) for i in range(1, 2 ** bits)])
    # the cuts only say which points are packed together: those of a 64th of the values do
    some = F.pmod(F.xxhash64("x"), F.lit(64)) == 0
    got = points.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.when(some, F.col("x")[i]), shares, 1_000).alias(f"q{i}") for i in range(d)]).first()
    edges = [np.array(got[f"q{i}"] or [], float) for i in range(d)]       # up to 2 ** bits - 1 cuts a column

    def cells(batches):
        def packed(xs):
            x, cell = np.concatenate(xs), 0
            codes = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
            for bit in range(bits):
                for i, c in enumerate(codes):
                    cell = cell + ((c >> bit & 1) << (bit * d + i))
            order = np.argsort(cell, kind="stable")
            names, first = np.unique(cell[order], return_index=True)
            return _packed(np.split(x[order], first[1:]), cell=pa.array(names, pa.int32()))
        kept, n = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(_doubles(batch.column(0)))
                n += batch.num_rows
            if n >= PART // 2:
                yield packed(kept)
                kept, n = [], 0
        if kept:
            yield packed(kept)

    def boxes(batches):
        def blocks(kept):
            x, i = np.concatenate([x for _, x in sorted(kept, key=lambda v: v[0])]), 0
            while i < len(x):
                size = min(TREE, BOX << int(np.log2((len(x) - i) // BOX))) if len(x) - i >= BOX else len(x) - i
                yield _packed([in_boxes(x[i:i + size])])
                i += size
        kept, n = [], 0
        for batch in batches:
            for cell, b, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kept.append((cell, np.frombuffer(b, float).reshape(rows, d)))
                n += rows
                if n >= PART:
                    yield from blocks(kept)
                    kept, n = [], 0
        if kept:
            yield from blocks(kept)

    dealt = points.select("x").mapInArrow(cells, "cell int, b binary, n int") \
        .repartitionByRange(max(least, -(-got["n"] // PART)), "cell", F.xxhash64("b"))      # a crowded cell goes to several parts
    return dealt.mapInArrow(boxes, "b binary, n int")


def in_boxes(x: np.ndarray) -> np.ndarray:
    """The points so that every ``BOX`` in a row lie close together, and so do every two, four, ... of these runs: halves by the
    widest column, again and again.  Needs ``BOX`` times a power of two points; others stay as they are."""
    if len(x) % BOX or (len(x) // BOX) & (len(x) // BOX - 1):
        return x
    size = len(x)
    while size > BOX:
        x = x.reshape(-1, size, x.shape[-1])
        widest = np.ptp(x, axis=1).argmax(axis=1)
        by = np.take_along_axis(x, widest[:, None, None], axis=2)[:, :, 0]
        x = np.take_along_axis(x, np.argpartition(by, size // 2, axis=1)[:, :, None], axis=1)
        size //= 2
    return x.reshape(-1, x.shape[-1])


def _whole(centres: np.ndarray, mid: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre nearest to the middle of each box, and whether it is nearer than all others to every point of the box."""
    size = (centres * centres).sum(axis=1)
    far = size[:, None] - 2 * centres @ mid
    near = far.argmin(axis=0)
    here = np.arange(len(near))
    gap = far - far[near, here]
    # the corner that lies farthest towards another centre
    reach = 2 * np.einsum("kbd,db->kb", np.abs(centres[:, None] - centres)[:, near], half)
    clear = gap > reach + 1e-9 * (size.max() + (mid * mid).sum(axis=0) + (half * half).sum(axis=0))
    clear[near, here] = True
    return near, clear.all(axis=0)


def _box_sums(x: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """(rows, sums, sums of squared norms) of the clusters of all runs, over a block in boxes.

    A box that lies nearer to one centre as a whole goes there by its sums; only the points of the others are compared.
    """
    d = x.shape[1]
    cols = np.ascontiguousarray(x.T)
    stat = np.vstack([np.ones(len(x)), cols, (cols * cols).sum(axis=0)])
    levels, low, high, sums = [], cols, cols, stat
    for size in (BOX, BOXES):
        low, high, sums = (v.reshape(len(v), -1, size) for v in (low, high, sums))
        low, high, sums = low.min(axis=2), high.max(axis=2), sums.sum(axis=2)
        levels.append(((low + high) / 2, (high - low) / 2, sums, size))
    out = []
    for centres in runs:
        k, total = len(centres), np.zeros((len(centres), d + 2))
        at = np.arange(levels[-1][0].shape[1])
        for mid, half, sums, size in reversed(levels):
            near, whole = _whole(centres, mid[:, at], half[:, at])
            total += ((near == np.arange(k)[:, None]) & whole).astype(float) @ sums[:, at].T
            at = (at[~whole][:, None] * size + np.arange(size)).ravel()
            if not len(at):
                break
        weights = np.column_stack([(centres * centres).sum(axis=1), -2 * centres])
        for i in range(0, len(at), STRIP):
            part = stat[:, at[i:i + STRIP]]
            far = weights @ part[:-1]
            mine = (far == far.min(axis=0)).astype(float)
            got = mine @ part.T
            if got[:, 0].sum() != part.shape[1]:        # a row between centres goes to the first
                got = (far.argmin(axis=0) == np.arange(k)[:, None]).astype(float) @ part.T
            total += got
        out.append(total)
    return np.concatenate(out)


def _points(batches):
    """The points of each block as a matrix."""
    for batch in batches:
        for b, n in zip(batch.column(0), batch.column(1).to_pylist()):
            yield np.frombuffer(b.as_buffer(), float).reshape(n, -1)


def _moments(blocks: DataFrame, runs: dict) -> dict:
    """One scan for all runs: {run: (rows, sums, sums of squared norms, inertia) of its clusters}, arrays by cluster."""
    names, d = list(runs), len(next(iter(runs.values()))[0])
    edges = np.cumsum([0] + [len(runs[n]) for n in names])
    together = np.concatenate([runs[n] for n in names])
    cells = int(edges[-1])
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast(together)     # not in every task's closure, and gone after the scan

    def gather(batches):
        centres, total = shared.value, np.zeros((cells, d + 2))
        # a row's squared distances to all centres less its own norm: one product
        weights = np.column_stack([(centres * centres).sum(axis=1), -2 * centres])
        step = max(64, ENTRIES // cells)
        for x in _points(batches):
            if x.shape[1] <= FLAT and len(x) % (BOX * BOXES) == 0:
                total += _box_sums(x, [centres[a:b] for a, b in zip(edges[:-1], edges[1:])])
                continue
            for i in range(0, len(x), step):
                part = x[i:i + step]
                extra = np.column_stack([np.ones(len(part)), part, (part * part).sum(axis=1)])
                far = weights @ extra[:, :-1].T
                mine = np.empty_like(far)
                for a, b in zip(edges[:-1], edges[1:]):
                    np.equal(far[a:b], far[a:b].min(axis=0), out=mine[a:b])
                got = mine @ extra
                for run in np.flatnonzero(np.add.reduceat(got[:, 0], edges[:-1]) != len(part)):     # a row between centres goes to the first
                    a, b = edges[run], edges[run + 1]
                    got[a:b] = (far[a:b].argmin(axis=0) == np.arange(b - a)[:, None]).astype(float) @ extra
                total += got
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells, dtype=np.int32)),
                                          **{f"s{j}": pa.array(np.ascontiguousarray(total[:, j])) for j in range(d + 2)}})

    ddl = "cell int, " + ", ".join(f"s{j} double" for j in range(d + 2))
    got = np.zeros((cells, d + 2))
    for r in blocks.mapInArrow(gather, ddl).groupBy("cell").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(d + 2)]).collect():
        got[r["cell"]] = r[1:]          # a row per centre
    shared.destroy()
    n, sums, norms = got[:, 0], got[:, 1:-1], got[:, -1]
    inertia = np.maximum(norms - 2 * (sums * together).sum(axis=1) + n * (together * together).sum(axis=1), 0.0)
    return {r: (n[a:b], sums[a:b], norms[a:b], inertia[a:b]) for r, a, b in zip(names, edges[:-1], edges[1:])}


def fit_many(points: DataFrame, ks: list[int], restarts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
             blocks: DataFrame | None = None) -> dict[int, np.ndarray]:
    """The centres of the best restart (least inertia) for each k.

    Lloyd's iterations of all (k, restart) runs go together: one scan of ``points`` (a column ``x``, array of double)
    moves the centres of every run that still moves; a run stops when its centres move by ``tol`` of the mean
    variance or less.  A centre without rows stays where it is.  Only the centres are on the driver.  ``blocks``: the points
    packed, if the caller has them.
    """
    runs = starting_centres(points, ks, restarts, seed)
    blocks = blocks or cut_lineage(_blocks(points))       # read by every iteration
    active, spread = set(runs), None
    for _ in range(max_iter):
        if not active:
            break
        for run, (n, sums, norms, _) in _moments(blocks, {r: runs[r] for r in sorted(active)}).items():
            if spread is None:      # mean variance of the columns
                spread = (norms.sum() / n.sum() - ((sums.sum(axis=0) / n.sum()) ** 2).sum()) / sums.shape[1]
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], runs[run])
            if ((new - runs[run]) ** 2).sum() <= tol * spread:
                active.discard(run)
            runs[run] = new
    last = _moments(blocks, runs)
    best = {k: min((r for r in runs if r[0] == k), key=lambda r: (last[r][3].sum(), r)) for k in ks}
    return {k: runs[r] for k, r in best.items()}


def centre_scores(points: DataFrame, centres: dict[int, np.ndarray], blocks: DataFrame | None = None) -> DataFrame:
    """CLU-2, CLU-4: ``(k, inertia, silhouette)`` of given centres, for all k in two scans.

    The silhouette is that of squared Euclidean distances: a row's mean distance to a cluster follows from the cluster's row
    count, sum and squared norms.  A row alone in its cluster counts 0.
    """
    blocks = blocks or _blocks(points)
    stats = _moments(blocks, centres)

    def gather(batches):
        total = {k: 0.0 for k in centres}
        for x in (x[i:i + STRIP] for x in _points(batches) for i in range(0, len(x), STRIP)):
            norm, row = (x * x).sum(axis=1), np.arange(len(x))
            for k, c in centres.items():
                n, sums, norms, _ = stats[k]
                at = np.maximum((c * c).sum(axis=1)[:, None] - 2 * c @ x.T + norm, 0.0).argmin(axis=0)
                full = np.maximum(n[:, None] * norm + norms[:, None] - 2 * sums @ x.T, 0.0)      # sums of distances
                mine = full[at, row] / np.maximum(n[at] - 1, 1)
                mean = full / np.maximum(n, 1)[:, None]
                mean[n == 0] = np.inf
                mean[at, row] = np.inf
                other = mean.min(axis=0)
                good = (n[at] > 1) & np.isfinite(other) & (np.maximum(mine, other) > 0)
                total[k] += ((other - mine)[good] / np.maximum(mine, other)[good]).sum()
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(total), pa.int32()), "s": pa.array(list(total.values()), pa.float64())})

    sil = {r["k"]: r["s"] for r in blocks.mapInArrow(gather, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    rows = [(k, float(stats[k][3].sum()), float(sil[k] / stats[k][0].sum())) for k in centres]
    return points.sparkSession.createDataFrame(rows, SCORE_SCHEMA)


def nearest_centre(centres: np.ndarray):
    """Column function: the index of the centre nearest to an array column."""
    @F.pandas_udf("int")
    def at(x: pd.Series) -> pd.Series:
        return pd.Series(_distances(np.stack(x.to_numpy()).astype(float), centres).argmin(axis=1).astype(np.int32)) if len(x) else pd.Series([], dtype="int32")
    return at


def pca(data: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """CLU-5: projection on the first ``k`` components and explained-variance ratios.

    Input is standardised, so centring is not an issue; each component's sign
    is fixed so that its largest-magnitude loading is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    m = PCA(k=k, inputCol="features", outputCol="_pc").fit(data)
    pc = m.pc.toArray()
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(k)]
    proj = m.transform(data).withColumn("_a", vector_to_array("_pc"))
    out = proj.select("*", *[(F.col("_a")[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)]) \
              .drop("_a", "_pc")
    return out, [float(v) for v in m.explainedVariance.toArray()]


def cluster_analysis(df: DataFrame, cols: list[str], max_k: int = 10, restarts: int = 10,
                     seed: int = 42, method: str = "kmeans") -> dict[str, DataFrame] | None:
    """The whole analysis: scores per k, best k (max silhouette, ties to smaller k),
    labels, sizes, unscaled profiles, Davies–Bouldin and PCA.  ``None`` when fewer
    than 5 complete rows or 2 columns."""
    from pyspark.ml.functions import vector_to_array
    if len(cols) < 2:
        return None
    data, n = prepare(df, cols)
    if n < 5:
        return None
    data = cut_lineage(data)  # read by every iteration
    hi = min(max_k, max(2, n // 10))
    points = data.select(vector_to_array("features").alias("x"))
    blocks = cut_lineage(_blocks(points))   # read by every iteration and by the scores
    centres = fit_many(points, list(range(2, hi + 1)), restarts, seed, blocks=blocks)
    scores = centre_scores(points, centres, blocks)
    best_k = scores.orderBy(F.col("silhouette").desc(), "k").first()["k"]
    if method == "kmeans":
        lab = data.withColumn("cluster", nearest_centre(centres[best_k])(vector_to_array("features")))
    else:  # CLU-8: divisive hierarchical stand-in
        from pyspark.ml.clustering import BisectingKMeans
        lab = BisectingKMeans(k=best_k, seed=seed).fit(data).transform(data).withColumnRenamed("prediction", "cluster")
    zcols = [f"_z_{c}" for c in cols]
    db = davies_bouldin(lab, zcols, "cluster")
    sizes = lab.groupBy("cluster").agg(F.count(F.lit(1)).cast("long").alias("size"))
    prof = cluster_profiles(lab, cols)
    proj, ratio = pca(lab, 2)
    spark = df.sparkSession
    summary = spark.createDataFrame(
        [(int(best_k), method, ratio[0], ratio[1] if len(ratio) > 1 else None)],
        "best_k int, method string, pc1_ratio double, pc2_ratio double")
    return {"scores": scores, "summary": summary, "davies_bouldin": db, "sizes": sizes,
            "profiles": prof, "projection": proj.select("cluster", "pc1", "pc2")}

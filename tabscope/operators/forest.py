"""Random-forest importance of binned features, grown by levels on Spark and finished in tasks.

Every feature is cut into at most ``BINS`` bins once.  A row's weight in a tree is a Poisson(1) draw from a hash of its
number and the tree, so a task that runs again draws the same.  Nodes of more than ``SUBTREE`` rows are split level by
level: each task sums (weight, label) by bin for all open nodes of all trees, the sums of a node meet in one group.  Once a
node holds at most ``SUBTREE`` rows, its rows are sent to one group, which grows the rest of that subtree.  So no group
holds more than ``SUBTREE`` rows, and the sums of a node are kept only while it is split.

Splits, leaves and importance are MLlib's: variance or Gini gain over all cuts, first best feature and cut, no gain is a
leaf, sibling leaves of one prediction are one leaf, importance is gain x weight, scaled to 1 a tree and over all trees.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import quoted, spread
from ..functions.quantiles import tall
from ..session import cut_lineage
from .roles import distinct_counts

BINS = 32
SUBTREE = 1 << 15       # rows of a subtree that one group grows
U64 = np.uint64
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * M2
    x = (x ^ (x >> U64(27))) * M3
    return x ^ (x >> U64(31))


def weights(rid: np.ndarray, tree: int, seed: int, bootstrap: bool = True) -> np.ndarray:
    """How often each row is drawn for a tree (once without ``bootstrap``)."""
    if not bootstrap:
        return np.ones(len(rid), np.uint8)
    h = _mix(_mix(rid.astype(U64) * M1 + U64(seed)) + np.array([tree + 1], U64) * M1)
    return np.searchsorted(POISSON, (h >> U64(11)) * 2.0 ** -53, side="right").astype(np.uint8)


def _allowed(heap: np.ndarray, tree: int, features: int, take: int, seed: int) -> np.ndarray:
    """(nodes, features): the ``take`` features each node may split on."""
    if take >= features:
        return np.ones((len(heap), features), bool)
    node = _mix(heap.astype(U64) * M1 + np.array([tree + 1], U64) * M2 + U64(seed))
    h = _mix(node[:, None] + np.arange(1, features + 1, dtype=U64) * M1)
    out = np.zeros(h.shape, bool)
    np.put_along_axis(out, np.argpartition(h, take - 1, axis=1)[:, :take], True, axis=1)
    return out


def _labels(y: np.ndarray, classes: int) -> np.ndarray:
    """(columns, rows): the label itself, or a 0/1 column for each class."""
    return (y == np.arange(classes)[:, None]).astype(float) if classes else y[None, :]


def best_cut(w: np.ndarray, s: np.ndarray, total: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cut of one feature in each node and its score, from weights (nodes, bins) and label sums (columns, nodes, bins)."""
    left = np.cumsum(w, axis=1)[:, :-1]
    right = total[:, None] - left
    score = np.zeros(left.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        for column, whole in zip(s, sums):
            low = np.cumsum(column, axis=1)[:, :-1]
            score += low * low / left + (whole[:, None] - low) ** 2 / right
    score[(left <= 0) | (right <= 0)] = -np.inf
    at = score.argmax(axis=1)
    return at, score[np.arange(len(at)), at]


def _prediction(total: np.ndarray, sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.argmax(axis=0).astype(float) if classes else sums[0] / total


def merged(split: list, gain: list, feature: list, prediction: list, features: int) -> tuple[float | None, np.ndarray]:
    """The prediction if all levels are one leaf, and the gain of every feature.

    Level by level, the children of the split nodes of a level stand in pairs in the next; two leaves of one prediction are one leaf.
    """
    gains = np.zeros(features)
    leaf = lower = None
    for s, g, f, p in zip(reversed(split), reversed(gain), reversed(feature), reversed(prediction)):
        here, value = ~s, p.copy()
        if s.any():
            one = leaf[0::2] & leaf[1::2] & (lower[0::2] == lower[1::2])
            at = np.flatnonzero(s)
            here[at], value[at[one]] = one, lower[0::2][one]
            np.add.at(gains, f[at[~one]], g[at[~one]])
        leaf, lower = here, value
    return (float(lower[0]) if leaf[0] else None), gains


def grow(bins: np.ndarray, w: np.ndarray, y: np.ndarray, widths: list[int], tree: int, heap: int, depth: int, plan: dict):
    """A whole subtree over its rows: ``merged`` of its levels."""
    features, classes = len(widths), plan["classes"]
    w = w.astype(float)
    columns = _labels(y, classes) * w
    square = w * y * y if not classes else w        # a 0/1 column is its own square
    columns_of = np.ascontiguousarray(bins.T)
    node, heaps = np.zeros(len(w), np.int64), np.array([heap], np.int64)
    levels: list[tuple] = []
    while True:
        k = len(heaps)
        total = np.bincount(node, w, k)
        sums = np.array([np.bincount(node, c, k) for c in columns])
        base = (sums * sums / total).sum(axis=0)
        least = plan["least"] * total
        feature, cut, gain = np.full(k, -1), np.zeros(k, np.int64), least.copy()
        live = np.bincount(node, square, k) - base > least
        if depth < plan["max_depth"] and live.any():
            # pure nodes are leaves: only the others are numbered and searched
            number = np.cumsum(live) - 1
            rows = np.flatnonzero(live[node])
            sub, n = number[node[rows]], int(live.sum())
            wr, cr = w[rows], columns[:, rows]
            allowed = _allowed(heaps[live], tree, features, plan["take"], plan["seed"])
            f_, c_, g_ = feature[live], cut[live], gain[live]
            for f, width in enumerate(widths):
                if width < 2:
                    continue
                slot = sub * width + columns_of[f][rows]
                hist = np.bincount(slot, wr, n * width).reshape(n, width)
                hists = [np.bincount(slot, c, n * width).reshape(n, width) for c in cr]
                at, score = best_cut(hist, hists, total[live], sums[:, live])
                score -= base[live]
                better = (score > g_) & allowed[:, f]
                f_[better], c_[better], g_[better] = f, at[better], score[better]
            feature[live], cut[live], gain[live] = f_, c_, g_
        split = feature >= 0
        levels.append((split, gain, feature, _prediction(total, sums, classes)))
        if not split.any():
            break
        keep = np.flatnonzero(split[node])
        at = node[keep]
        high = bins[keep, feature[at]] > cut[at]
        node = 2 * (np.cumsum(split) - 1)[at] + high
        bins, columns_of, w, columns, square = bins[keep], columns_of[:, keep], w[keep], columns[:, keep], square[keep]
        heaps = (2 * heaps[split][:, None] + np.arange(2)).ravel()
        depth += 1
    return merged(*zip(*levels), features)


def _edges(x: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Ascending cuts of each feature: every value but the largest, of more than ``BINS`` values the quantiles."""
    from .features import cut_points
    n = {r["column_name"]: r["n_distinct"] for r in distinct_counts(x, names).collect()}
    few = [c for c in names if n.get(c, 0) <= BINS]
    edges = cut_points(x, [c for c in names if c not in few], BINS) if len(few) < len(names) else {}
    values: dict[str, list] = {c: [] for c in few}
    if few:
        for r in tall(x, few).where(F.col("value").isNotNull()).distinct().collect():     # at most BINS rows a feature
            values[r["variable"]].append(r["value"])
    return [np.array(sorted(values[c])[:-1] if c in values else edges.get(c, []), float) for c in names]


def _binned(x: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    schema = pa.schema([("rid", pa.int64()), ("y", pa.float64()), ("bins", pa.binary())])

    def run(batches):
        for b in batches:
            cols = [np.searchsorted(e, b.column(i + 2).to_numpy(zero_copy_only=False), side="left") for i, e in enumerate(edges)]
            bins = np.stack(cols, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in bins], pa.binary())], schema=schema)

    return x.select(F.monotonically_increasing_id().alias("rid"), "y", *[f"f{i}" for i in range(len(edges))]) \
            .mapInArrow(run, "rid long, y double, bins binary")


class _Top:
    """The upper nodes of one tree, as arrays of a row each; a node is open, local (its rows go to one group) or a leaf."""

    def __init__(self, state: str):
        self.feature, self.cut, self.child, self.heap, self.depth = [-1], [0], [-1], [1], [0]
        self.state, self.gain, self.prediction = [state], [0.0], [0.0]

    def add(self, state: str, parent: int, high: int, prediction: float) -> None:
        for name, value in (("feature", -1), ("cut", 0), ("child", -1), ("heap", 2 * self.heap[parent] + high),
                            ("depth", self.depth[parent] + 1), ("state", state), ("gain", 0.0), ("prediction", prediction)):
            getattr(self, name).append(value)

    def at(self, state: str) -> list[int]:
        return [i for i, s in enumerate(self.state) if s == state]

    def routes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.child)


def _route(bins: np.ndarray, routes: tuple) -> np.ndarray:
    """The upper node each row lies in."""
    feature, cut, child = routes
    at = np.zeros(len(bins), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        here = at[inner]
        at[inner] = child[here] + (bins[inner, feature[here]] > cut[here])


def _drawn(data: DataFrame, tops: list[_Top], state: str, features: int, plan: dict, make, ddl: str) -> DataFrame:
    """Rows ``make(node, first, bins, w, y)`` of each batch, for each node of ``state`` that has drawn rows there."""
    routes = [t.routes() for t in tops]
    wanted = [np.array([s == state for s in t.state]) for t in tops]
    trees = len(tops)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rid, y = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            bins = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, features)
            for t in range(trees):
                if not wanted[t].any():
                    continue
                w = weights(rid, t, plan["seed"], plan["bootstrap"])
                rows = np.flatnonzero(w)
                node = _route(bins[rows], routes[t])
                rows, node = rows[wanted[t][node]], node[wanted[t][node]]
                order = np.argsort(node, kind="stable")
                rows, node = rows[order], node[order]
                names, start = np.unique(node, return_index=True)
                out = [make(t << 32 | int(k), int(rid[0]), bins[r], w[r], y[r])
                       for k, r in zip(names, np.split(rows, start[1:]))]
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    return data.mapInArrow(run, ddl)


def _level(data: DataFrame, tops: list[_Top], widths: list[int], plan: dict):
    """The best split of every open node, from sums by bin."""
    features, classes = len(widths), plan["classes"]
    first = np.concatenate([[0], np.cumsum(widths)])
    slots = int(first[-1])

    def sums(node, start, bins, w, y):
        cols = np.concatenate([w[None, :].astype(float), _labels(y, classes) * w])
        slot = (bins + first[:-1]).ravel()
        return {"node": node, "first": start, "part": b"".join(np.bincount(slot, np.repeat(c, features), slots).tobytes() for c in cols)}

    heap = {(t, i): top.heap[i] for t, top in enumerate(tops) for i in top.at("open")}
    ddl = "node long, feature int, cut int, gain double, prediction double, low double, high double, low_p double, high_p double"
    schema = pa.schema([("node", pa.int64()), ("feature", pa.int32()), ("cut", pa.int32()),
                        *[(c, pa.float64()) for c in ("gain", "prediction", "low", "high", "low_p", "high_p")]])

    def split(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        parts = sorted(zip(table.column("first").to_pylist(), table.column("part").to_pylist()))
        hist = sum(np.frombuffer(p, float) for _, p in parts).reshape(-1, slots)
        one = hist[:, first[0]:first[1]]        # any feature's bins hold all rows
        total, whole = one[:1].sum(axis=1), one[1:].sum(axis=1)[:, None]
        base, best = float((whole * whole / total).sum()), (plan["least"] * float(total[0]), -1, 0)
        tree = node >> 32
        allowed = _allowed(np.array([heap[tree, node & 0xFFFFFFFF]]), tree, features, plan["take"], plan["seed"])[0]
        for f in np.flatnonzero(allowed & (np.array(widths) > 1)):
            h = hist[:, first[f]:first[f + 1]]
            at, score = best_cut(h[:1], h[1:, None], total, whole)
            if score[0] - base > best[0]:
                best = (float(score[0] - base), int(f), int(at[0]))
        gain, f, cut = best
        low = hist[:, first[f]:first[f] + cut + 1].sum(axis=1) if f >= 0 else np.ones(len(hist))
        both = np.concatenate([total, whole[:, 0]])
        high = both - low if f >= 0 else low
        p = [float(_prediction(v[:1], v[1:, None], classes)[0]) for v in (both, low, high)]
        return pa.table([[v] for v in (node, f, cut, gain, p[0], float(low[0]), float(high[0]), p[1], p[2])], schema=schema)

    return (_drawn(data, tops, "open", features, plan, sums, "node long, first long, part binary")
            .groupBy("node").applyInArrow(split, ddl).collect())     # a row for each upper node, as MLlib keeps all nodes


def _finish(data: DataFrame, tops: list[_Top], widths: list[int], n: int, plan: dict) -> DataFrame:
    """``(node, leaf, gains)`` of every local node: its subtree grown in one group."""
    features = len(widths)
    places = {(t, i): (top.heap[i], top.depth[i]) for t, top in enumerate(tops) for i in top.at("local")}

    def rows(node, start, bins, w, y):
        return {"node": node, "first": start, "bins": bins.tobytes(), "w": w.tobytes(), "y": y.astype(float).tobytes()}

    schema = pa.schema([("node", pa.int64()), ("leaf", pa.float64()), ("gains", pa.list_(pa.float64()))])

    def subtree(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("first", "bins", "w", "y"))))
        bins, w, y = (b"".join(p[i] for p in parts) for i in (1, 2, 3))
        leaf, gains = grow(np.frombuffer(bins, np.uint8).reshape(-1, features), np.frombuffer(w, np.uint8), np.frombuffer(y, float),
                           widths, node >> 32, *places[node >> 32, node & 0xFFFFFFFF], plan)
        return pa.table([[node], [leaf], [gains.tolist()]], schema=schema)

    parts = max(1, min(len(places), 2000, -(-n * len(tops) // 50_000)))
    return (_drawn(data, tops, "local", features, plan, rows, "node long, first long, bins binary, w binary, y binary")
            .repartition(parts, "node").groupBy("node").applyInArrow(subtree, "node long, leaf double, gains array<double>"))


def forest_importance(x: DataFrame, label: str, names: list[str], classes: int = 0, trees: int = 100, take: int | None = None,
                      max_depth: int = 30, seed: int = 42, bootstrap: bool = True, subtree: int = SUBTREE) -> np.ndarray:
    """Importance of ``names`` for ``label`` (``classes`` codes from 0, or a number if 0), summing to 1 (or all 0)."""
    x = x.select(F.col(quoted(label)).cast("double").alias("y"), *[F.col(quoted(c)).cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    x = cut_lineage(x)
    n, mean, var = x.agg(F.count(F.lit(1)), F.avg("y"), F.var_pop("y")).first()
    x = cut_lineage(spread(x, n)) if n > 25_000 else x
    edges = _edges(x, [f"f{i}" for i in range(len(names))])
    if not classes:
        x = x.withColumn("y", F.col("y") - F.lit(mean))     # sums of squares about the mean lose no digits
    data = cut_lineage(_binned(x, edges))
    widths = [len(e) + 1 for e in edges]
    # gains of rounding errors only are none
    plan = {"classes": classes, "take": take or len(names), "max_depth": max_depth, "seed": seed, "bootstrap": bootstrap,
            "least": 1e-12 * (1.0 if classes else var or 0.0)}
    tops = [_Top("open" if n > subtree else "local") for _ in range(trees)]
    while any(t.at("open") for t in tops):
        for r in _level(data, tops, widths, plan):
            top, i = tops[r["node"] >> 32], r["node"] & 0xFFFFFFFF
            top.prediction[i], top.state[i] = r["prediction"], "leaf"
            if r["feature"] >= 0 and top.depth[i] < max_depth:
                top.feature[i], top.cut[i], top.gain[i], top.child[i] = r["feature"], r["cut"], r["gain"], len(top.state)
                top.state[i] = "split"
                for high, size, p in ((0, r["low"], r["low_p"]), (1, r["high"], r["high_p"])):
                    top.add("local" if size <= subtree else "open", i, high, p)
    done = _finish(data, tops, widths, n, plan)
    done = cut_lineage(done.select((F.col("node") / 2 ** 32).cast("long").alias("tree"), F.col("node").bitwiseAND(0xFFFFFFFF).alias("at"), "leaf", "gains"))
    gains = np.zeros((trees, len(names)))
    for r in done.select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g")).collect():
        gains[r["tree"], r["f"]] += r["g"]
    leaves = {(r["tree"], r["at"]): r["leaf"] for r in done.where(F.col("leaf").isNotNull()).select("tree", "at", "leaf").collect()}
    for t, top in enumerate(tops):
        one = {i: top.prediction[i] for i in top.at("leaf")} | {i: leaves[t, i] for i in top.at("local") if (t, i) in leaves}
        for i in reversed(top.at("split")):
            a = top.child[i]
            if a in one and a + 1 in one and one[a] == one[a + 1]:
                one[i] = one[a]
            else:
                gains[t, top.feature[i]] += top.gain[i]
    whole = gains.sum(axis=1, keepdims=True)
    out = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(axis=0)
    return out / out.sum() if out.sum() > 0 else out

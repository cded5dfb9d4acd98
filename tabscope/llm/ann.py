"""Nearest neighbours by largest inner product: an NN-descent graph and greedy search on it.

Vectors are dealt by a hash of their id into shards of about ``shard_rows``, so no task's memory
follows the table.  In a shard each vector starts with random neighbours; then, round by round, a Spark join of the
neighbour table with itself yields neighbours of neighbours (forward and reverse, at least one of the two edges new),
these are scored, and the best ``degree`` stay, until fewer than ``settle`` of the edges change.  A query walks the graph of
every shard greedily from a fixed sample: it expands the best vectors of a beam that it has not expanded yet until
none is left.  The best of all shards are merged; every returned score is the inner product in double precision.

For the graph a component sqrt(M^2 - |x|^2) is added (M: the largest norm), which makes largest inner product
nearest in Euclid's sense; queries have 0 there.  Equal vectors are one node, expanded to its smallest ids at the end, so a crowd
of copies neither fills a graph nor a beam.

Nulls and ties: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those
whose length is not the most common one, nor rows with a null id; of rows with one id the smallest vector stands.  Equal scores go
to the smaller id.  An empty table, or one without a query, gives no row.  Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import top_k_per_group
from .common import arrow_schema, written

PAIRS = 1 << 15         # pairs whose vectors are gathered at a time
TASK_PAIRS = 1 << 19    # pairs of a shard that meet in one task (about)
EDGES = "shard int, u long, v long, s float, new boolean"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, one per id."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & v.isNotNull()).where(~bad).where(F.exists(v, lambda x: x != 0)))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (common.n if common else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(table: pa.Table, column: str = "vec") -> np.ndarray:
    c = table.column(column).combine_chunks()
    return c.flatten().to_numpy().reshape(len(c), -1)


def _augmented(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, largest ** 2 - (x * x).sum(axis=1)))
    return np.column_stack([x, rest]).astype(np.float32)


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, new: np.ndarray, degree: int):
    """The ``degree`` best edges of each u; of equal edges the old one stays."""
    order = np.lexsort((new, v, u))
    u, v, s, new = u[order], v[order], s[order], new[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s, new = u[first], v[first], s[first], new[first]
    order = np.lexsort((v, -s, u))
    u, v, s, new = u[order], v[order], s[order], new[order]
    begin = np.searchsorted(u, u, side="left")
    top = np.arange(len(u)) - begin < degree
    return u[top], v[top], s[top], new[top]


def _inner(x: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows."""
    out = np.empty(len(u), x.dtype)
    for i in range(0, len(u), PAIRS):
        np.einsum("ij,ij->i", x[u[i:i + PAIRS]], x[v[i:i + PAIRS]], out=out[i:i + PAIRS])
    return out


def build_graph(nodes: DataFrame, largest: float, degree: int = 20, reverse: int = 12, settle: float = 0.002, rounds: int = 12) -> DataFrame:
    """Edges (shard, u, v, s, new) of the neighbour graph of ``nodes`` (shard, node, vec)."""
    schema = arrow_schema(EDGES)

    def start(table: pa.Table) -> pa.Table:
        node = np.sort(table.column("node").to_numpy())
        order = np.argsort(table.column("node").to_numpy())
        x = _augmented(_matrix(table)[order], largest)
        n, rng = len(node), np.random.default_rng(int(table.column("shard")[0].as_py()))
        k = min(degree, n - 1)
        u = np.repeat(np.arange(n), k)
        v = (u + (rng.integers(1, n, len(u)) if n > 1 else 0)) % max(1, n)
        u, v, s, new = _best(u, v, _inner(x, u, v), np.ones(len(u), bool), degree)
        return pa.table([np.full(len(u), table.column("shard")[0].as_py(), np.int32), node[u], node[v], s, new], schema=schema)

    def improve(found: pa.Table, table: pa.Table) -> pa.Table:
        """The best edges of the old ones and this part's pairs."""
        node = np.sort(table.column("node").to_numpy())
        x = _augmented(_matrix(table)[np.argsort(table.column("node").to_numpy())], largest)
        u, v = (np.searchsorted(node, found.column(c).to_numpy()) for c in ("u", "v"))
        s = found.column("s").to_numpy(zero_copy_only=False)
        old = ~np.isnan(s)
        pair = np.unique(u[~old] * len(node) + v[~old])
        a, b = pair // max(1, len(node)), pair % max(1, len(node))
        u, v, s = u[old], v[old], s[old]
        # only pairs better than the worst kept edge of either end can enter
        worst = np.full(len(node), -np.inf, np.float32)
        full = np.flatnonzero(np.bincount(u, minlength=len(node)) >= degree)
        low = np.full(len(node), np.inf, np.float32)
        np.minimum.at(low, u, s)
        worst[full] = low[full]
        us, vs, ss = [u], [v], [s]
        for i in range(0, len(a), PAIRS):
            p, q = a[i:i + PAIRS], b[i:i + PAIRS]
            t = _inner(x, p, q)
            for e, f in ((p, q), (q, p)):
                ok = t > worst[e]
                us.append(e[ok])
                vs.append(f[ok])
                ss.append(t[ok])
        new = np.ones(sum(map(len, us)), bool)
        new[:len(u)] = False
        u, v, s, new = _best(np.concatenate(us), np.concatenate(vs), np.concatenate(ss), new, degree)
        shard = table.column("shard")[0].as_py()
        return pa.table([np.full(len(u), shard, np.int32), node[u], node[v], s, new], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        node, at = np.unique(np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()]), return_inverse=True)
        u, v, s, new = _best(at[:table.num_rows], at[table.num_rows:], table.column("s").to_numpy(),
                             table.column("new").to_numpy(zero_copy_only=False), degree)
        return pa.table([np.full(len(u), table.column("shard")[0].as_py(), np.int32), node[u], node[v], s, new], schema=schema)

    # a shard's pairs are dealt over parts, each of which sees the shard's vectors and old edges; a merge follows
    largest_shard = nodes.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest_shard * (degree + reverse) * (degree + reverse - 1) // 2 // TASK_PAIRS))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = nodes.withColumn("part", every)
    edges = written(nodes.groupBy("shard").applyInArrow(start, EDGES), "ann-edges")
    for _ in range(rounds):
        place = F.row_number().over(Window.partitionBy("shard", "u").orderBy(F.desc("new"), F.xxhash64("u", "v"), "v"))
        back = (edges.select("shard", F.col("v").alias("u"), F.col("u").alias("v"), "new")
                .withColumn("place", place).where(F.col("place") <= reverse).drop("place"))
        ring = edges.select("shard", "u", "v", "new").union(back)
        a, b = ring.alias("a"), ring.alias("b")
        far = (a.join(b, (F.col("a.shard") == F.col("b.shard")) & (F.col("a.u") == F.col("b.u")) & (F.col("a.v") < F.col("b.v"))
                      & (F.col("a.new") | F.col("b.new")))
               .select("a.shard", F.col("a.v").alias("u"), F.col("b.v").alias("v"), F.lit(float("nan")).cast("float").alias("s"),
                       F.pmod(F.xxhash64("a.v", "b.v"), F.lit(parts)).cast("int").alias("part")))
        found = far.union(edges.select("shard", "u", "v", "s", every.alias("part")))
        better = found.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(improve, EDGES)
        edges = written(better.groupBy("shard").applyInArrow(merge, EDGES) if parts > 1 else better, "ann-edges")
        total, changed = edges.agg(F.count("*"), F.coalesce(F.sum(F.col("new").cast("long")), F.lit(0))).first()
        if changed <= settle * total:
            break
    return edges


def greedy(x: np.ndarray, near: np.ndarray, q: np.ndarray, beam: int, expand: int = 4, first: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Beam of best rows of ``x`` for each query and their scores, walking ``near`` (rows x neighbours, padded with the row itself)."""
    n, m = len(x), len(q)
    beam = min(beam, n)
    seed = np.random.default_rng(5).permutation(n)[:max(first, beam)]
    s = q @ x[seed].T
    top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
    ids, score = seed[top], np.take_along_axis(s, top, axis=1)
    seen = np.zeros((m, n), bool)
    seen[:, seed] = True
    done = np.zeros((m, beam), bool)
    active = np.arange(m)
    while len(active):
        rows = np.arange(len(active))[:, None]
        cur, sc, dn = ids[active], score[active], done[active]
        e = min(expand, beam)
        pick = np.argpartition(-np.where(dn, -np.inf, sc), e - 1, axis=1)[:, :e]
        fresh = ~dn[rows, pick]
        dn[rows, pick] = True
        cand = near[cur[rows, pick]].reshape(len(active), -1)
        known = seen[active[:, None], cand] | np.repeat(~fresh, near.shape[1], axis=1)
        # a candidate met twice in one step counts once
        order = np.argsort(cand, axis=1, kind="stable")
        sorted_c = np.take_along_axis(cand, order, axis=1)
        twice = np.zeros_like(known)
        np.put_along_axis(twice, order[:, 1:], sorted_c[:, 1:] == sorted_c[:, :-1], axis=1)
        known |= twice
        at, col = np.nonzero(~known)
        seen[active[at], cand[at, col]] = True
        new = np.full(cand.shape, -np.inf, np.float32)
        new[at, col] = np.einsum("ij,ij->i", q[active[at]], x[cand[at, col]])
        all_s, all_i = np.concatenate([sc, new], axis=1), np.concatenate([cur, cand], axis=1)
        all_d = np.concatenate([dn, np.zeros_like(known)], axis=1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        ids[active], score[active], done[active] = all_i[rows, keep], all_s[rows, keep], all_d[rows, keep]
        active = active[(~done[active] & (score[active] > -np.inf)).any(axis=1)]
    return ids, score


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, largest: float, shards: int, k: int,
           beam: int = 160, block: int = 256, group: int = 32_768) -> DataFrame:
    """(query_id, node, score): the best ``k`` nodes found for each query (id, vec) in each shard."""
    out = "query_id long, node long, score double"
    schema = arrow_schema(out)
    n_queries = queries.count()
    groups = max(1, -(-n_queries // group))
    graph = (nodes.join(edges.groupBy("shard", F.col("u").alias("node")).agg(F.collect_list("v").alias("near")), ["shard", "node"], "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    # every query against every shard, in blocks: a shard's graph and ``group`` queries at most in a task
    asked = (queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        order = np.argsort(left.column("node").to_numpy())
        node, exact = left.column("node").to_numpy()[order], _matrix(left)[order]
        x = _augmented(exact, largest)
        lists = left.column("near").to_pylist()
        size = np.array([len(lists[i] or ()) for i in order])
        u = np.repeat(np.arange(len(node)), size)
        v = np.searchsorted(node, np.concatenate([np.array(lists[i] or (), np.int64) for i in order]))
        # both directions, at most 2 x degree
        uu, vv = np.concatenate([u, v]), np.concatenate([v, u])
        pair = np.unique(uu * len(node) + vv)
        uu, vv = pair // len(node), pair % len(node)
        s = _inner(x, uu, vv)
        o = np.lexsort((-s, uu))
        uu, vv = uu[o], vv[o]
        col = np.arange(len(uu)) - np.searchsorted(uu, uu)
        width = max(1, min(2 * int(size.max(initial=1)), int(col.max(initial=0)) + 1))
        near = np.repeat(np.arange(len(node))[:, None], width, axis=1)
        ok = col < width
        near[uu[ok], col[ok]] = vv[ok]
        ids, q = right.column("id").to_numpy(), _matrix(right)
        q32 = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        best, keep = [], min(k, len(node))
        for i in range(0, len(ids), block):
            b, _ = greedy(x, near, q32[i:i + block], max(beam, keep))
            s = np.einsum("qd,qbd->qb", q[i:i + block], exact[b])
            o = np.lexsort((node[b], -s), axis=1)[:, :keep]
            best.append((np.repeat(ids[i:i + block], keep), node[np.take_along_axis(b, o, axis=1)].ravel(),
                         np.take_along_axis(s, o, axis=1).ravel()))
        return pa.table([np.concatenate(c) for c in zip(*best)], schema=schema)

    return graph.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(run, out)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = 4_096, degree: int = 20, beam: int = 160) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest found for each row whose id is divisible by ``every``."""
    rows = written(usable(vectors, id_col, vec_col), "ann-rows")
    n, largest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards = max(1, -(-n // shard_rows))
    distinct = rows.groupBy("vec").agg(F.min("id").alias("node"))
    nodes = written(distinct.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "vec"), "ann-nodes")
    edges = build_graph(nodes, largest or 0.0, degree)
    queries = rows.where(F.col("id") % every == 0)
    hits = search(nodes, edges, queries, largest or 0.0, shards, k + 1, beam)
    # a node stands for equal vectors: its k + 1 smallest ids can appear
    members = top_k_per_group(rows.join(nodes.select("vec", "node"), "vec").select("node", "id"), ["node"], [F.col("id")], k + 1)
    found = hits.join(members.select("node", "id"), "node").where(F.col("id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))

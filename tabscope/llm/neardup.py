"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds the hashes of its distinct ``shingle``-word shingles (fewer words: the whole
sequence is one).  Documents with equal sets form a class, named by its smallest id; the rest works on
classes.  A signature is ``ELEMENTS`` minima of 16 bits, split into ``CHUNKS`` chunks; two that differ in at
most ``DISTANCE`` = 2 * CHUNKS - 1 elements differ in at most one element of some chunk (pigeonhole), so every class is indexed
under each chunk with each one of its elements left out, and the join on these keys meets all pairs within that
distance.  Most pairs beyond it meet too: of pairs at similarity 0.8 one in 70,000 shares no key.

Pairs of a bucket are not listed.  A bucket's smallest class is its leader; every other member is compared with it on the full sets, and
the members of all buckets of one leader form its group, so a pair that shares a key shares a group.  A
comparison leaves the member's edits to the leader: which of its shingles are missing, and which are added.
Components of the links follow.  Members outside the leader's component are then held against the group's others in
cells of at most about ``CELL`` x ``CELL`` members, on the edits alone: |A and B| = |L| - |missing of A or B| + |added to both|, exact.  A
cell names for each member the smallest one it is joined to, so it gives a row per member at most.  A group costs one comparison per member as long
as its members are joined to the leader; members that are not cost a few machine words for each
other member, spread over the cells, without a row per pair.

Nulls and ties: a document without words has an empty set and is linked with nothing; a null id is linked with nothing, has a
null component and is kept; rows with one id are one document with all its texts, kept or not together; an empty table gives
no row.  Columns beyond id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, M1, SPACE, U64, arrow_schema, inside_rows, mix64, record, row_of, slices, windows, words, written
from .components import components

ELEMENTS, CHUNKS = 48, 9
DISTANCE = 2 * CHUNKS - 1
CELL = 2048
STRIP = 128         # rows of a cell that are compared at a time
_RNG = np.random.default_rng(20_240_601)
_XOR = _RNG.integers(0, 1 << 63, ELEMENTS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, ELEMENTS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and row offsets in them."""
    _, _, unit, rows = words(LOWER[buf], off, ~SPACE)
    n = np.diff(rows)
    start = np.flatnonzero(inside_rows(rows, size))
    row, h = [row_of(rows)[start]], [windows(unit, size)[start]]
    for few in range(1, size):
        short = np.flatnonzero(n == few)
        if len(short):
            row.append(short)
            h.append(windows(unit, few, 1000 + few)[rows[short]])
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(off)))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, ELEMENTS) 16-bit minima; rows must not be empty."""
    out = np.empty((len(at) - 1, ELEMENTS), np.uint16)
    for j in range(ELEMENTS):
        out[:, j] = mix64(np.minimum.reduceat((h ^ _XOR[j]) * _MUL[j], at[:-1])) & U64(0xFFFF)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, ELEMENTS) keys: each chunk with each one of its elements left out."""
    keys = np.empty((len(sig), ELEMENTS), np.uint64)
    wide = sig.astype(np.uint64) + U64(1)
    for c, part in enumerate(np.array_split(np.arange(ELEMENTS), CHUNKS)):
        for left_out in part:
            key = np.full(len(sig), c * 1000 + left_out + 1, np.uint64) * M1
            for j in part:
                if j != left_out:
                    key = mix64(key ^ wide[:, j] * M1) + U64(j)
            keys[:, left_out] = key
    return keys


def _sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    ddl = "id long, n_shingles long, k1 long, k2 long, sig array<short>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                h, at = shingle_sets(buf, off, size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                k = np.zeros((2, len(n)), np.uint64)
                sig = [None] * len(n)
                if len(full):
                    first = np.append(at[:-1][full], len(h))
                    k[0, full], k[1, full] = np.add.reduceat(mix64(h), first[:-1]), np.add.reduceat(mix64(h ^ M1), first[:-1])
                    for r, s in zip(full, signatures(h, first).view(np.int16)):
                        sig[r] = s
                yield record(schema, id=part.column(0), n_shingles=n, k1=k[0].view(np.int64), k2=k[1].view(np.int64), sig=sig)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, ddl)


def _index(classes: DataFrame) -> DataFrame:
    ddl = "key long, c long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.array(batch.column(1).to_pylist(), np.int16).reshape(-1, ELEMENTS).view(np.uint16)
                c = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), ELEMENTS)
                yield record(schema, key=index_keys(sig).ravel().view(np.int64), c=c)

    return classes.select("c", "sig").mapInArrow(run, ddl)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Full sets of the classes that met another one."""
    ddl = "c long, shingles array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                h, at = shingle_sets(buf, off, size)
                yield record(schema, c=part.column(0), shingles=[h[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:])])

    texts = docs.select(F.col(id_col).cast("long").alias("c"), text_col)
    # the same join at every size: a broadcast below a threshold would make the shuffle grow in a step
    return texts.join(ids.hint("merge"), "c", "left_semi").mapInArrow(run, ddl)


def _edits(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each member c compared with its leader u on the full sets: linked or not, sizes, shingles missing and added."""
    ddl = "u long, c long, linked boolean, n_u int, n_c int, missing binary, added binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            (ub, uo), (cb, co) = ((x.flatten().to_numpy().view(np.uint64), x.offsets.to_numpy()) for x in (batch.column(2), batch.column(3)))
            uo, co = uo - uo[0], co - co[0]
            out = {k: [] for k in ("linked", "n_u", "n_c", "missing", "added")}
            for r in range(batch.num_rows):
                u, c = ub[uo[r]:uo[r + 1]], cb[co[r]:co[r + 1]]
                at = np.minimum(np.searchsorted(u, c), len(u) - 1)
                both = u[at] == c
                gone = np.ones(len(u), bool)
                gone[at[both]] = False
                n = int(both.sum())
                out["linked"].append(100 * n >= percent * (len(u) + len(c) - n))
                out["n_u"].append(len(u))
                out["n_c"].append(len(c))
                out["missing"].append(np.packbits(gone).tobytes())
                out["added"].append(c[~both].tobytes())
            yield record(schema, u=batch.column(0), c=batch.column(1), **out)

    a, b = sets.select(F.col("c").alias("u"), F.col("shingles").alias("su")), sets.select("c", F.col("shingles").alias("sc"))
    return pairs.join(b, "c").join(a, "u").select("u", "c", "su", "sc").mapInArrow(run, ddl)


def strips(n: int) -> list[slice]:
    """``n`` rows of a cell, a few at a time: only the counts and the links of a cell are held for all its pairs."""
    return [slice(i, i + STRIP) for i in range(0, n, STRIP)]


def common(n_leader: int, missing: tuple[list, list], added: tuple[list, list]) -> np.ndarray:
    """Sizes of the intersections of the rows' sets with the columns' sets, from their edits to one leader."""
    width = -(-n_leader // 64) * 8
    rows, cols = (np.frombuffer(b"".join(m.ljust(width, b"\0") for m in side), np.uint64).reshape(len(side), width // 8) for side in missing)
    out = np.full((len(rows), len(cols)), n_leader, np.int32)
    for part in strips(len(rows)):
        for w in range(rows.shape[1]):
            out[part] -= np.bitwise_count(rows[part, w, None] | cols[None, :, w])
    where = []
    for side in added:
        size = [len(x) // 8 for x in side]
        value = np.frombuffer(b"".join(side), np.uint64)
        order = np.argsort(value, kind="stable")
        where.append((value[order], np.repeat(np.arange(len(side)), size)[order]))
    (va, ra), (vb, rb) = where
    shared = np.intersect1d(va, vb)
    spans = [np.searchsorted(v, shared, side) for v in (va, vb) for side in ("left", "right")]
    for i, j, k, m in zip(*(x.tolist() for x in spans)):
        out[np.ix_(ra[i:j], rb[k:m])] += 1
    return out


def joined(c: np.ndarray, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest class each one is joined to within the cell, by links (rows, columns)."""
    low, far = c.copy(), np.iinfo(np.int64).max
    while linked.any():
        before = low.copy()
        for p in strips(len(rows)):
            r, link = rows[p], linked[p]
            low[r] = np.minimum(low[r], np.where(link, low[None, cols], far).min(axis=1))
            low[cols] = np.minimum(low[cols], np.where(link, low[r, None], far).min(axis=0))
        if (low == before).all():
            break
    return low


def _cell(percent: int):
    ddl = "u long, v long"
    schema = arrow_schema(ddl)

    def run(table: pa.Table) -> pa.Table:
        t = {k: table.column(k).to_pylist() for k in ("own", "x", "y", "c", "comp", "n_u", "n_c", "missing", "added")}
        own, x, y = np.array(t["own"]), t["x"][0], t["y"][0]
        rows, cols = np.flatnonzero(own == x), np.flatnonzero(own == y)
        pick = lambda k, at: [t[k][i] for i in at]
        n, comp, c = (np.array(t[k], np.int64) for k in ("n_c", "comp", "c"))
        inter = common(t["n_u"][0], (pick("missing", rows), pick("missing", cols)), (pick("added", rows), pick("added", cols)))
        linked = np.empty(inter.shape, bool)
        for p in strips(len(rows)):
            r = rows[p]
            linked[p] = (100 * inter[p] >= percent * (n[r, None] + n[None, cols] - inter[p])) & (comp[r, None] != comp[None, cols])
        low = joined(c, rows, cols, linked)
        some = low != c
        return pa.table([c[some], low[some]], schema=schema)

    return run, ddl


def _cells(edits: DataFrame, found: DataFrame, percent: int, cell: int) -> DataFrame:
    """Joins (u, v) between members of a group that are not both in the leader's component."""
    comp = found.select(F.col("node").alias("c"), F.col("component").alias("comp"))
    top = found.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    rows = (edits.drop("linked").join(comp, "c", "left").join(top, "u", "left")
            .withColumns({"comp": F.coalesce("comp", "c"), "inside": F.coalesce("comp", "c") == F.coalesce("cu", "u")}).drop("cu"))
    rows = written(rows, "neardup-members")
    inside = F.col("inside").cast("int")
    size = rows.groupBy("u").agg(F.sum(inside).alias("n_in"), F.sum(1 - inside).alias("n_out")).where("n_out > 0 AND n_in + n_out > 1")
    blocks = size.select("u", F.ceil(F.col("n_out") / cell).cast("int").alias("n_out"), F.ceil(F.col("n_in") / cell).cast("int").alias("n_in"))
    rows = rows.join(blocks, "u")
    h = F.xxhash64("c")
    own = F.when(F.col("inside"), F.col("n_out") + F.pmod(h, F.col("n_in"))).otherwise(F.pmod(h, F.col("n_out"))).cast("int")
    # an outside block meets every block, an inside block the outside ones
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("n_out") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_out") + F.col("n_in") - 1))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "inside", "n_in", "n_out")
    run, ddl = _cell(percent)
    return rows.groupBy("u", "x", "y").applyInArrow(run, ddl)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, cell: int = CELL) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable), kept."""
    rows = written(_sketch(docs, id_col, text_col, shingle), "neardup-rows")
    classes = written(rows.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("k1", "k2", "n_shingles")
                      .agg(F.min("id").alias("c"), F.first("sig").alias("sig")), "neardup-classes")
    keys = written(_index(classes), "neardup-keys")
    lead = keys.groupBy("key").agg(F.min("c").alias("u"), F.max("c").alias("top")).where(F.col("u") < F.col("top")).drop("top")
    pairs = written(keys.join(lead, "key").where(F.col("c") != F.col("u")).select("u", "c").distinct(), "neardup-pairs")
    met = pairs.select("c").union(pairs.select("u")).distinct()
    sets = written(_sets(docs, met, id_col, text_col, shingle), "neardup-sets")
    edits = written(_edits(pairs, sets, percent), "neardup-edits")
    links = edits.where("linked").select("u", F.col("c").alias("v"))
    found = components(links)
    found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(_cells(edits, found, percent, cell)))
    named = (classes.select("k1", "k2", "n_shingles", "c").join(found, F.col("c") == F.col("node"), "left")
             .select("k1", "k2", "n_shingles", F.coalesce("component", "c").alias("comp")))
    own = rows.join(named, ["k1", "k2", "n_shingles"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("comp"))).otherwise(F.col("id"))
    return own.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))

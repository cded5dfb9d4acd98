"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of digits, letters and bytes from 0x80 up.  A benchmark window is
``length`` consecutive words of an item; an item of fewer words, but not none, is one window.
Fingerprints are hashes of ``gram`` consecutive words; of each run of ``length - gram + 1`` grams the
leftmost smallest is kept, on both sides, so any shared window has a kept fingerprint at the same place of it
(shorter windows are fingerprinted whole).  Fingerprints join training and test texts; each
meeting is extended to its whole window and compared word by word.

A benchmark of up to ``broadcast_bytes`` of text is turned into one index that every task
holds, and the documents are read once without a shuffle.  A larger benchmark is joined as a table
of fingerprints.  Both ways give the same rows.

Nulls and ties: a null or empty text has no words, is not hit and has no items; a null item id
is reported as the empty string; items with equal ids are one item; equal document rows are each reported; an
empty benchmark hits nothing.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ALNUM, LOWER, U64, arrow_schema, cover, inside_rows, leftmost_min, record, row_of, slices,
                     windows, words, written)

BROADCAST_BYTES = 32 << 20
SALT = 11


@dataclass
class Found:
    """Windows of one length: start word, window hash and kept fingerprint of each."""
    length: int
    start: np.ndarray
    place: np.ndarray
    print: np.ndarray


def kept(unit: np.ndarray, off: np.ndarray, length: int, gram: int) -> Found:
    """All windows of ``length`` words inside a row, with the place and value of their fingerprint."""
    g = min(gram, length)
    if length < gram * 3 // 2:
        g = length
    h = windows(unit, g, SALT + g)
    start = np.flatnonzero(inside_rows(off, length))
    place = start if g == length or len(start) == 0 else leftmost_min(h, length - g + 1)[start]
    return Found(length, start, place, h[place] if len(place) else np.zeros(0, np.uint64))


class Index:
    """Benchmark windows by fingerprint, for tasks to look up."""

    def __init__(self, items: list[tuple[str, str | None]], length: int, gram: int):
        texts = [(t or "").encode() for _, t in items]
        buf = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        _, _, unit, rows = words(buf, off, ALNUM)
        self.gram, self.tables, n_words = gram, [], np.diff(rows)
        for size in sorted({int(min(n, length)) for n in n_words if n}):
            whole = n_words >= length if size == length else n_words == size
            f = kept(unit, rows, size, gram)
            item = row_of(rows)[f.start]
            use = whole[item]
            start, place, key, item = f.start[use], f.place[use], f.print[use], item[use]
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(key & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((size, key[order], (place - start)[order],
                                unit[start[order, None] + np.arange(size)], item[order], seen))
        self.names = np.array([i for i, _ in items], dtype=object)

    def hits(self, unit: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end word of each hit, its row and its item."""
        out = []
        for size, key, offset, text, item, seen in self.tables:
            f = kept(unit, rows, size, self.gram)
            place, first = np.unique(f.place, return_index=True)
            key_at = f.print[first]
            near = seen[(key_at & U64((1 << 20) - 1)).astype(np.int64)]
            place, key_at = place[near], key_at[near]
            lo, hi = np.searchsorted(key, key_at, "left"), np.searchsorted(key, key_at, "right")
            count = hi - lo
            entry = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            start = np.repeat(place, count) - offset[entry]
            ok = (start >= 0) & (start + size <= len(unit))
            start, entry = start[ok], entry[ok]
            row = np.searchsorted(rows, start, side="right") - 1
            ok = start + size <= rows[row + 1] if len(start) else np.zeros(0, bool)
            start, entry, row = start[ok], entry[ok], row[ok]
            for j in range(size):
                same = unit[start + j] == text[entry, j]
                start, entry, row = start[same], entry[same], row[same]
            out.append((start, start + size, row, item[entry]))
        return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 4))


def _spans(n: int, rows: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Hit words per row and, per row, the maximal hit spans as (first word, end word) in the row."""
    mask = cover(n, start, end)
    sums = np.concatenate([[0], np.cumsum(mask)])
    edge = mask.copy()
    edge[1:] &= ~mask[:-1]
    edge[rows[:-1][np.diff(rows) > 0]] |= mask[rows[:-1][np.diff(rows) > 0]]
    first = np.flatnonzero(edge)
    stop = mask.copy()
    stop[:-1] &= ~mask[1:]
    stop[rows[1:][np.diff(rows) > 0] - 1] |= mask[rows[1:][np.diff(rows) > 0] - 1]
    last = np.flatnonzero(stop) + 1
    row = np.searchsorted(rows, first, side="right") - 1
    at = np.searchsorted(row, np.arange(len(rows)))
    pairs = [[{"first": int(a), "end": int(b)} for a, b in zip(first[i:j] - r, last[i:j] - r)]
             for i, j, r in zip(at[:-1], at[1:], rows[:-1])]
    return sums[rows[1:]] - sums[rows[:-1]], pairs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", length: int = 10, gram: int = 6,
                  broadcast_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, ``keep`` columns, n_words, n_hit, spans (hit words, maximal), items (sorted ids as strings)."""
    cols = [id_col, *keep]
    held = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(cols)])
    out = _contamination(held, benchmark, [docs.schema[c].dataType.simpleString() for c in cols], item_col, item_text,
                         length, gram, broadcast_bytes)
    return out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(cols)], "n_words", "n_hit", "spans", "items")


def _contamination(docs: DataFrame, benchmark: DataFrame, kinds: list[str], item_col: str, item_text: str, length: int, gram: int,
                   broadcast_bytes: int) -> DataFrame:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text).alias("item_text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + F.octet_length("item") + 16), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _joined(docs, items, kinds, length, gram)
    index = Index([(r.item, r.item_text) for r in items.collect()], length, gram)
    held = docs.sparkSession.sparkContext.broadcast(index)
    names = [f"keep_{i}" for i in range(len(kinds))]
    ddl = ", ".join([*map(" ".join, zip(names, kinds)), "n_words long, n_hit long, spans array<struct<first:long,end:long>>, items array<string>"])
    schema = arrow_schema(ddl)

    def run(batches):
        index = held.value
        for batch in batches:
            for part, buf, off in slices(batch):
                _, _, unit, rows = words(LOWER[buf], off, ALNUM)
                start, end, row, item = index.hits(unit, rows)
                n_hit, spans = _spans(len(unit), rows, start, end)
                got: list[set] = [set() for _ in range(part.num_rows)]
                for r, i in zip(row.tolist(), item.tolist()):
                    got[r].add(index.names[i])
                yield record(schema, **{c: part.column(part.schema.get_field_index(c)) for c in names}, n_words=np.diff(rows),
                             n_hit=n_hit, spans=spans, items=[sorted(g) for g in got])

    return docs.mapInArrow(run, ddl)


def _joined(docs: DataFrame, items: DataFrame, kinds: list[str], length: int, gram: int) -> DataFrame:
    """The same by a join of fingerprint tables, for a benchmark of any size.

    Texts are keyed by their hash, so equal documents are fingerprinted once.
    """
    from pyspark.sql import types as T
    test_ddl = "print long, size int, offset int, text_hash array<long>, item string"

    def item_rows(batches):
        schema = arrow_test
        for batch in batches:
            for part, buf, off in slices(batch, "item_text"):
                _, _, unit, rows = words(LOWER[buf], off, ALNUM)
                n = np.diff(rows)
                names = np.array(part.column(part.schema.get_field_index("item")).to_pylist(), dtype=object)
                for size in sorted({int(min(x, length)) for x in n if x}):
                    f = kept(unit, rows, size, gram)
                    row = row_of(rows)[f.start]
                    use = (n >= length if size == length else n == size)[row]
                    start = f.start[use]
                    text = list(unit.view(np.int64)[start[:, None] + np.arange(size)])
                    yield record(schema, print=f.print[use].view(np.int64), size=np.full(len(start), size),
                                 offset=(f.place[use] - start), text_hash=text, item=names[row[use]].tolist())

    arrow_test = arrow_schema(test_ddl)
    test = written(items.mapInArrow(item_rows, test_ddl), "benchmark-prints")
    sizes = [r[0] for r in test.select("size").distinct().collect()]       # at most ``length`` values
    texts = docs.select(F.md5("text").alias("key"), "text").where(F.col("text").isNotNull())
    doc_ddl = "print long, size int, key string, place int"
    arrow_doc = arrow_schema(doc_ddl)

    def doc_rows(batches):
        for batch in batches:
            for part, buf, off in slices(batch):
                _, _, unit, rows = words(LOWER[buf], off, ALNUM)
                keys = np.array(part.column(0).to_pylist(), dtype=object)
                for size in sizes:
                    f = kept(unit, rows, size, gram)
                    place, first = np.unique(f.place, return_index=True)
                    row = np.searchsorted(rows, place, side="right") - 1
                    yield record(arrow_doc, print=f.print[first].view(np.int64), size=np.full(len(place), size),
                                 key=keys[row].tolist(), place=place - rows[row])

    prints = texts.dropDuplicates(["key"]).mapInArrow(doc_rows, doc_ddl)
    # candidate windows of a text; the distinct window texts of a fingerprint, not its items
    window = test.select("print", "size", "offset", "text_hash").distinct()
    near = (prints.join(window, ["print", "size"])
            .select("key", (F.col("place") - F.col("offset")).alias("start"), "size", "text_hash")
            .groupBy("key").agg(F.collect_set(F.struct("start", "size", "text_hash")).alias("near")))
    names = [f"keep_{i}" for i in range(len(kinds))]
    ddl = ", ".join([*map(" ".join, zip(names, kinds)), "n_words long, n_hit long, spans array<struct<first:long,end:long>>, "
                     "found array<array<long>>, row_key string"])
    arrow_out = arrow_schema(ddl)

    def extend(batches):
        for batch in batches:
            for part, buf, off in slices(batch):
                _, _, unit, rows = words(LOWER[buf], off, ALNUM)
                whole, start, end, found = unit.view(np.int64), [], [], []
                for r, cand in enumerate(part.column(part.schema.get_field_index("near")).to_pylist()):
                    own = set()
                    for c in cand or []:
                        a = rows[r] + c["start"]
                        if c["start"] >= 0 and a + c["size"] <= rows[r + 1] and (whole[a:a + c["size"]] == c["text_hash"]).all():
                            start.append(a)
                            end.append(a + c["size"])
                            own.add(tuple(c["text_hash"]))
                    found.append([list(x) for x in sorted(own)])
                n_hit, spans = _spans(len(unit), rows, np.array(start, np.int64), np.array(end, np.int64))
                yield record(arrow_out, **{c: part.column(part.schema.get_field_index(c)) for c in [*names, "row_key"]},
                             n_words=np.diff(rows), n_hit=n_hit, spans=spans, found=found)

    # a row key, since equal rows are each reported
    base = written(docs.withColumns({"key": F.md5("text"), "row_key": F.uuid()}), "decontaminate-rows")
    out = written(base.join(near, "key", "left").select(*names, "text", "near", "row_key").mapInArrow(extend, ddl), "decontaminate-hits")
    named = (out.select("row_key", F.explode("found").alias("text_hash"))
             .join(test.select("text_hash", "item").distinct(), "text_hash")
             .groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    none = F.array().cast(T.ArrayType(T.StringType()))
    return (out.drop("found").join(named, "row_key", "left")
            .select(*names, "n_words", "n_hit", "spans", F.coalesce("items", none).alias("items")))

"""Token ids of a corpus as wavelet matrices, one compressed file row per shard.

File format (little endian).  A shard is one binary value::

    "WVM1", n (u64), documents (u32), planes (u32), block bits (u32)
    document lengths (u32 each)
    per plane: zeros (u64), ranks before each block (u64 each), block ends (u64 each), blocks (zstandard)

Plane 0 holds the highest bit of every id in order; the ids are then parted stably into zeros and ones
and the next plane holds their next bit (a wavelet matrix).  A block is ``BLOCK`` bits, compressed on its
own, so ``access``, ``rank`` (counting) and ``select`` (occurrence lookup) read one or two blocks per plane.
Shards are the rows of Parquet files, ordered by their first document, so every store that Spark writes can hold them.

Documents are put in id order by a range partition (nulls first, equal ids by text) and cut into shards of
about ``shard_tokens`` ids; one document is never cut, so a task needs memory for its longest text.  An empty
table gives no shard; null texts are empty; only the id and the text are read.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WIDE_SLICE, arrow_schema, record, shared_path, slices
from .encode import encoder, with_end

SHARD_TOKENS = 1 << 21
BLOCK = 1 << 17
HEAD = "<4sQIII"


def build(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file row of one shard."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    out = [struct.pack(HEAD, b"WVM1", len(ids), len(lengths), planes, BLOCK), lengths.astype("<u4").tobytes()]
    pack = zstandard.ZstdCompressor(level=1)
    cur = ids.astype(_narrow(planes))
    for level in range(planes - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << level)) != 0
        packed = np.packbits(bit, bitorder="little")
        blocks = [pack.compress(packed[i:i + BLOCK // 8].tobytes()) for i in range(0, len(packed), BLOCK // 8)]
        ones = np.bitwise_count(packed)
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8), dtype=np.uint64))]) \
            if len(bit) else np.zeros(1)
        out.append(struct.pack("<Q", len(bit) - int(before[-1])))
        out.append(before[:-1].astype("<u8").tobytes() if len(blocks) else b"")
        out.append(np.cumsum([len(b) for b in blocks]).astype("<u8").tobytes() if blocks else b"")
        out += blocks
        cur = np.concatenate([cur.take(np.flatnonzero(~bit)), cur.take(np.flatnonzero(bit))])
    return b"".join(out)


def _narrow(planes: int):
    """The least type that holds ids of so many bits."""
    return np.uint16 if planes <= 16 else np.uint32


class WaveletMatrix:
    """Reads one shard; blocks are decompressed as they are asked for."""

    def __init__(self, data: bytes):
        magic, self.n, docs, planes, self.block = struct.unpack_from(HEAD, data)
        if magic != b"WVM1":
            raise ValueError("not a wavelet matrix shard")
        at = struct.calcsize(HEAD)
        self.lengths = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.data, self.planes, self._cache = data, [], {}
        blocks = -(-self.n // self.block)
        for level in range(planes - 1, -1, -1):
            zeros, = struct.unpack_from("<Q", data, at)
            before = np.frombuffer(data, "<u8", blocks, at + 8).astype(np.int64)
            ends = np.frombuffer(data, "<u8", blocks, at + 8 + 8 * blocks).astype(np.int64)
            at += 8 + 16 * blocks
            self.planes.append((level, zeros, before, ends, at))
            at += int(ends[-1]) if blocks else 0

    def bits(self, p: int, block: int) -> np.ndarray:
        if (p, block) not in self._cache:
            _, _, _, ends, at = self.planes[p]
            raw = self.data[at + (int(ends[block - 1]) if block else 0):at + int(ends[block])]
            bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, self.block // 8), np.uint8),
                                 bitorder="little")
            self._cache[p, block] = bits[:min(self.block, self.n - block * self.block)].astype(bool)
        return self._cache[p, block]

    def ones(self, p: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``p``."""
        if i >= self.n:
            return self.n - self.planes[p][1]
        b, r = divmod(i, self.block)
        return int(self.planes[p][2][b]) + int(np.count_nonzero(self.bits(p, b)[:r]))

    def access(self, i: int) -> int:
        value = 0
        for p, (level, zeros, *_rest) in enumerate(self.planes):
            b, r = divmod(i, self.block)
            if self.bits(p, b)[r]:
                value |= 1 << level
                i = zeros + self.ones(p, i)
            else:
                i -= self.ones(p, i)
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        if token < 0 or token >> len(self.planes):
            return 0
        lo, hi = 0, min(i, self.n)
        for p, (level, zeros, *_rest) in enumerate(self.planes):
            if token >> level & 1:
                lo, hi = zeros + self.ones(p, lo), zeros + self.ones(p, hi)
            else:
                lo, hi = lo - self.ones(p, lo), hi - self.ones(p, hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0) of ``token``; -1 if there are fewer."""
        if self.rank(token, self.n) <= k:
            return -1
        lo, hi = k, self.n - 1          # smallest i with rank(i + 1) = k + 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rank(token, mid + 1) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def decode(self) -> np.ndarray:
        """All ids in order: planes undone from the lowest."""
        blocks = range(-(-self.n // self.block))
        cur = np.zeros(self.n, _narrow(len(self.planes)))
        for p in range(len(self.planes) - 1, -1, -1):
            level, zeros, *_rest = self.planes[p]
            bit = np.concatenate([self.bits(p, b) for b in blocks]) if self.n else np.zeros(0, bool)
            out = np.empty_like(cur)
            out[np.flatnonzero(~bit)] = cur[:zeros]
            out[np.flatnonzero(bit)] = cur[zeros:] | cur.dtype.type(1 << level)
            cur = out
            for b in blocks:
                self._cache.pop((p, b), None)
        return cur.astype(np.uint32)


def write_shards(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write shard rows: part, shard, n_documents, n_tokens, doc_ids, data."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"part int, shard int, n_documents long, n_tokens long, doc_ids array<{kind}>, data binary"

    schema = arrow_schema(ddl)

    def run(batches):
        from pyspark import TaskContext
        encode = encoder(vocabulary)
        part, shard = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal keys, held, lengths, size, shard
            ids = np.concatenate(held)
            row = record(schema, part=[part], shard=[shard], n_documents=[len(keys)], n_tokens=[len(ids)],
                         doc_ids=[keys], data=[build(ids, np.concatenate(lengths))])
            keys, held, lengths, size, shard = [], [], [], 0, shard + 1
            return row
        for batch in batches:
            for rows, buf, off in slices(batch, text_col, WIDE_SLICE):
                ids, at = with_end(*encode(buf, off), end_id)
                keys += rows.column(rows.schema.get_field_index(id_col)).to_pylist()
                held.append(ids)
                lengths.append(np.diff(at))
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
        if keys:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(id_col, text_col).repartitionByRange(n, F.col(id_col).asc_nulls_first())
               .sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()))
    ordered.mapInArrow(run, ddl).write.option("compression", "uncompressed").parquet(path)


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, decoded from the shards: id, start (ids of all documents before), n_tokens, ids (little-endian uint32)."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    ddl = f"`{id_col}` {kind}, start long, n_tokens long, ids binary"
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # one small row per shard: the only data that is put in one order
    before = shards.select("part", "shard", "n_tokens").withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix(row["data"])
                ids, length = m.decode().astype("<u4"), m.lengths
                stop = np.cumsum(length)
                for i in range(0, len(length), 4096):
                    j = min(len(length), i + 4096)
                    yield record(schema, **{id_col: row["doc_ids"][i:j], "start": row["base"] + stop[i:j] - length[i:j],
                                            "n_tokens": length[i:j],
                                            "ids": [ids[b - k:b].tobytes() for b, k in zip(stop[i:j], length[i:j])]})

    return (shards.select("part", "shard", "doc_ids", "data").join(before.select("part", "shard", "base"), ["part", "shard"])
            .select("base", "doc_ids", "data").mapInArrow(run, ddl))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
               end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """Write the shards (to a new shared folder unless ``path`` is given) and read every document back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "wavelet")
    write_shards(docs, path, vocabulary, id_col, text_col, end_id)
    return read_documents(spark.read.parquet(path), id_col)

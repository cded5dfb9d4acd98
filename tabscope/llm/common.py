"""Helpers shared by the text operators: lineage, Arrow batches as byte arrays, words as hashes.

The text operators read Arrow batches as one byte buffer with row offsets and work on
whole buffers with numpy; a slice of rows holds about ``SLICE_BYTES`` of text, so memory does
not follow the batch size.  One text is never cut: a task needs memory for the
longest single text (about 60 bytes for each of its bytes at the peak).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir  # noqa: F401

SLICE_BYTES = 1 << 20       # of operators that hold about 60 bytes for each byte of a slice
WIDE_SLICE = 1 << 22        # of those that hold little beside the text, and gain from more of it
U64 = np.uint64
# odd 64-bit multipliers of the mixing steps
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (all bits depend on all bits)."""
    x = (x ^ (x >> U64(30))) * M2
    x = (x ^ (x >> U64(27))) * M3
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if "binary" in str(column.type) else "", column.type))
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], (off - off[0]).astype(np.int64)


def slices(batch: pa.RecordBatch, text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch with at most ``limit`` text bytes (one row at least)."""
    buf, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i), buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def row_of(off: np.ndarray) -> np.ndarray:
    """Row number of each unit, from row offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """One Arrow batch; numpy arrays and Arrow arrays alike."""
    arrays = []
    for f in schema:
        c = columns[f.name]
        arrays.append(c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type))
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays],
                                      schema=schema)


# byte classes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * M1)
LETTER = np.zeros(256, bool)        # ASCII letters
LETTER[65:91] = LETTER[97:123] = True
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:256] = True


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each run of true bytes; a run ends at its row's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off[off <= n]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(buf: np.ndarray, off: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: start byte, end byte, 64-bit hash, and word offsets of the rows."""
    inside = word_bytes[buf]
    start, end = runs(inside, off)
    if len(start) == 0:
        return start, end, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return start, end, span_hash(buf, start, end), np.searchsorted(start, off)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of disjoint ascending byte spans: sum of byte hash x power of the place, finalised."""
    length = end - start
    longest = int(length.max())
    power = np.empty(longest, np.uint64)
    power[0] = 1
    if longest > 1:
        np.multiply.accumulate(np.full(longest - 1, M1, np.uint64), out=power[1:])
    total = int(length.sum())
    first = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(first, length)
    value = _BYTE_HASH[buf[place + np.repeat(start, length)]] * power[place]
    return mix64(np.add.reduceat(value, first) ^ (length.astype(np.uint64) * M3))


def windows(unit: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of each ``size`` consecutive units (by doubling); len(unit) - size + 1 values."""
    if len(unit) < size:
        return np.zeros(0, np.uint64)
    have, h = 1, (unit + U64(salt)) * M1
    while have < size:
        step = min(have, size - have)
        n = len(h) - step
        h = mix64(h[:n] * M3 + (h[step:] ^ (h[step:] >> U64(29))) + U64(salt + have))
        have += step
    return h


def inside_rows(off: np.ndarray, size: int) -> np.ndarray:
    """True for each start of ``size`` units that lies in one row; as long as ``windows``' result."""
    n = int(off[-1])
    if n < size:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for back in range(1, size):
        at = off[1:] - back
        ok[at[(at >= off[:-1])]] = False
    return ok[:n - size + 1]


def leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each ``width`` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the upper 32 bits rank, the lower 32 hold the place: equal ranks go to the leftmost
    have, low = 1, (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    return (low & U64(0xFFFFFFFF)).astype(np.int64)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the ``n`` places that lie in any [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:n]) > 0


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n (the fold of a labelled row); a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n

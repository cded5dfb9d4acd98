"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``length`` bytes only.  The first digit is a ``gram``-byte string, taken at
the anchors of ``repeats`` (one suffix in about 16; every ``length``-byte string holds one); buckets that one document alone
fills are done after that pass, and so are the buckets whose whole context repeats.  What is left is sorted by further
most-significant-digit passes of 8 bytes each, and a group leaves as soon as it holds one document.  Suffixes that
are still together after ``length`` bytes are exactly the repeated strings; those of a larger id
than the smallest of their group are removed, each with all the bytes it covers.

Nulls and ties: a null text is empty; a text of fewer bytes than ``length`` keeps all; a row with a null id is kept whole and is
nobody's earlier copy; rows with one id are one document (none removes from another); an empty table gives no row.  Only the id, the text and
the columns in ``keep`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, mix64
from .repeats import Task, mark, row_sums, span_counts

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))


def byte_units(buf: np.ndarray, off: np.ndarray):
    return _BYTE[buf], off, buf


def pack_bytes(length: int):
    def pack(buf, a, chosen):
        data = memoryview(np.ascontiguousarray(buf))
        return [bytes(data[s:e]) for s, e in zip(a.low[chosen].tolist(), (a.high[chosen] + length).tolist())]
    return pack


def radix_groups(data: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the suffixes at ``start``.

    Returns (suffixes, smallest document of their group) for the groups of more than one document
    whose first ``length`` bytes are equal.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    left, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in range(0, length, 8):
        if len(left) == 0:
            return left, left
        digit = np.zeros(len(left), np.uint64)
        for j in range(min(8, length - depth)):
            digit = digit << U64(8) | padded[start[left] + depth + j]
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        d = doc[left]
        low = np.minimum.reduceat(d, at)
        stay = (low < np.maximum.reduceat(d, at))[group]
        left, group, low = left[stay], group[stay], low[group[stay]]
    return left, low


def settle_bytes(length: int):
    def settle(table: pa.Table):
        ids, key, n = (table.column(c).to_numpy() for c in ("id", "key", "n"))
        data = [x for x in table.column("data").to_pylist()]
        first = np.cumsum([0, *map(len, data)])[:-1]
        owner = np.repeat(np.arange(len(ids)), n)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        left, low = radix_groups(np.frombuffer(b"".join(data), np.uint8), first[owner] + j, ids[owner], length)
        mask = np.zeros(len(ids), np.int64)
        later = left[ids[owner[left]] > low]
        np.bitwise_or.at(mask, owner[later], np.int64(1) << j[later])
        return ids, key, mask
    return settle


def _finish(buf, off, source, rows, mask):
    kept = buf[~mask]
    gone = row_sums(mask, rows)
    at = np.concatenate([[0], np.cumsum(np.diff(off) - gone)])
    data = memoryview(np.ascontiguousarray(kept))
    return {"n_bytes": np.diff(off), "n_removed": gone, "n_spans": span_counts(mask, rows),
            "kept": [bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]}


def _finish_text(buf, off, source, rows, mask):
    """As text: a character goes only if all its bytes do, so what is kept is valid."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(lead):
        whole = np.logical_and.reduceat(mask, lead)
        mask = np.repeat(whole, np.diff(np.append(lead, len(buf))))
    out = _finish(buf, off, source, rows, mask)
    out["kept"] = [k.decode() for k in out["kept"]]
    return out


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = (), as_text: bool = False, hot: int | None = None) -> DataFrame:
    """Per row: id, ``keep`` columns, n_bytes, n_removed, n_spans and the kept bytes (or whole characters, ``as_text``)."""
    task = Task(units=byte_units, length=length, gram=gram, elsewhere=False, pack=pack_bytes(length), settle=settle_bytes(length),
                finish=_finish_text if as_text else _finish,
                finish_ddl=f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return mark(docs, task, id_col, text_col, keep, hot)

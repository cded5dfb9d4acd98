"""Removal of repeated word runs by anchor-context hashing.

No Lempel-Ziv parse is made: which windows come up again is decided by ``repeats``.  The context of every anchor (the words of
the windows it serves) is indexed by the anchor's gram, and a context that comes up elsewhere covers all its windows.
Where a gram has different contexts, single windows may still match: ``Task.settle`` compares each window of such a context with
those of every other under the same gram, by 128-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A window that starts anywhere else, in the same document too, is repeated,
and all its starts go.

Nulls and ties: a null text has no words; fewer than ``length`` words keep all; equal texts of ``length`` words or more lose all; a
row with a null id is kept whole and counts for nobody; rows with one id and equal texts count as one; an
empty table gives no row.  Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, words
from .repeats import Task, mark, row_sums, span_counts, window_hashes


def word_units(buf: np.ndarray, off: np.ndarray):
    start, end, unit, rows = words(buf, off, ~SPACE)
    return unit, rows, (start, end, unit)


def pack_windows(length: int):
    def pack(source, a, chosen):
        low, n = a.low[chosen], a.high[chosen] - a.low[chosen] + 1
        last = np.cumsum(n)
        h = window_hashes(source[2], np.repeat(low - last + n, n) + np.arange(int(n.sum())), length)
        data = memoryview(np.stack(h, axis=1).astype("<u8").tobytes())
        return [bytes(data[16 * (e - k):16 * e]) for e, k in zip(last.tolist(), n.tolist())]
    return pack


def settle_windows(table: pa.Table):
    ids, key, n, weight = (table.column(c).to_numpy() for c in ("id", "key", "n", "weight"))
    h = np.frombuffer(b"".join(table.column("data").to_pylist()), "<u8").reshape(-1, 2)
    owner = np.repeat(np.arange(len(ids)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((h[:, 1], h[:, 0]))
    hs = h[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]).any(axis=1)])
    group = np.cumsum(new) - 1
    again = (np.add.reduceat(weight[owner[order]], np.flatnonzero(new)) > 1)[group]
    hit = order[again]
    mask = np.zeros(len(ids), np.int64)
    np.bitwise_or.at(mask, owner[hit], np.int64(1) << j[hit])
    return ids, key, mask


def _finish(buf, off, source, rows, mask):
    start, end, _ = source
    data = memoryview(np.ascontiguousarray(buf))
    left = np.flatnonzero(~mask)
    at = np.searchsorted(left, rows)
    s, e = start[left].tolist(), end[left].tolist()
    kept = [b" ".join([bytes(data[s[i]:e[i]]) for i in range(a, b)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return {"n_words": np.diff(rows), "n_removed": row_sums(mask, rows), "n_spans": span_counts(mask, rows),
            "kept": [k.decode() for k in kept]}


def remove_repeated_words(docs: DataFrame, length: int = 35, gram: int = 15, id_col: str = "doc_id", text_col: str = "text",
                          keep: tuple[str, ...] = (), hot: int | None = None) -> DataFrame:
    """Per row: id, ``keep`` columns, n_words, n_removed, n_spans and kept words joined by one space."""
    task = Task(units=word_units, length=length, gram=gram, elsewhere=True, pack=pack_windows(length), settle=settle_windows,
                finish=_finish, finish_ddl="n_words long, n_removed long, n_spans long, kept string")
    return mark(docs, task, id_col, text_col, keep, hot)

"""Sum-of-squares online packing of token sequences into fixed windows.

Every task packs the rows of its own scan partition as they come, so nothing is shuffled.
A document fills whole windows first; its rest goes to the fill level h for which the sum
of N(h)^2 over partly filled windows (N: windows at fill h) grows least, with ties to the
fullest window.  N is an array of ``window`` levels.  When the partition ends, or
``open_limit`` windows stand open, the open windows are closed: their pieces are laid end to
end and cut into full windows, and what is left over is cut into sequences whose lengths are
powers of two, which take no padding.  So a task holds ``open_limit`` windows of ids at most.

Nulls and ties: a null text is empty (its end token is packed); a null id stays null; equal
rows are packed each; an empty table gives no piece.  Columns beyond the id and the text are
not read.  Sequence ids hold the partition number above 33 bits, so a task that runs again
gives the same ids.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WIDE_SLICE, arrow_schema, record, slices
from .encode import encoder, with_end

PACKED_PIECES = 500_000     # remembered pieces of a packing worker; the last stage of a pipeline has little memory left
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Level array and open windows of one task; ``out`` collects finished pieces."""

    def __init__(self, window: int, first_id: int = 0, open_limit: int = 1024):
        self.window, self.open_limit, self.next_id = window, open_limit, first_id
        self.count = np.zeros(window + 1)
        self.count[window] = -0.5          # a full window counts nothing in the sum of squares
        self.open: list[list[list]] = [[] for _ in range(window)]   # by fill: windows, each a list of pieces
        self.n_open = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, len(ids), ids, total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, key, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        full = total - total % w
        for s in range(0, full, w):
            self._emit([(key, s, ids[s:s + w], total)])
        rest = total - full
        if rest:
            self._place((key, full, ids[full:].copy(), total), rest)    # a view would keep the ids of its whole slice

    def _place(self, piece: tuple, size: int) -> None:
        n, w = self.count, self.window
        level, cost = 0, 2 * n[size] + 1
        if self.n_open and size < w:
            there = np.flatnonzero(n[1:w - size + 1] > 0) + 1
            if len(there):
                change = 2 - 2 * n[there] + 2 * n[there + size]
                best = float(change.min())
                if best <= cost:
                    level = int(there[np.flatnonzero(change == best)[-1]])
        held = self.open[level].pop() if level else []
        if level:
            n[level] -= 1
            self.n_open -= 1
        held.append(piece)
        if level + size == w:
            self._emit(held)
            return
        self.open[level + size].append(held)
        n[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.open_limit:
            self.close()

    def close(self) -> None:
        """Lay the pieces of the open windows end to end; cut full windows, then powers of two."""
        pieces = [p for fill in self.open for held in fill for p in held]
        left = sum(len(p[2]) for p in pieces)
        sizes = [self.window] * (left // self.window)
        sizes += [1 << b for b in range(self.window.bit_length(), -1, -1) if (left % self.window) >> b & 1]
        i = at = 0
        for size in sizes:
            part: list[tuple] = []
            while size:
                key, start, ids, total = pieces[i]
                take = min(size, len(ids) - at)
                part.append((key, start + at, ids[at:at + take], total))
                size, at = size - take, at + take
                if at == len(ids):
                    i, at = i + 1, 0
            self._emit(part)
        self.open = [[] for _ in range(self.window)]
        self.count[:self.window] = 0
        self.n_open = 0


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = 2048, end_id: int | None = 1, open_limit: int = 1024) -> DataFrame:
    """Pieces of every document: id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, {PIECES}"

    schema = arrow_schema(ddl)

    def run(batches):
        encode = encoder(vocabulary, PACKED_PIECES)
        packer = Packer(window, TaskContext.get().partitionId() << 33, open_limit)

        def flush():
            rows, packer.out = packer.out, []
            cols = list(zip(*rows)) if rows else [[]] * 7
            return record(schema, **{id_col: list(cols[0]), "start": list(cols[1]), "length": list(cols[2]),
                                     "ids": [x.tobytes() for x in cols[3]], "doc_tokens": list(cols[4]),
                                     "sequence_id": list(cols[5]), "offset": list(cols[6])})
        for batch in batches:
            for part, buf, off in slices(batch, text_col, WIDE_SLICE):
                ids, at = with_end(*encode(buf, off), end_id)
                keys = part.column(part.schema.get_field_index(id_col)).to_pylist()
                for k, a, b in zip(keys, at[:-1], at[1:]):
                    packer.add(k, ids[a:b])
                yield flush()
        packer.close()
        yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, ddl)

"""Where windows of consecutive units (bytes or words) come up again, without a row per window.

Of the grams (``gram`` consecutive units) of a window the leftmost smallest is its anchor, so equal windows have equal anchors
at the same place, and an anchor serves a run of windows.  The units of that run are the anchor's context.

1. ``index``: every anchor's (gram, context) hash goes to a bucket of the gram; records are packed, one row per bucket and slice
   of text, sorted and with copies inside a document merged.
2. ``resolve``: in a bucket, a gram that one document alone holds is done.  Where a whole context comes up again, all its windows do.
   Grams with several contexts stay open.  Both facts go back to the documents as (id, context, flag).
3. The open contexts alone are sent once more, and ``settle`` (given by the operator) compares their windows exactly.
   A gram with more than ``HOT`` open contexts is not settled in one group: its windows go one by one through a Spark
   aggregate on their 128-bit hashes (copies combine before the shuffle) and a join back.
4. Each document puts the answers on its own anchors and marks the covered units.

The texts are shuffled once (steps 3 and 4 read the same exchange); nothing is broadcast or collected.  Records of one gram meet in one bucket, as
14 bytes per document that holds it: a gram in every document costs less than one row per document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, M3, U64, arrow_schema, cover, inside_rows, leftmost_min, mix64, record, row_of, slices, written

COVERED, OPEN, COVERED_OPEN = 0, 1, 2
IS_HOT = 4              # added to the flag
HOT = 50_000            # open contexts of a gram that one group settles; about 100 MB at 31 windows each
_INVERSE = U64(pow(int(M1), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M1^0.. and its inverse powers, n + 1 of each at least (kept by the worker)."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((M1, _INVERSE)):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def window_hashes(unit: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Two 64-bit hashes of the ``length`` units from each start."""
    n = len(unit)
    power, inverse = powers(n)
    out = []
    for salt in (M2, M3):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(unit ^ salt) * power[:n], out=total[1:])
        out.append(mix64((total[start + length] - total[start]) * inverse[start]))
    return out


@dataclass
class Anchors:
    place: np.ndarray      # unit of the anchor
    low: np.ndarray        # first window it serves
    high: np.ndarray       # last window it serves
    row: np.ndarray
    gram: np.ndarray
    context: np.ndarray    # 55-bit hash of the units [low, high + length)


def anchors(unit: np.ndarray, rows: np.ndarray, length: int, gram: int) -> Anchors:
    """Anchors of all windows of ``length`` units that lie in one row; ``unit`` holds 64-bit unit hashes."""
    start = np.flatnonzero(inside_rows(rows, length))
    if len(start) == 0:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.view(np.uint64), none)
    n = len(unit)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(unit * power[:n], out=total[1:])
    h = mix64((total[gram:] - total[:n - gram + 1]) * inverse[:n - gram + 1])
    place = leftmost_min(h, length - gram + 1)[start]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place, low, high = place[first], start[first], start[np.append(first[1:], len(start)) - 1]
    whole = mix64((total[high + length] - total[low]) * inverse[low])
    shape = ((place - low) * 4096 + (high - low)).astype(np.uint64)
    context = (mix64(whole ^ mix64(shape * M2 + M1)) >> U64(9)).astype(np.int64)
    return Anchors(place, low, high, np.searchsorted(rows, low, side="right") - 1, h[place], context)


Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, object]]
"""(buf, off) -> unit hashes, row offsets in units, whatever ``finish`` needs to cut the text."""


@dataclass
class Task:
    """What an operator asks: unit kind, window, rule and its own exact step."""
    units: Units
    length: int
    gram: int
    elsewhere: bool        # True: any other start counts, same document too; False: a start in a smaller id
    pack: Callable         # (unit source, Anchors, chosen) -> list of bytes per chosen anchor: its windows, for settle
    settle: Callable       # (table with id, key, weight, n, data) -> (id, key, mask) arrays of covered windows
    finish: Callable       # (buf, off, unit source, rows, unit mask) -> dict of output columns
    finish_ddl: str


INDEX_DDL = "bucket int, docs binary, gram binary, context binary, doc binary"
REPLY_DDL = "id long, reply long"
OPEN_DDL = "bucket int, id long, key long, weight int, n int, data binary"
MASK_DDL = "id long, key long, mask long"
WINDOW_DDL = "h1 long, h2 long, id long, key long, j int, weight int"


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.reshape(-1).view("<u8").astype(np.int64)


def index(docs: DataFrame, task: Task, buckets: int) -> DataFrame:
    schema = arrow_schema(INDEX_DDL)

    def run(batches):
        for batch in batches:
            for part, buf, off in slices(batch):
                unit, rows, _ = task.units(buf, off)
                a = anchors(unit, rows, task.length, task.gram)
                ids = np.array(part.column(0).to_pylist(), np.int64)
                which = (a.gram >> U64(40)) % U64(buckets)
                gram = (a.gram & U64((1 << 40) - 1)).astype(np.int64)
                order = np.lexsort((a.row, a.context, gram, which))
                which, gram, context, row = which[order].astype(np.int64), gram[order], a.context[order], a.row[order]
                same = np.zeros(len(order), bool)
                same[1:] = (which[1:] == which[:-1]) & (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (row[1:] == row[:-1])
                many = np.append(same[1:], False)[~same]
                which, gram, context, row = which[~same], gram[~same], context[~same] * 2 + many, row[~same]
                edge = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else which
                out = {k: [] for k in ("bucket", "docs", "gram", "context", "doc")}
                for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(which)]):
                    used, doc = np.unique(row[s:e], return_inverse=True)
                    out["bucket"].append(int(which[s]))
                    out["docs"].append(np.diff(ids[used], prepend=0).astype("<i8").tobytes())
                    out["gram"].append(_low_bytes(gram[s:e], 5))
                    out["context"].append(_low_bytes(context[s:e], 7))
                    out["doc"].append(doc.astype("<u2").tobytes())
                yield record(schema, **out)

    return docs.mapInArrow(run, INDEX_DDL)


def _resolver(task: Task, hot: int):
    schema = arrow_schema(REPLY_DDL)

    def run(table: pa.Table) -> pa.Table:
        part = [table.column(c).to_pylist() for c in ("docs", "gram", "context", "doc")]
        gram = np.concatenate([_from_low_bytes(x, 5) for x in part[1]])
        context = np.concatenate([_from_low_bytes(x, 7) for x in part[2]])
        doc = np.concatenate([np.cumsum(np.frombuffer(d, "<i8"))[np.frombuffer(i, "<u2")] for d, i in zip(part[0], part[3])])
        weight, context = (context & 1) + 1, context >> 1
        order = np.lexsort((doc, context, gram))
        gram, context, doc, weight = gram[order], context[order], doc[order], weight[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_ctx = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
        g, c = np.cumsum(new_gram) - 1, np.cumsum(new_ctx) - 1
        at_g, at_c = np.flatnonzero(new_gram), np.flatnonzero(new_ctx)
        several = (np.add.reduceat(new_ctx.astype(np.int64), at_g) > 1)[g]
        if task.elsewhere:
            covered = (np.add.reduceat(weight, at_c) > 1)[c]
            is_open = several & (new_ctx | ~covered)
        else:
            shared = (np.minimum.reduceat(doc, at_g) < np.maximum.reduceat(doc, at_g))[g]
            covered = doc > doc[at_c][c]
            is_open = several & shared & ~covered
        flag = np.where(covered, np.where(is_open, COVERED_OPEN, COVERED), OPEN)
        flag += IS_HOT * (is_open & (np.add.reduceat(is_open.astype(np.int64), at_g) > hot)[g])
        told = covered | is_open
        return pa.table({"id": doc[told], "reply": context[told] * 8 + flag[told]}, schema=schema)

    return run


def _flags(a: Anchors, row: np.ndarray, key: np.ndarray, value: np.ndarray, missing: int) -> np.ndarray:
    """The value that its document's reply holds for each anchor's context."""
    mine, told = mix64(a.context.view(np.uint64) * M2 + a.row.astype(np.uint64)), mix64(key.view(np.uint64) * M2 + row.astype(np.uint64))
    order = np.argsort(told)
    told, value = told[order], value[order]
    at = np.minimum(np.searchsorted(told, mine), max(0, len(told) - 1))
    return np.where(told[at] == mine, value[at], missing) if len(told) else np.full(len(mine), missing, np.int64)


def _replies(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column, as flat arrays; list items that are structs give the struct array."""
    column = part.column(part.schema.get_field_index(name))
    size = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return np.repeat(np.arange(len(size)), size), column.flatten()


def _settle_hot(windows: DataFrame, elsewhere: bool) -> DataFrame:
    """Masks of the windows of hot grams, as ``Task.settle`` gives them, without a group per gram."""
    # rows with one id and equal texts send a window twice: kept once
    windows = windows.dropDuplicates(["h1", "h2", "id", "key", "j", "weight"])
    found = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("top"), F.sum("weight").alias("times"))
    found = found.where("times > 1" if elsewhere else "low < top").select("h1", "h2", "low")
    hits = windows.join(found.hint("merge"), ["h1", "h2"])
    return (hits if elsewhere else hits.where("id > low")).groupBy("id", "key").agg(F.expr("bit_or(shiftleft(1L, j))").alias("mask"))


def mark(docs: DataFrame, task: Task, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
         hot: int | None = None) -> DataFrame:
    """Per row: id, the columns named in ``keep`` and what ``task.finish`` gives.

    ``hot`` (``HOT`` by default) says from how many open contexts a gram is settled by the aggregate; results are the same.
    """
    if not 0 < task.gram <= task.length <= task.gram + 62:
        raise ValueError(f"length {task.length} asks for a gram of {max(1, task.length - 62)} to {task.length}, as an anchor's windows are bits of one number")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    packed = index(base.where(F.col("id").isNotNull()).select("id", "text"), task, buckets)
    reply = written(packed.groupBy("bucket").applyInArrow(_resolver(task, HOT if hot is None else hot), REPLY_DDL), "repeats-reply")
    # asked for by the same plan twice: the exchange of the texts is made once and read again
    texts = base.repartition(parts, "id").join(reply.groupBy("id").agg(F.collect_list("reply").alias("replies")), "id", "left")
    open_schema, mask_schema, window_schema = (arrow_schema(x) for x in (OPEN_DDL, MASK_DDL, WINDOW_DDL))

    def chosen_of(part, unit, rows, row, told, want):
        """Anchors, places of the open contexts with the flags in ``want``, their ids and weights."""
        a = anchors(unit, rows, task.length, task.gram)
        flag = _flags(a, row, told >> 3, told & 7, COVERED)
        chosen = np.flatnonzero(np.isin(flag, want))
        # the same context again in the document: sent once, with its weight
        order = chosen[np.lexsort((a.context[chosen], a.row[chosen]))]
        new = np.ones(len(order), bool)
        new[1:] = (a.row[order][1:] != a.row[order][:-1]) | (a.context[order][1:] != a.context[order][:-1])
        first = order[new]
        times = np.diff(np.append(np.flatnonzero(new), len(order)))
        weight = np.minimum(2, np.where(flag[first] & 3 == COVERED_OPEN, 2, times))
        ids = np.array(part.column(0).to_pylist(), dtype=object)[a.row[first]]
        return a, first, ids, weight

    def opened_rows(batches, want):
        for batch in batches:
            for part, buf, off in slices(batch):
                row, told = _replies(part, "replies")
                told = told.to_numpy(zero_copy_only=False).astype(np.int64)
                if np.isin(told & 7, want).any():
                    unit, rows, source = task.units(buf, off)
                    yield (unit, source, *chosen_of(part, unit, rows, row, told, want))

    def send(batches):
        for unit, source, a, first, ids, weight in opened_rows(batches, (OPEN, COVERED_OPEN)):
            yield record(open_schema, bucket=((a.gram[first] >> U64(40)) % U64(buckets)).astype(np.int64), id=ids.tolist(),
                         key=a.context[first], weight=weight, n=a.high[first] - a.low[first] + 1, data=task.pack(source, a, first))

    def send_hot(batches):
        for unit, source, a, first, ids, weight in opened_rows(batches, (OPEN + IS_HOT, COVERED_OPEN + IS_HOT)):
            n = a.high[first] - a.low[first] + 1
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            h1, h2 = window_hashes(unit, np.repeat(a.low[first], n) + j, task.length)
            yield record(window_schema, h1=h1.view(np.int64), h2=h2.view(np.int64), id=np.repeat(ids, n).tolist(),
                         key=np.repeat(a.context[first], n), j=j, weight=np.repeat(weight, n))

    def settle(table: pa.Table) -> pa.Table:
        # rows with one id and equal texts send a context twice: kept once
        ids, key, mask = task.settle(table)
        some = mask != 0
        return pa.table({"id": ids[some], "key": key[some], "mask": mask[some]}, schema=mask_schema)

    told = texts.where(F.col("replies").isNotNull()).select("id", "text", "replies")
    masks = (told.mapInArrow(send, OPEN_DDL).dropDuplicates(["bucket", "id", "key"])
             .groupBy("bucket").applyInArrow(settle, MASK_DDL))
    # only if a gram is hot, so that other tables are not read once more for nothing
    if not reply.where(F.col("reply").bitwiseAND(IS_HOT) != 0).isEmpty():
        masks = masks.unionByName(_settle_hot(told.mapInArrow(send_hot, WINDOW_DDL), task.elsewhere))
    masks = masks.groupBy("id").agg(F.collect_list(F.struct("key", "mask")).alias("masks"))
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    ddl = ", ".join([f"out_id {kinds[0]}", *[f"keep_{i} {k}" for i, k in enumerate(kinds[1:])], task.finish_ddl])
    out_schema = arrow_schema(ddl)

    def finish(batches):
        for batch in batches:
            for part, buf, off in slices(batch):
                unit, rows, source = task.units(buf, off)
                row, told = _replies(part, "replies")
                told = told.to_numpy(zero_copy_only=False).astype(np.int64)
                mask = np.zeros(int(rows[-1]), bool)
                if len(told):
                    a = anchors(unit, rows, task.length, task.gram)
                    flag = _flags(a, row, told >> 3, told & 3, OPEN)
                    hit = flag != OPEN
                    row, masks = _replies(part, "masks")
                    key, bits = (masks.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("key", "mask"))
                    bits = np.where(hit, 0, _flags(a, row, key, bits, 0))
                    some = np.flatnonzero(bits)
                    w, j = np.nonzero((bits[some, None] >> np.arange(63)) & 1) if len(some) else (some, some)
                    start = np.concatenate([a.low[hit], a.low[some][w] + j])
                    end = np.concatenate([a.high[hit], a.low[some][w] + j]) + task.length
                    mask = cover(len(mask), start, end)
                yield record(out_schema, out_id=part.column(part.schema.get_field_index("id")),
                             **{f"keep_{i}": part.column(part.schema.get_field_index(f"keep_{i}")) for i in range(len(keep))},
                             **task.finish(buf, off, source, rows, mask))

    done = texts.join(masks, "id", "left").mapInArrow(finish, ddl)
    for old, new in [("out_id", id_col), *[(f"keep_{i}", c) for i, c in enumerate(keep)]]:
        done = done.withColumnRenamed(old, new)
    return done


def row_sums(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[rows[1:]] - total[rows[:-1]]


def span_counts(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Maximal runs of true per row."""
    edge = mask.copy()
    edge[1:] &= ~mask[:-1]
    first = rows[:-1][np.diff(rows) > 0]
    edge[first] = mask[first]
    return row_sums(edge, rows)


__all__ = ["Anchors", "Task", "anchors", "mark", "row_of", "row_sums", "span_counts"]

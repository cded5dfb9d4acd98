"""Repair of the role structure of conversations with the fewest edits, by Hirschberg's divide and conquer.

A conversation should read ``(system? (user assistant)+)?`` by the first letters of its roles.  Each row is
kept (``K``, cost 0), given the role that is due (``R``, 3) or deleted (``D``, 4; required for blank and duplicate
rows); an empty user or assistant row may be inserted anywhere (``I``, 3); a truncated row that stays costs 3 more.
Among the cheapest repairs the one whose letters are least in ASCII order is taken.

Between two rows a repair is in one of four states: nothing yet, after the system row, after a user row,
after an assistant row.  A row is a table of the costs from state to state (inserts before the row count to it).
The forward vector of the rows before a middle and the backward vector of those after it meet there:
the state with the least sum is the crossing, and both halves are solved alike, in linear space.  Beside each
cost the forward vector keeps the place of its letters among the four states' least letters.  Letters up to
a row end in that row's letter, so none is the beginning of another and the places decide
between crossings of equal cost, as the whole letters would.

A conversation is cut into blocks of ``block_rows`` rows.  Tables of states compose like rows do, so the
same crossing search runs over blocks (in groups of ``fan``, level by level) before it runs in each block: no
task holds more than a block or a group, even if one conversation holds a third of all rows.

Defined results: rows stand by turn (nulls first), then role, then md5 of role and text; null role or text
is one space; a null conversation id is a conversation; equal rows are duplicates from the second on; extra
columns are ignored; the audit of a conversation is one string value, a letter a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordered import numbered

BLOCK_ROWS, FAN, TASK_ROWS = 1024, 64, 8192
NONE, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)             # state after the role that is due in a state
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
INF = float("inf")
BLANK = " \t\n\x0b\x0c\r"


class Step:
    """Costs from state to state, and for each start the order of the least letters to the four ends."""

    def __init__(self, cost: list[float], rank: list[int]):
        self.cost, self.rank = cost, rank
        self.arcs = [(s, t, cost[4 * s + t], rank[4 * s + t]) for s, t in product(range(4), range(4)) if cost[4 * s + t] < INF]


def _step(letters: dict[tuple[int, int], tuple[int, str]]) -> tuple[Step, dict]:
    cost, rank = [INF] * 16, [0] * 16
    for (s, t), (c, _) in letters.items():
        cost[4 * s + t] = c
    for s in range(4):
        ends = sorted((a, t) for (b, t), (_, a) in letters.items() if b == s)
        for place, (_, t) in enumerate(ends):
            rank[4 * s + t] = place
    return Step(cost, rank), letters


def _inserts(state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letters, state) after no, one and two inserts; a third would lead back."""
    for n in range(3):
        yield n * INSERT, "I" * n, state
        state = DUE[state]


def _row_step(initial: str, must: bool, truncated: bool) -> tuple[Step, dict]:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    more = TRUNCATED if truncated else 0
    for s in range(4):
        for cost, letters, q in _inserts(s):
            ways = [(q, cost + DELETE, letters + "D")]
            if not must:
                ways.append((DUE[q], cost + REROLE + more, letters + "R"))
                if (initial, q) in KEEP:
                    ways.append((KEEP[initial, q], cost + more, letters + "K"))
            for t, c, a in ways:
                best[s, t] = min(best.get((s, t), (INF, "")), (c, a))
    return _step(best)


def _end_step() -> tuple[Step, dict]:
    """After the last row: inserts up to an allowed end, which counts as state 0."""
    return _step({(s, 0): min((c, a) for c, a, q in _inserts(s) if q in (NONE, ASSISTANT)) for s in range(4)})


ROWS = {k: _row_step(*k) for k in product(("s", "u", "a", ""), (False, True), (False, True))}
END = _end_step()


def forward(steps: list[Step], start: int) -> tuple[list[float], list[int]]:
    """Least costs from ``start`` to the four states, and the order of their letters."""
    cost, rank = [INF] * 4, [0] * 4
    cost[start] = 0
    for step in steps:
        best: list = [(INF, 0, 0)] * 4
        for s, t, c, r in step.arcs:
            if cost[s] < INF and (way := (cost[s] + c, rank[s], r)) < best[t]:
                best[t] = way
        order = sorted(b[1:] for b in best)
        cost, rank = [b[0] for b in best], [order.index(b[1:]) for b in best]
    return cost, rank


def backward(steps: list[Step], end: int) -> list[float]:
    """Least costs from the four states to ``end``."""
    cost = [INF] * 4
    cost[end] = 0
    for step in reversed(steps):
        new = [INF] * 4
        for s, t, c, _ in step.arcs:
            if c + cost[t] < new[s]:
                new[s] = c + cost[t]
        cost = new
    return cost


def compose(steps: list[Step]) -> Step:
    """The table of consecutive steps."""
    both = [forward(steps, s) for s in range(4)]
    return Step([c for cost, _ in both for c in cost], [r for _, rank in both for r in rank])


def crossings(steps: list[Step], start: int, end: int) -> list[int]:
    """States before, between and after the steps on the cheapest path, of these the least in letters."""
    states = [start] + [end] * len(steps)
    todo = [(0, len(steps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        cost, rank = forward(steps[lo:mid], states[lo])
        rest = backward(steps[mid:hi], states[hi])
        states[mid] = min(range(4), key=lambda q: (cost[q] + rest[q], rank[q]))
        todo += [(lo, mid), (mid, hi)]
    return states


@lru_cache(maxsize=1 << 14)
def _short(kinds: tuple, last: bool, start: int, end: int) -> list[int]:
    return crossings([ROWS[k][0] for k in kinds] + [END[0]] * last, start, end)


def _faults(rows: list[dict], seen: set) -> list[str]:
    """First fault of each row; ``seen`` holds the role-and-text hashes of earlier blocks and is added to."""
    out = []
    for r in rows:
        text = r["text"].strip(BLANK)
        out.append("blank" if not text else "duplicate" if r["_h"] in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add(r["_h"])
    return out


def _row_kinds(rows: list[dict], faults: list[str]) -> tuple:
    """Key of each row's table: initial, whether it must go, whether it is cut."""
    return tuple((r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated")
                 for r, fault in zip(rows, faults))


def _parts(got: list[dict]) -> tuple[list[dict], dict | None, set]:
    """Rows of a block in order, the row before it, hashes seen in earlier blocks."""
    rows = sorted((r for r in got if r["_kind"] == 0), key=lambda r: r["_pos"])
    before = next((r for r in got if r["_kind"] == 1), None)
    return rows, before, {r["_h"] for r in got if r["_kind"] == 2}


_LONGS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "cost")
PIECE_ARROW = pa.schema([("_g", pa.string()), ("_block", pa.int64()), ("_blocks", pa.int64()), *[(c, pa.int64()) for c in _LONGS],
                         ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
PIECE = ("_g string, _block long, _blocks long, blank long, duplicate long, truncated long, illegal long, turns long, "
         "first_turn long, last_turn long, cost long, audit string, repaired array<struct<role: string, text: string>>")


def _piece(rows: list[dict], before: dict | None, seen: set, start: int, end: int) -> dict:
    faults = _faults(rows, seen)
    blocks = rows[0]["_blocks"]
    kinds, last = _row_kinds(rows, faults), rows[0]["_block"] == blocks - 1
    steps = [ROWS[k] for k in kinds] + [END] * last
    # short conversations repeat the same kinds of rows, so their crossings are remembered
    states = _short(kinds, last, start, end) if len(kinds) <= 32 else crossings([s for s, _ in steps], start, end)
    audit, repaired, cost = [], [], 0
    for i, (_, letters) in enumerate(steps):
        c, a = letters[states[i], states[i + 1]]
        cost += c
        audit.append(a)
        q = states[i]
        for x in a:
            if x == "K":
                repaired.append({"role": rows[i]["role"], "text": rows[i]["text"]})
            elif x != "D":
                q = DUE[q]
                repaired.append({"role": ROLE[q], "text": rows[i]["text"] if x == "R" else ""})
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    both = ([before] if before else []) + rows
    pairs = list(zip(both, both[1:]))
    return {"_g": rows[0]["_g"], "_block": rows[0]["_block"], "_blocks": blocks,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a["role"][:1] + b["role"][:1] not in ("su", "ua", "au") for a, b in pairs),
            "turns": sum(b["turn"] is not None and a["turn"] != b["turn"] for a, b in pairs) + (not before and rows[0]["turn"] is not None),
            "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
            "cost": cost, "audit": "".join(audit), "repaired": repaired}


def _solve(table: pa.Table, ends: pa.Table) -> pa.Table:
    blocks: dict[tuple, list[dict]] = {}
    for r in table.to_pylist():
        blocks.setdefault((r["_g"], r["_block"]), []).append(r)
    known = {(r["_g"], r["_block"]): (r["_s"], r["_e"]) for r in ends.to_pylist()}
    parts = [(_parts(got), known.get(key, (NONE, 0))) for key, got in blocks.items()]
    return pa.Table.from_pylist([_piece(*part, *states) for part, states in parts if part[0]], PIECE_ARROW)


TABLE = "_g string, _block long, _blocks long, _cost array<long>, _rank array<int>"
TABLE_ARROW = pa.schema([("_g", pa.string()), ("_block", pa.int64()), ("_blocks", pa.int64()),
                         ("_cost", pa.list_(pa.int64())), ("_rank", pa.list_(pa.int32()))])
ENDS_ARROW = pa.schema([("_g", pa.string()), ("_block", pa.int64()), ("_s", pa.int32()), ("_e", pa.int32())])
ENDS = "_g string, _block long, _s int, _e int"


def _packed(g: str, block: int, blocks: int, step: Step) -> pa.Table:
    return pa.Table.from_pylist([{"_g": g, "_block": block, "_blocks": blocks, "_rank": step.rank,
                                  "_cost": [-1 if c == INF else c for c in step.cost]}], TABLE_ARROW)


def _unpacked(table: pa.Table) -> list[Step]:
    return [Step([INF if c < 0 else c for c in cost], rank) for cost, rank in zip(table["_cost"].to_pylist(), table["_rank"].to_pylist())]


def _block_table(table: pa.Table) -> pa.Table:
    rows, _, seen = _parts(table.to_pylist())
    if not rows:
        return TABLE_ARROW.empty_table()
    r = rows[0]
    steps = [ROWS[k][0] for k in _row_kinds(rows, _faults(rows, seen))] + [END[0]] * (r["_block"] == r["_blocks"] - 1)
    return _packed(r["_g"], r["_block"], r["_blocks"], compose(steps))


def _block_ends(rows: DataFrame, most: int, fan: int) -> DataFrame:
    """States before and after each block of the conversations of several blocks."""
    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        return _packed(table["_g"][0].as_py(), table["_up"][0].as_py(), -(-table["_blocks"][0].as_py() // fan), compose(_unpacked(table)))

    def down(table: pa.Table, ends: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        states = crossings(_unpacked(table), ends["_s"][0].as_py(), ends["_e"][0].as_py())
        return pa.table([table["_g"], table["_block"], pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())],
                        schema=ENDS_ARROW)

    group = F.floor(F.col("_block") / fan)
    levels = [written(rows.groupBy("_g", "_block").applyInArrow(_block_table, TABLE), "conversation-tables")]
    while most > 1:
        levels.append(written(levels[-1].withColumn("_up", group).groupBy("_g", "_up").applyInArrow(up, TABLE), "conversation-tables"))
        most = -(-most // fan)
    ends = levels[-1].select("_g", "_block", F.lit(NONE).alias("_s"), F.lit(0).alias("_e"))
    for level in reversed(levels[:-1]):
        above = ends.withColumnRenamed("_block", "_up")
        ends = level.withColumn("_up", group).groupBy("_g", "_up").cogroup(above.groupBy("_g", "_up")).applyInArrow(down, ENDS)
    return ends


def repair(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """One row per block of a conversation: ``_g``, its place, counts of faults, cost, ``audit`` and ``repaired`` rows."""
    def space(name):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    placed = rows.select(group_key(conv).alias("_g"), F.col(f"`{turn}`").cast("long").alias("turn"),
                         space(role).alias("role"), space(text).alias("text"))
    placed = placed.withColumn("_h", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    placed = numbered(placed, "_g", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_h")], "conversation-rows")
    placed = (placed.withColumn("_block", F.floor(F.col("_pos") / block_rows)).withColumn("_kind", F.lit(0))
                    .withColumn("_blocks", F.floor((F.col("_n") + block_rows - 1) / block_rows)))
    most, total = (x or 0 for x in placed.agg(F.max("_blocks"), F.count(F.lit(1))).first())
    ends = rows.sparkSession.createDataFrame([], ENDS)
    if most > 1:
        many = placed.where("_blocks > 1")
        last = many.where((F.col("_pos") % block_rows == block_rows - 1) & (F.col("_pos") + 1 < F.col("_n")))
        before = last.withColumns({"_block": F.col("_block") + 1, "_kind": F.lit(1)})
        first = many.groupBy("_g", "_h").agg(F.min("_block").alias("_first"))
        again = many.select("_g", "_h", "_block", "_blocks").distinct().join(first, ["_g", "_h"]).where("_block > _first")
        again = again.drop("_first").withColumn("_kind", F.lit(2))
        placed = placed.unionByName(before).unionByName(again, allowMissingColumns=True)
        ends = _block_ends(placed.where("_blocks > 1"), most, fan)
    # blocks are solved some TASK_ROWS rows at a time, as most conversations are short
    deal = F.pmod(F.xxhash64("_g", "_block"), F.lit(max(1, -(-total // TASK_ROWS)))).alias("_deal")
    return placed.groupBy(deal).cogroup(ends.groupBy(deal)).applyInArrow(_solve, PIECE)


def group_key(conv: str):
    """Text key of a conversation id; the null id has its own."""
    return F.coalesce(F.concat(F.lit("c"), F.col(f"`{conv}`").cast("string")), F.lit(""))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose pieces come in order; texts are hashed as they come."""
    schema = pa.schema([(c, pa.string()) for c in ("_g", "audit", "repaired_sha256")])
    key, digest, audit, some = None, None, [], False

    def row():
        return pa.RecordBatch.from_pylist([{"_g": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)
    for batch in batches:
        for piece in batch.to_pylist():
            if piece["_g"] != key:
                if key is not None:
                    yield row()
                key, digest, audit, some = piece["_g"], hashlib.sha256(), [], False
            audit.append(piece["audit"])
            for r in piece["repaired"]:
                digest.update((("\n" if some else "") + f"{r['role']}:{r['text']}").encode())
                some = True
    if key is not None:
        yield row()


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``_g``, gaps, faults, illegal pairs, cost, audit and the digest of the repaired rows."""
    pieces = written(pieces, "conversation-pieces")
    sums = pieces.groupBy("_g").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    one = pieces.where("_blocks = 1").select("_g", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    many = (pieces.where("_blocks > 1").select("_g", "_block", "audit", "repaired").repartition("_g").sortWithinPartitions("_g", "_block")
                  .mapInArrow(_joined, "_g string, audit string, repaired_sha256 string"))
    return sums.join(one.unionByName(many), "_g")


def damaged(convs: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with known faults for tests of a repair, by crc32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user row; a null is one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind, words = F.col("_kind"), F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    rows = convs.withColumn("_kind", F.crc32(key.cast("binary")) % 20).where(kind != 0)
    rows = rows.withColumns({role: F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(f"`{role}`"), F.lit(" "))),
                             text: F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words)})
    return rows.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")

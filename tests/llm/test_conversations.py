"""Conversation repair against a plain search over whole edit strings."""

import hashlib
import random
from functools import lru_cache

import pytest

from tabscope.llm import conversations as C

DDL = "conv_id long, turn long, role string, text string, audit string, cost int, _g string, _block string"


def plain(rows):
    """Cost and letters of the cheapest edits of [(initial, must be deleted, truncated)], least letters first."""
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    @lru_cache(None)
    def rest(i, q, inserts):
        ways = [(0, "")] if i == len(rows) and q in (0, 3) else []
        if inserts < 3:
            cost, text = rest(i, due[q], inserts + 1)
            ways.append((cost + 3, "I" + text))
        if i < len(rows):
            initial, must, cut = rows[i]
            cost, text = rest(i + 1, q, 0)
            ways.append((cost + 4, "D" + text))
            if not must:
                cost, text = rest(i + 1, due[q], 0)
                ways.append((cost + 3 + 3 * cut, "R" + text))
                if (initial, q) in keep:
                    cost, text = rest(i + 1, keep[initial, q], 0)
                    ways.append((cost + 3 * cut, "K" + text))
        return min(ways) if ways else (float("inf"), "")
    return rest(0, 0, 0)


def plain_report(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of [(conv_id, turn, role, text)]."""
    space = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role.encode(), h, role, text, turn))
    out = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: r[:4])
        kinds, seen = [], set()
        for *_, role, text, _turn in got:
            t = text.strip(space)
            kinds.append("b" if not t else "d" if (role, text) in seen else "t" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        roles = [r[4][:1] for r in got]
        cost, audit = plain(tuple((i, k in ("b", "d"), k == "t") for i, k in zip(roles, kinds)))
        lines, q, left = [], 0, iter(got)
        for x in audit:
            row = next(left) if x != "I" else None
            if x == "D":
                continue
            q = {"s": 1, "u": 2, "a": 3}[row[4][:1]] if x == "K" else {0: 2, 1: 2, 2: 3, 3: 2}[q]
            lines.append(f"{row[4]}:{row[5]}" if x == "K" else f"{ {2: 'user', 3: 'assistant'}[q] }:{row[5] if row else ''}")
        turns = [r[6] for r in got if r[6] is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in "bdt"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_crossings_are_the_least_cheapest_edits():
    rng = random.Random(1)
    for n in range(25):
        for _ in range(12):
            rows = tuple((rng.choice(["s", "u", "a", ""]) if rng.random() < .5 else "ua"[i % 2], rng.random() < .2, rng.random() < .2) for i in range(n))
            steps = [C.ROWS[r] for r in rows] + [C.END]

            def solve(lo, hi, start, end):
                states = C.crossings([s for s, _ in steps[lo:hi]], start, end)
                return [steps[lo + i][1][states[i], states[i + 1]] for i in range(hi - lo)]
            got = solve(0, len(steps), 0, 0)
            assert (sum(c for c, _ in got), "".join(a for _, a in got)) == plain(rows)
            size = rng.randint(1, 5)
            cuts = [*range(0, len(steps), size), len(steps)]
            tables = [C.compose([s for s, _ in steps[a:b]]) for a, b in zip(cuts, cuts[1:])]
            states = C.crossings(tables, 0, 0)
            assert got == [x for i, (a, b) in enumerate(zip(cuts, cuts[1:])) for x in solve(a, b, states[i], states[i + 1])]


def sample():
    rng = random.Random(3)
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn if rng.random() < .9 else rng.choice([None, 3]), rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < .4
                         else ["user", "assistant"][turn % 2], rng.choice(["Yes.", "No!", "cut off", " \n", "", None, "é? \t", f"Turn {turn}."])))
    rows += [(99, i // 2, ["user", "assistant", "system"][i % 3 if i % 7 == 0 else i % 2], f"text {i % 40}{'.' * (i % 5 > 0)}") for i in range(150)]
    rows += [(98, None, "user", "same.")] * 30 + [(None, 5, "user", "x" * 50_000 + "."), (None, 2, "assistant", "a."), (None, 2, "assistant", "b.")]
    return [(*r, "x", 7, "y", "z") for r in rows]


@pytest.mark.parametrize("block_rows,fan", [(1024, 64), (4, 2), (7, 3)])
def test_repair_equals_plain_search(spark, block_rows, fan):
    rows = sample()
    pieces = C.repair(spark.createDataFrame(rows, DDL).repartition(5), block_rows=block_rows, fan=fan)
    got = {r._g: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in C.report(pieces).collect()}
    assert got == {"" if k is None else f"c{k}": v for k, v in plain_report(rows).items()}


def test_damage_and_empty(spark):
    from zlib import crc32
    rows = [(c, t, r, x) for c, t, r, x, *_ in sample()]
    out = sorted(map(repr, (tuple(r) for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())))
    want = []
    for c, t, r, x in rows:
        k = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if k == 4 else " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else x.translate({ord(p): None for p in ".!?"}) if k == 2 else x
        want += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert out == sorted(map(repr, want))
    assert C.report(C.repair(spark.createDataFrame([], DDL))).count() == 0

"""Near-duplicate groups and components against brute force."""

import random

import numpy as np
import pytest

from tabscope.llm import neardup
from tabscope.llm.components import components
from tests.llm import brute


def fixture(seed, n=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "the", "Of"]
    docs = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 10, 60, 200]))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(8)):       # near copies at many distances, chains of copies
            w = list(base)
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(rng.choice([" ", "  ", "\n"]).join(w).upper() if rng.random() < .2 else " ".join(w))
            if rng.random() < .5:
                base = w
    docs += [None, "", " \t", "one", "ONE", "one two", "one two three", "One two\nthree", docs[0], docs[0], "same " * 5000, "same " * 4000]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("seed,shingle,cell", [(1, 4, 2048), (2, 5, 2), (3, 4, 3)])
def test_against_brute_force(spark, seed, shingle, cell):
    rows = fixture(seed)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, u long, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle=shingle, cell=cell).collect()}
    assert got == brute.components(rows, shingle)


def test_one_large_group(spark):
    # copies of one text whose pairs lie on both sides of the threshold, far ones not linked to the leader
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for d in range(250):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    for cell in (2048, 20):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle=4, cell=cell).collect()}
        assert got == want
    assert 1 < len({c for _, c in want.values()}) < 250


def test_nulls_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (None, None), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, shingle=4).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (4, 1, 2, False), (4, 1, 2, False), (2, 1, 2, True), (None, 0, None, True), (9, 0, 9, True)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (200, neardup.ELEMENTS)).astype(np.uint16)
    other = sig.copy()
    for r in range(200):
        at = rng.permutation(neardup.ELEMENTS)[:neardup.DISTANCE]
        other[r, at] = rng.integers(0, 1 << 16, len(at))
    assert (neardup.index_keys(sig) == neardup.index_keys(other)).any(axis=1).all()


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    edges = chain + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (500, 499), (500, 499)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cells_hold_few_pairs(spark):
    """A cell of members that are all linked: components as by steps over all pairs, in much less memory than a list of its pairs."""
    import tracemalloc
    import pyarrow as pa
    from tabscope.llm.neardup import _cell, joined
    rng = np.random.default_rng(3)
    for rows, cols in ((np.arange(150), np.arange(150)), (np.arange(140), np.arange(140, 300))):
        c, linked = rng.permutation(300), rng.random((len(rows), len(cols))) < 0.008
        want = c.copy()
        for _ in range(300):
            for i, j in zip(*np.nonzero(linked)):
                want[[rows[i], cols[j]]] = min(want[rows[i]], want[cols[j]])
        assert (joined(c, rows, cols, linked) == want).all()
    n = 1500
    run, _ = _cell(80)
    table = pa.table({"u": [0] * n, "own": [0] * n, "x": [0] * n, "y": [0] * n, "c": list(range(1, n + 1)), "comp": list(range(1, n + 1)),
                      "n_u": [64] * n, "n_c": [64] * n, "missing": [b"\0" * 8] * n, "added": [b""] * n})
    tracemalloc.start()
    got = run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == n - 1 and set(got.column("v").to_pylist()) == {1}
    assert peak < 20 * n * n, peak

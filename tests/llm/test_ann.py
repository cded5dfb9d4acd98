"""NN-descent search against brute force."""

import numpy as np
import pytest

from tabscope.llm import ann
from tabscope.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<double>, score string, node int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 0) for i, v in vectors], SCHEMA)


def brute(vectors, every, k):
    ok = {}
    for i, v in vectors:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            ok[i] = min(ok.get(i, tuple(v)), tuple(v))
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = x @ x[ids == i][0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("shard_rows", [5000, 300])
def test_recall_and_scores(spark, shard_rows):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 24)) * rng.uniform(0.5, 2, (1200, 1))       # norms differ: not cosine
    vectors = list(enumerate(x))
    got, want = {}, brute(vectors, 20, 20)
    for r in nearest(frame(spark, vectors), 20, 20, shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    for ranks in got.values():
        assert sorted(ranks) == list(range(1, 21))
        in_order = [ranks[i] for i in sorted(ranks)]
        assert in_order == sorted(in_order, key=lambda t: (-t[1], t[0]))


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, [1.0, 0.0, 0.0]) for i in range(100)] + [(i, list(rng.normal(size=3))) for i in range(100, 160)]
    vectors += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 0.0]), (260, [1.0, float("nan"), 0.0]), (280, [float("inf"), 0.0, 0.0]),
                (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 0.0, 0.0]), (140, [9.0, 9.0, 9.0])]
    want = brute([v for v in vectors if v[0] != 300], 20, 10)
    got = {}
    for r in nearest(frame(spark, vectors), 20, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert got == {q: [(v, round(s, 9)) for v, s in near] for q, near in want.items()}


def test_few_rows_and_empty(spark):
    assert nearest(frame(spark, [])).count() == 0
    assert nearest(frame(spark, [(20, [1.0, 0.0])])).count() == 0
    got = nearest(frame(spark, [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]


def test_graph_is_the_same_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    nodes = spark.createDataFrame([(i % 2, i, [float(c) for c in rng.normal(size=6)]) for i in range(160)], "shard int, node long, vec array<double>")
    graphs = []
    for task_pairs in (1 << 30, 1 << 10):      # one part, and several
        monkeypatch.setattr(ann, "TASK_PAIRS", task_pairs)
        graphs.append(sorted(map(tuple, ann.build_graph(nodes, 6.0, degree=8, reverse=4, rounds=2).collect())))
    assert graphs[0] == graphs[1] and len(graphs[0]) == 160 * 8

"""Winnowing against a brute-force search, in both ways of joining."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from tabscope.llm.decontaminate import contamination
from tests.llm import brute


def fixture(seed=1):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "dé", "E5", "zz", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 7, 9, 10, 11, 25, 40]))) for i in range(30)]
    items += [(None, "unique words of a nameless item that nobody else has got here today"), (5, items[7][1]), (99, None), (98, ""), (97, "--- ... ")]
    docs = [text(rng.randint(0, 120)) for _ in range(60)]
    for i in range(0, 60, 3):
        body = items[rng.randrange(30)][1]
        docs[i] = f"{text(5)}. {body.upper()}, {text(4)}"
    docs += [items[31][1], None, "", "?!", docs[0], docs[0], "Unique-words of a NAMELESS item that nobody else has got here today!!",
             "x " * 20_000 + items[3][1]]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_against_brute_force(spark, limit):
    docs, items = fixture()
    want = brute.contamination(docs, items)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination(df, bench, broadcast_bytes=limit).collect()}
    assert len(got) == len(docs)
    for i, (n, hit, names) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), names), docs[i][:200]
        assert {p for s in r.spans for p in range(s.first, s.end)} == hit


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = contamination(docs, none).collect()[0]
    assert (row.n_words, row.n_hit, row["items"]) == (3, 0, [])
    assert contamination(docs.limit(0), none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=5), st.lists(st.text(alphabet="ab ", max_size=50), max_size=4))
def test_index_finds_every_window(docs, texts):
    import numpy as np
    from tabscope.llm.common import ALNUM, words
    from tabscope.llm.decontaminate import Index
    items = [(str(i), t) for i, t in enumerate(texts)]
    raw = [d.encode() for d in docs]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    _, _, unit, rows = words(np.frombuffer(b"".join(raw), np.uint8), off, ALNUM)
    start, end, row, item = Index(items, 4, 3).hits(unit, rows)
    for r, (n, hit, names) in enumerate(brute.contamination(docs, items, 4)):
        mine = row == r
        assert {p - rows[r] for a, b in zip(start[mine], end[mine]) for p in range(a, b)} == hit
        assert sorted({items[i][0] for i in item[mine]}) == names

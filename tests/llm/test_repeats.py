"""Byte and word repeats against brute force."""

import random

import numpy as np
import pytest

from tabscope.llm.factors import remove_repeated_words
from tabscope.llm.suffixes import radix_groups, remove_repeats
from tests.llm import brute


def fixture(seed, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "stré", "ab", "A", "zz.", "naïve,", "x"]
    text = lambda n: " ".join(rng.choice(vocab) + (str(rng.randrange(50)) if rng.random() < .5 else "") for _ in range(n))
    passages = [text(k) for k in (5, 8, 12, 13, 30, 60)]
    docs = []
    for _ in range(n):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randrange(3)):
            t += rng.choice(["", " ", "\n", ". "]) + rng.choice(passages) + rng.choice(["", " ", "\t", "!"]) + text(rng.randint(0, 20))
        docs.append(t)
    docs += [docs[0], docs[0], docs[3], None, "", "short", "Orre " * 400, "Orre " * 30, "a" * 300, "a" * 49, "a" * 50, "\n", "ß" * 60,
             "q" + "ß" * 60, text(3000), docs[0][7:200], "日本" * 40]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = fixture(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, id long")
    got = {r.doc_id: r for r in remove_repeats(df, 50).collect()}
    assert len(got) == len(rows)
    for (d, t), mask in zip(rows, brute.removed_bytes(rows)):
        raw, r = (t or "").encode(), got[d]
        assert bytes(r.kept) == bytes(b for b, m in zip(raw, mask) if not m)
        assert (r.n_bytes, r.n_removed) == (len(raw), sum(mask))
        assert r.n_spans == sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))


@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed):
    rows = fixture(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, id long")
    for size, gram in ((35, 15), (8, 3)):
        got = {r.doc_id: r for r in remove_repeated_words(df, size, gram).collect()}
        for (d, t), mask in zip(rows, brute.removed_words([t for _, t in rows], size)):
            w, r = brute.split8(t), got[d]
            assert r.kept.encode() == b" ".join(x for x, m in zip(w, mask) if not m)
            assert (r.n_words, r.n_removed) == (len(w), sum(mask))


def test_text_is_valid_and_columns_stay(spark):
    rows = fixture(5)
    df = spark.createDataFrame([(d, t, None, d) for d, t in rows], "doc_id long, text string, lang string, kept_0 long")
    masks = dict(zip([d for d, _ in rows], brute.removed_bytes(rows)))
    for r in remove_repeats(df, 50, keep=("lang", "kept_0"), as_text=True).collect():
        text = dict(rows)[r.doc_id] or ""
        mask, at, want = masks[r.doc_id], 0, ""
        for ch in text:
            n = len(ch.encode())
            want += "" if all(mask[at:at + n]) else ch
            at += n
        assert r.kept == want and r.kept_0 == r.doc_id


def test_null_ids_repeated_rows_and_empty(spark):
    t = "a passage of some length that comes up in several rows of the table, twice"
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (5, t), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, len(r.kept)) for r in remove_repeats(df, 50).collect()), key=str)
    assert got == [(3, len(t)), (3, len(t)), (5, 0), (7, 0), (None, len(t))]
    assert remove_repeats(df.limit(0), 50).count() == 0
    assert remove_repeated_words(df.limit(0), 3, 2).count() == 0
    got = remove_repeated_words(df, 3, 2).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=str) == [(3, 15), (3, 15), (5, 15), (7, 0), (None, 0)]


def test_radix_groups():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    start, doc = np.arange(3900), rng.integers(0, 5, 3900)
    for length in (3, 8, 13):
        left, low = radix_groups(data, start, doc, length)
        groups = {}
        for s, d in zip(start, doc):
            groups.setdefault(data[s:s + length].tobytes(), []).append(d)
        want = {(int(s), min(g)) for s in start if min(g := groups[data[s:s + length].tobytes()]) < max(g)}
        assert set(zip(left.tolist(), low.tolist())) == want


def test_hot_grams_leave_the_group(spark, monkeypatch):
    # grams with more open contexts than ``hot`` go through the aggregate: same masks, and the groups get none of their records
    rows = fixture(6)
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")
    want = {d: sum(m) for (d, _), m in zip(rows, brute.removed_bytes(rows))}
    for hot in (0, 3):
        got = {r.doc_id: r.n_removed for r in remove_repeats(df, 50, hot=hot).collect()}
        assert got == want, hot
    for hot in (0, 3):
        for size, gram in ((35, 15), (8, 3)):
            got = {r.doc_id: r.n_removed for r in remove_repeated_words(df, size, gram, hot=hot).collect()}
            assert got == {d: sum(m) for (d, _), m in zip(rows, brute.removed_words([t for _, t in rows], size))}, (hot, size)

    # a line of 35 bytes between different neighbours: one open context per document under its gram
    line = "the same short line in every file. "
    rng = random.Random(7)
    own = lambda: "".join(rng.choice("abcdefghij ") for _ in range(80))
    rows = [(i, own() + line + own()) for i in range(400)] + [(500, own() + own())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = spark.sparkContext.accumulator(0)
    from tabscope.llm import suffixes
    plain = suffixes.settle_bytes

    def counted(length):
        settle = plain(length)

        def run(table):
            sizes.add(table.num_rows)
            return settle(table)
        return run
    monkeypatch.setattr(suffixes, "settle_bytes", counted)
    seen = []
    for hot in (None, 50):
        sizes.value = 0
        got = {r.doc_id: r.n_removed for r in remove_repeats(df, 50, hot=hot).collect()}
        assert got == {d: sum(m) for (d, _), m in zip(rows, brute.removed_bytes(rows))}
        seen.append(sizes.value)
    assert seen[0] >= 400 and seen[1] < seen[0] / 3


def test_windows_beyond_the_mask_are_refused(spark):
    from tabscope.llm.factors import remove_repeated_words
    from tabscope.llm.suffixes import remove_repeats
    docs = spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string")
    for call in (lambda: remove_repeats(docs, length=200, gram=20), lambda: remove_repeated_words(docs, length=90, gram=15)):
        with pytest.raises(ValueError):
            call()

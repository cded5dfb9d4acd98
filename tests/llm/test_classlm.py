"""The class n-gram model against plain counting and probabilities that sum to one."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import classlm as L

DDL = "doc_id long, text string, train int, classes string, score int, chunk string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(5)
    tongues = [["the", "of", "cat", "dog", "runs", "sees", "big", "a"], ["le", "de", "chat", "chien", "court", "voit", "grand", "un"]]
    out = []
    for i in range(150):
        w = tongues[i % 2]
        text = [rng.choice(w[:2] if j % 2 else w[2:]) + (str(rng.randint(0, 30)) if rng.random() < .15 else "") for j in range(rng.randint(1, 40))]
        out.append((i, " ".join(text).capitalize(), 0, "x", 1, "y"))
    return out + [(900, None, 0, None, 1, "y"), (901, "", 0, None, 1, "y"), (None, "\t\nThe  É\x0bcat ", 0, None, 1, "y"), (902, "zz yy xx the ww vv", 0, "", 1, ""),
                  (903, "the " * 30_000, 0, "", 1, ""), (904, "same text", 0, "", 1, ""), (904, "same text", 0, "", 1, "")]


def scored(spark, rows, parts=3, **more):
    df = spark.createDataFrame(rows, DDL).repartition(parts)
    return L.class_scores(df, F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 2, **more)


def plain_scores(rows):
    """{(id, text): (n_tokens, n_known, N, base, score)} from the texts and the class of each word."""
    seqs = [(d, t, (d or 0) % 5 != 2, tokens(t), list(c)) for d, t, c in rows]
    n, cls = Counter(), {}
    for _, _, train, w, c in seqs:
        assert len(c) == len(w) + 1
        for x, k in zip(w, c):
            assert cls.setdefault(x, k) == k            # a word has one class
        if train:
            n.update(w)
    ends = sum(s[2] for s in seqs)
    end = {c[-1] for *_, c in seqs}.pop()
    total, types = sum(n.values()) + ends, len(n) + (ends > 0)
    assert all((cls[x] == L.UNKNOWN) == (n[x] == 0) for x in cls)
    once, twice = (sum(v == i for v in n.values()) for i in (1, 2))
    d = once / (once + 2 * twice) if once and twice else .5
    mass, kinds = Counter(), Counter()
    for x, v in n.items():
        mass[cls[x]] += v
        kinds[cls[x]] += 1
    tri, bi, uni = defaultdict(Counter), defaultdict(Counter), Counter()
    for *_, train, w, c in seqs:
        if train:
            for a, b, x in zip([end, end] + c, [end] + c, c):
                tri[a, b][x] += 1
                bi[b][x] += 1
                uni[x] += 1

    def p(a, b, x):
        q = (uni[x] + 1) / (sum(uni.values()) + end + 1)
        for row in (bi[b], tri[a, b]):
            if row:
                q = (row[x] + len(row) * q) / (sum(row.values()) + len(row))
        return q
    memo = {}

    def unknown(a, b):
        if (a, b) not in memo:
            memo[a, b] = [p(a, b, x) * (d * kinds[x] + 1) / (mass[x] + 1) for x in range(end)]
        return memo[a, b]
    out = {}
    for i, t, _, w, c in seqs:
        base = sum(math.log10((n[x] + 1) / (total + types + 1)) for x in w) + math.log10((ends + 1) / (total + types + 1))
        a = b = end
        score = 0.0
        for x, k in zip(w + [None], c):
            if k == L.UNKNOWN:
                u = unknown(a, b)
                score += math.log10(sum(u))
                k = int(np.argmax(u))
            else:
                score += math.log10(p(a, b, k) * (1 if x is None else (n[x] - d) / (mass[k] + 1)))
            a, b = b, k
        out[i, t] = (len(w) + 1, sum(n[x] > 0 for x in w) + (ends > 0), total, base, score)
    # all known words, the unknown word and the end, after some histories
    for a, b in [(end, end), (0, end), (0, 0)]:
        words = sum(p(a, b, k) * (n[x] - d) / (mass[k] + 1) for x, k in cls.items() if n[x])
        assert words + sum(unknown(a, b)) + p(a, b, end) == pytest.approx(1, abs=1e-9)
    return out


@pytest.mark.parametrize("classes,chunk_bytes", [(4, 500), (64, 1 << 23), (1, 1)])
def test_scores_equal_plain_model(spark, classes, chunk_bytes):
    rows = corpus()
    got = scored(spark, rows, classes=classes, chunk_bytes=chunk_bytes).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    want = plain_scores([(r.doc_id, texts[r.doc_id][0], r.classes) for r in got])
    assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in rows)
    for r in got:
        w = want[r.doc_id, texts[r.doc_id][0]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


def test_layout_does_not_matter(spark):
    one = {(r.doc_id, r.n_tokens): r.score for r in scored(spark, corpus(), 1, classes=6).collect()}
    many = {(r.doc_id, r.n_tokens): r.score for r in scored(spark, corpus(), 9, classes=6, chunk_bytes=300).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)


def test_exchange_parts_the_tongues_and_lowers_perplexity(spark):
    rows = corpus()
    got = scored(spark, rows, classes=6).collect()
    cls = {}
    for r in got:
        if r.doc_id is not None and r.doc_id < 150:
            cls.update(zip(tokens(rows[r.doc_id][1]), r.classes))
    assert {cls[w] for w in ("the", "of")}.isdisjoint(cls[w] for w in ("le", "de"))
    assert {cls[w] for w in ("cat", "dog", "runs")}.isdisjoint(cls[w] for w in ("chat", "chien", "court"))
    held = [r for r in got if not r.train and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_empty_and_no_training(spark):
    assert scored(spark, []).count() == 0
    got = scored(spark, [(2, "a b a", 0, "", 0, ""), (7, None, 0, "", 0, "")]).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(got)] == [(4, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in got)

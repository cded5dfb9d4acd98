"""Language, quality and toxicity: held-out accuracy, Viterbi against brute force, and the edge cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import labelled, language, quality, toxicity
from tabscope.llm.common import crc_mod, read_table
from tabscope.llm.queries import QUERIES
from tests.conftest import SF_ORACLE

EDGE = [(-1, None), (-2, ""), (-3, "12 34 !?"), (None, "the and of that"), (-5, "\U0001F600 — ·"), (-6, "word " * 20_000), (-6, "word " * 20_000)]


def edge_rows(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in EDGE], "doc_id long, text string, score string, spans int")


@pytest.fixture(scope="module")
def tables(spark):
    return read_table(spark, SF_ORACLE, "documents"), read_table(spark, SF_ORACLE, "labels")


def held_out_share(spark, name, label, right):
    out = QUERIES[name][0](spark, SF_ORACLE)
    truth = read_table(spark, SF_ORACLE, label[0]).select("doc_id", F.col(label[1]).alias("truth"))
    rows = out.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    return np.mean([right(r) for r in rows])


def test_held_out_accuracy(spark):
    assert held_out_share(spark, "op1_language", ("documents", "lang"), lambda r: r.lang_pred == r.truth) > 0.98
    assert held_out_share(spark, "op4_quality", ("labels", "quality"), lambda r: r.predicted == r.truth) > 0.9
    assert held_out_share(spark, "op9_toxicity", ("labels", "toxic"), lambda r: r.predicted == r.truth) > 0.9


def test_folds(spark, tables):
    import zlib
    ids = [0, 1, 17, 999, -4]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(crc_mod("doc_id", 5).alias("m")).collect()
    assert [r.m for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in ids]
    used = {r.doc_id for r in labelled.training_labels(tables[1], "toxic", 10_000, folds=3, held_out=1).collect()}
    assert used and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in used)
    few = labelled.training_labels(tables[1], "toxic", 7).groupBy("y").count().collect()
    assert sorted((r.y, r["count"]) for r in few) == [(0, 7), (1, 7)]


def test_language_spans_and_edges(spark, tables):
    model = language.train(tables[0])
    texts = {r.lang: r.text for r in tables[0].where(F.length("text").between(300, 3000)).collect()}
    mixed = " ".join([texts["en"][:250], texts["es"][:250], texts["de"][:250]])
    df = edge_rows(spark).select("doc_id", "text").union(spark.createDataFrame([(1, mixed)], "doc_id long, text string"))
    rows = language.identify(df, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGE) + 1
    assert [s.lang for s in got[1].spans if s.end - s.first > 5] == ["en", "es", "de"]
    for d in (-1, -2, -3, -5):
        assert (got[d].lang_pred, got[d].score, got[d].spans) == ("und", 0.0, [])
    assert got[None].lang_pred == "en" and got[-6].lang_pred != "und"
    nothing = language.train(tables[0].limit(0))
    assert nothing is None and {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_script_narrows_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир это язык", "ru"), ("hello world this is text", "en")] * 5)]
    model = language.train(spark.createDataFrame(rows + [(99, "null language", None)], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "мир hello world"), (2, "щъыэ"), (3, "zzz")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(df, model, penalty=2.0).collect()}
    assert [(s.first, s.end, s.lang) for s in got[1].spans] == [(0, 1, "ru"), (1, 3, "en")]
    assert got[2].lang_pred == "ru" and got[3].lang_pred == "en"


def test_viterbi_is_optimal():
    rng = np.random.default_rng(4)
    score, which = rng.normal(size=(12, 3)).astype(np.float32), rng.integers(0, 12, 14)
    rows = np.array([0, 6, 6, 7, 14])
    for penalty in (0.0, 0.7, 3.0):
        path = language.viterbi(score, which, rows, penalty)
        for a, b in zip(rows[:-1], rows[1:]):
            def value(p):
                return sum(score[w, x] for w, x in zip(which[a:b], p)) - penalty * sum(x != y for x, y in zip(p, p[1:]))
            assert abs(value(path[a:b]) - max(map(value, itertools.product(range(3), repeat=b - a)))) < 1e-5


def test_quality_edges(spark, tables):
    rows = quality.score(edge_rows(spark), tables[1].limit(0)).collect()
    assert {r.score for r in rows} == {0.5}
    docs = tables[0].select("doc_id", "text").union(edge_rows(spark).select("doc_id", "text"))
    got = {r.doc_id: r for r in quality.score(docs, tables[1].union(tables[1])).collect() if r.doc_id is None or r.doc_id < 0}
    assert got[-1].score == got[-2].score and got[-1].measure == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    one_class = tables[1].where("quality = 1")
    assert len({r.score for r in quality.score(docs, one_class).collect()}) == 1
    assert quality.score(docs.limit(0), tables[1]).count() == 0


def test_toxicity_edges(spark, tables):
    docs = tables[0].select("doc_id", "text").union(edge_rows(spark).select("doc_id", "text"))
    rows = toxicity.score(docs, tables[1]).where("doc_id IS NULL OR doc_id < 0").collect()
    got = {r.doc_id: r.toxicity_score for r in rows}
    assert len(rows) == len(EDGE) and got[-1] == got[-2] == got[-3] < 0.5
    assert {r.toxicity_score for r in toxicity.score(docs, tables[1].limit(0)).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), tables[1], keep=("text",)).columns == ["doc_id", "text", "toxicity_score"]


def test_counterfactual_penalty_moves_weight_off_identity_terms(spark):
    # toxic texts often name one group; the insult is the cause, the group a bystander
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        filler = f"word{i % 17} thing{i % 13} other{i % 11}"
        rows.append((i, f"{filler} {'muslim' if toxic and i % 3 else 'people'} {'fool' if toxic else 'friend'} {i}"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "my muslim friend"), (2, "you fool")], "doc_id long, text string")
    result = {}
    for penalty in (0.0, 50.0):
        model = toxicity.fit(docs, labelled.training_labels(marks, "toxic", 1000), penalty=penalty)
        for r in probe.collect():
            raw = np.frombuffer(r.text.encode(), np.uint8)
            result[penalty, r.doc_id] = float(model.score(raw, np.array([0, len(raw)]))[0])
    assert result[50.0, 1] < result[0.0, 1] - 0.1 and result[50.0, 1] < 0.5
    assert result[50.0, 2] > 0.7
    assert toxicity.swapped("A Muslim woman") == "A christian man"


def test_capped_sample_keeps_the_class_shares(spark, tables):
    # labels that do not depend on the text: every score is near the share of ones, whatever the cap
    docs = tables[0].select("doc_id", "text")
    marks = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    sample = labelled.training_labels(marks, "quality", 60).groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    counts = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    assert {r.y: r.n for r in sample} == {0: 60, 1: 60} and all(abs(r.w - counts[r.y]) < 1e-6 for r in sample)
    got = quality.score(docs, marks, per_class=60).agg(F.avg("score")).first()[0]
    assert 0.8 < got < 0.97
    # half of the 100 toxic and 5 % of the 900 other texts hold the word: 50 of 95 are toxic
    rows, marks = [], []
    for i in range(1000):
        toxic = int(i % 10 == 0)
        rows.append((i, f"text{i} part{i % 7} {'grump' if i // 10 % (2 if toxic else 20) == 0 else 'friend'}"))
        marks.append((i, toxic))
    docs = spark.createDataFrame([*rows, (5000, "grump")], "doc_id long, text string")
    marks = spark.createDataFrame(marks, "doc_id long, toxic int")
    for cap in (1000, 100):
        assert 0.4 < toxicity.score(docs, marks, per_class=cap).where("doc_id = 5000").first().toxicity_score < 0.65, cap

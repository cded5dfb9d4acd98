"""The chain against brute-force stages on a small corpus."""

import random

import pytest

import corpus_pipeline
from tabscope.llm.common import read_table
from tabscope.llm.encode import Encoder, vocabulary
from tests.llm import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = ["".join(rng.choice(["th", "er", "an", "on", "ri", "é", "sch"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, items = [text(60) for _ in range(3)], [text(rng.choice([6, 14, 40])) for _ in range(12)]
    docs, labels = [], []
    for i in range(300):
        t = text(rng.randint(5, 200))
        toxic = i % 6 == 0
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum"]))
            t = " ".join(w)
        elif i % 11 == 1:
            t = f"{text(20)} {passage[i % 3]} {text(15)}"
        elif i % 13 == 2:
            t = f"{text(20)} {rng.choice(items).upper()} {text(15)}"
        docs.append(t)
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    for i in range(0, 60, 4):           # exact and near copies
        w = docs[i + 1].split()
        docs.append(docs[i + 1])
        w[rng.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    whole = max(docs, key=len)          # a document that lies whole in another
    docs += [None, "", "a", "a", "idiot", whole[30:330]]
    rows = [(i, t, None if i % 7 == 0 else "en", "s", len(t or ""), i) for i, t in enumerate(docs)]
    rows.append(rows[5])
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, corpus):
    path, rows, items = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_array_dedup", "decontamination", "packing"]
    docs = read_table(spark, path, "documents")
    columns = docs.columns
    have = sorted(rows, key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name == "packing":
            break
        assert out.columns == columns
        got = sorted(map(tuple, out.collect()), key=str)
        if name == "toxicity":
            want = [r for r in have if not {"idiot", "scum"} & set((r[1] or "").split())]
        elif name == "near_duplicates":
            part = brute.components([(r[0], r[1]) for r in dict((r[0], r) for r in have).values()], n=5)
            want = list({r[0]: r for r in have if part[r[0]][1] == r[0]}.values())
        elif name == "suffix_array_dedup":
            want = []
            for r, mask in zip(have, brute.removed_bytes([(r[0], r[1]) for r in have], corpus_pipeline.PASSAGE_BYTES)):
                if not any(mask):
                    want.append(r)
                    continue
                kept, at = "", 0
                for ch in r[1]:
                    n = len(ch.encode())
                    kept += "" if all(mask[at:at + n]) else ch
                    at += n
                if kept.strip(" "):
                    want.append((r[0], kept, *r[2:4], len(kept), r[5]))
        else:
            hits = brute.contamination([r[1] for r in have], list(enumerate(items)))
            want = [r for r, (_, hit, _) in zip(have, hits) if not hit]
        assert got == sorted(want, key=str), name
        assert got != have, f"{name} takes effect"
        have, docs = got, spark.createDataFrame(got, docs.schema)
    encode = Encoder(vocabulary("byte_bpe_50k.json")).tokenizer
    tokens = {}
    for p in sorted(out.collect(), key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(tokens.setdefault(p.doc_id, b"")) // 4
        tokens[p.doc_id] += bytes(p.ids)
    import numpy as np
    assert tokens == {r[0]: np.array(encode.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in have}


def test_run_and_empty_tables(spark, corpus, tmp_path):
    path, _, _ = corpus
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 100
    for t in ("documents", "labels", "benchmark"):
        read_table(spark, path, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids(spark, corpus):
    path, _, _ = corpus
    docs = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (1, None)], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert sorted(map(tuple, stage(spark, docs, path).collect()), key=str) == [(1, None), (None, "x y z"), (None, "x y z")], name


def test_columns_of_any_name(spark, corpus):
    """Given columns with the names of the operators' own, with dots or of type map come through every stage as they were."""
    path, _, _ = corpus
    names = ["kept", "n_removed", "n_hit", "items", "toxicity_score", "n_bytes", "id", "a.b", "component_id", "n_words"]
    ddl = "doc_id long, text string, " + ", ".join(f"`{n}` double" for n in names) + ", m map<string,int>"
    rows = [(i, f"plain words number {i} about nothing at all", *[77.0 + i] * len(names), {"k": i}) for i in range(6)]
    docs = spark.createDataFrame(rows, ddl)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == rows, name

"""Encoding, packing and the wavelet matrix against direct encoding and exact round trips."""


import numpy as np
import pytest

from tabscope.llm.encode import Encoder, vocabulary
from tabscope.llm.packing import Packer, pack
from tabscope.llm.wavelet import WaveletMatrix, build, round_trip

TEXTS = ["", None, "  a  b   c", "É É. é,x it's don't I'LL <|endoftext|>a<|STARTOFTEXT|> a.b,c..d, ,",
         "a b 　c dà e", "\t\n", " x", "x ", "日本語 テスト。а б", "1234 5.6,7", "ß. Ñ, Straße's",
         "the long text " * 3000, "the long text " * 3000, "a 'b 's  'll\x00 q", "É é"]


def rows(spark, texts=TEXTS):
    # an extra column whose name clashes with an output column
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start long")


@pytest.mark.parametrize("name,end", [("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 1)])
def test_encoder_equals_direct(name, end):
    from tabscope.llm.common import slices
    import pyarrow as pa
    e = Encoder(vocabulary(name))
    batch = pa.RecordBatch.from_pydict({"text": TEXTS})
    for limit in (1, 40, 1 << 22):
        got = []
        for _, buf, off in slices(batch, limit=limit):
            ids, at = e(buf, off)
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [x.ids for x in e.tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def direct(name, end):
    e = Encoder(vocabulary(name))
    return [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for t in TEXTS]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 300_000), np.zeros(5, int), np.array([3, 3, 1, 0, 3]), np.zeros(0, int)):
        ids = ids.astype(np.uint32)
        m = WaveletMatrix(build(ids, np.array([len(ids)])))
        assert (m.decode() == ids).all()
        for i in rng.integers(0, len(ids), 20) if len(ids) else []:
            t = int(ids[i])
            assert m.access(int(i)) == t
            assert m.rank(t, int(i)) == int((ids[:i] == t).sum())
            assert m.select(t, m.rank(t, int(i))) == i
        assert m.select(70_000, 0) == -1 and m.rank(1 << 20, len(ids)) == 0


def test_round_trip(spark):
    ref = direct("word_bpe_49k.json", 2)
    got = round_trip(rows(spark), vocabulary("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(TEXTS)))
    assert [r.ids for r in got] == [bytearray(x.tobytes()) for x in ref]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ref)])[:-1].tolist()
    assert [r.n_tokens for r in got] == [len(x) for x in ref]
    empty = round_trip(rows(spark, []), vocabulary("word_bpe_49k.json"))
    assert empty.count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a"), (1, "c"), (1, "c")], "doc_id long, text string")
    got = round_trip(df, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1]
    assert [r.start for r in got] == [0, 2, 4, 6]
    assert pack(df, vocabulary("byte_bpe_50k.json")).count() >= 4


def check_pieces(pieces, ref, window):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for d, ids in ref.items():
        ps = sorted(by_doc[d], key=lambda p: p["start"])
        at = 0
        for p in ps:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert bytes(p["ids"]) == ids[at:at + p["length"]].tobytes()
            at += p["length"]
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and at & (at - 1) == 0, "no padding: full or a power of two"


def test_pack(spark):
    ref = dict(enumerate(direct("byte_bpe_50k.json", 1)))
    for window in (2048, 16):
        got = pack(rows(spark), vocabulary("byte_bpe_50k.json"), window=window).collect()
        check_pieces([r.asDict() for r in got], ref, window)
    assert pack(rows(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packer_keeps_few_open_windows():
    rng = np.random.default_rng(2)
    packer, ref = Packer(64, open_limit=50), {}
    for i in range(3000):
        ref[i] = np.arange(rng.integers(1, 150)).astype("<u4")
        packer.add(i, ref[i])
        assert packer.n_open < 50
    packer.close()
    names = "doc_id start length ids doc_tokens sequence_id offset".split()
    check_pieces([dict(zip(names, (*p[:3], p[3].tobytes(), *p[4:]))) for p in packer.out], ref, 64)
    uncut = sum(1 for p in packer.out if p[2] == p[4])
    assert uncut > 900


def test_packer_holds_no_slices():
    """An open piece owns its ids: a view would keep the ids of its whole slice in memory."""
    packer = Packer(64)
    ids = np.arange(100_000, dtype="<u4")
    packer.add(1, ids[:70])
    packer.add(2, ids[70:100])
    held = [p[2] for fill in packer.open for pieces in fill for p in pieces]
    assert held and not any(np.shares_memory(x, ids) for x in held)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_marks_after_letters(name):
    """Every ASCII mark after, before and between letters, with accents on either side; known and new pieces in one call."""
    marks = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    texts = [f"ab{m}cd{m}{m} é{m}x e\u0301{m} {m}a{m}\u0338b A{m}B 1{m}2 <|endoftext|>a{m}" for m in marks] + ["".join(marks), "a".join(marks)]
    e = Encoder(vocabulary(name))
    for rows in (texts[:5], texts, texts[::-1], [t.replace("<|", "") for t in texts]):
        buf = [t.encode() for t in rows]
        ids, at = e(np.frombuffer(b"".join(buf), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in buf])]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in rows]


def test_words_with_marks_share_pieces():
    """A word is one piece whatever mark follows it, so each is encoded once."""
    e = Encoder(vocabulary("word_bpe_49k.json"))
    text = b"word! word% word$$ word; word"
    e(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sorted(e.place) == ["!", "$$", "%", ";", "word"]

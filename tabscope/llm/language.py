"""Language identification: script ranges, per-word scores and a Viterbi path with a switching penalty.

A word is a run of ASCII letters and bytes from 0x80 up, in lower case.  Its script is that of its first character
beyond ASCII (Latin without one); only languages whose training words use that script are candidates (all, if none does).
A word's score for a language is the mean over the n-gram lengths of the summed log frequencies of its byte n-grams (blanks mark
the word's ends).  The path of languages through a text maximises the summed scores minus ``penalty`` per switch,
which gives spans of mixed-language text; the language with most letter bytes is the text's, its share the score.

Training reads at most ``per_language`` rows a language (2,000, in the order of a hash of the id), whatever the
size of the table, and hashes n-grams into ``BUCKETS`` counts a language; labelling reads every whole text.
Nulls and ties: a null text, an empty one and one without a letter are ``und`` with score 0 and no span, as is
every text if nothing is learned; ties go to the language that sorts first; equal rows are each
labelled; rows with a null language teach nothing.  Only id, text and language are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import top_k_per_group
from .common import U64, arrow_schema, mix64, record, row_of, runs, slices, text_buffer

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
UNKNOWN = "und"
SLICE = 1 << 24
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
# fixed values: first code points of script ranges (Unicode blocks); a range ends where the next begins
SCRIPTS = ((0x00, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
           (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Other"),
           (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"),
           (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
           (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
           (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"),
           (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"))
NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS])
_NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS])
_ANY_LETTER = regex.compile(r"\p{L}")


def distinct_words(texts: pa.Array):
    """Distinct lower-cased words (bytes with a blank before and after each, offsets), word numbers in text order, word byte
    lengths, row offsets in words."""
    buf, off = text_buffer(pc.utf8_lower(texts))
    start, end = runs(LETTER[buf], off)
    length = end - start
    rows = np.searchsorted(start, off)
    if len(start) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), length, rows
    stop = np.cumsum(length)
    data = buf[np.arange(int(stop[-1])) + np.repeat(start - (stop - length), length)]
    column = pa.Array.from_buffers(pa.large_binary(), len(start),
                                   [None, pa.py_buffer(np.append(0, stop).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    buf, off = text_buffer(column.dictionary)
    n = np.diff(off)
    padded = np.full(len(buf) + 2 * len(n), 32, np.uint8)
    padded[np.arange(len(buf)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = buf
    return padded, np.append(0, np.cumsum(n + 2)), column.indices.to_numpy().astype(np.int64), length, rows


def grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each ``n``-gram of the padded words; a shorter word has one gram, itself."""
    size = np.diff(off)
    count = np.maximum(size - n + 1, 1)
    word = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][word]
    h = np.full(len(at), n, np.uint64)
    last = off[1:][word]
    for j in range(n):
        place = np.minimum(at + j, last - 1)
        h = h * U64(0x100000001B3) + buf[place]
    return word, (mix64(h) & U64(BUCKETS - 1)).astype(np.int64)


def scripts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Script number of each padded word, by its first character beyond ASCII."""
    high = np.flatnonzero(buf >= 0xC0)
    first = np.searchsorted(high, off[:-1])
    has = (first < len(high)) & (np.append(high, len(buf))[np.minimum(first, len(high))] < off[1:])
    at = np.append(high, 0)[np.minimum(first, len(high))][has]
    b = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
    lead, c1, c2, c3 = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
    code = np.where(lead < 0xE0, (lead & 31) << 6 | c1,
                    np.where(lead < 0xF0, (lead & 15) << 12 | c1 << 6 | c2, (lead & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    out = np.full(len(off) - 1, NAMES.index("Latin"))
    out[has] = _NUMBER[np.searchsorted(_STARTS, code, side="right") - 1]
    return out


class Model:
    """Log frequencies of hashed n-grams and allowed scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, script_counts: np.ndarray):
        """counts: (n-gram lengths, BUCKETS, languages); script_counts: (scripts, languages)."""
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.log = np.log((counts + 0.1) / (total + 0.1 * BUCKETS)).astype(np.float32) / len(GRAMS)
        share = script_counts / np.maximum(1, script_counts.sum(axis=0, keepdims=True))
        self.allowed = share >= 0.005
        self.allowed[~self.allowed.any(axis=1)] = True

    def word_scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros((len(off) - 1, len(self.languages)), np.float32)
        for k, n in enumerate(GRAMS):
            word, bucket = grams(buf, off, n)
            first = np.searchsorted(word, np.arange(len(off) - 1))
            out += np.add.reduceat(self.log[k][bucket], first, axis=0)
        out[~self.allowed[scripts(buf, off)]] -= 1e4
        return out


def viterbi(score: np.ndarray, which: np.ndarray, rows: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: ``score[which]`` summed along a row, minus ``penalty`` per switch.

    All rows step together, longest first, so a step is one array operation over the rows still open.
    """
    n_words, n_lang = len(which), score.shape[1]
    size = np.diff(rows)
    order = np.argsort(-size, kind="stable")
    start, size = rows[:-1][order], size[order]
    label = np.zeros(n_words, np.int16)
    if n_words == 0 or n_lang == 1:
        return label
    open_at = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")   # rows longer than t
    switch, before = np.zeros((n_words, n_lang), bool), np.zeros(n_words, np.int16)
    v = np.zeros((len(size), n_lang), np.float64)
    for t, k in enumerate(open_at.tolist()):
        at = start[:k] + t
        cur = v[:k]
        if t:
            best = cur.max(axis=1, keepdims=True) - penalty
            low = cur < best
            switch[at] = low
            before[at] = cur.argmax(axis=1)
            cur = np.maximum(cur, best)
        v[:k] = cur + score[which[at]]
    state = v.argmax(axis=1).astype(np.int16)
    for t in range(len(open_at) - 1, -1, -1):
        k = int(open_at[t])
        at = start[:k] + t
        label[at] = state[:k]
        turn = switch[at, state[:k]]
        state[:k][turn] = before[at][turn]
    return label


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          per_language: int = 2_000) -> Model | None:
    """Count n-grams of a bounded sample; None without a labelled text."""
    ids = docs.select(id_col, lang_col).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).groupBy(id_col).agg(F.min(lang_col).alias(lang_col))
    order = [F.xxhash64(F.lit(41), F.col(id_col)), F.col(id_col)]
    ids = top_k_per_group(ids, [lang_col], order, per_language, salt_col=id_col).select(id_col)
    known = docs.where(F.col(lang_col).isNotNull()).join(F.broadcast(ids), id_col, "left_semi").select(lang_col, text_col)
    ddl = "lang string, kind int, bucket int, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part, _, _ in slices(batch, text_col):
                langs, number = np.unique(np.array([str(x) for x in part.column(0).to_pylist()], dtype=object).astype(str), return_inverse=True)
                buf, off, which, _, rows = distinct_words(part.column(1))
                if len(which) == 0:
                    continue
                of = number[row_of(rows)]
                pair, times = np.unique(of * (len(off) - 1) + which, return_counts=True)
                lang, word = pair // (len(off) - 1), pair % (len(off) - 1)
                for kind in range(len(GRAMS) + 1):
                    if kind < len(GRAMS):
                        w, b = grams(buf, off, GRAMS[kind])
                        first = np.searchsorted(w, np.arange(len(off)))
                        n = np.diff(first)[word]
                        at = np.arange(int(n.sum())) + np.repeat(first[word] - (np.cumsum(n) - n), n)
                        key, weight = np.repeat(lang, n) * BUCKETS + b[at], np.repeat(times, n)
                    else:
                        key, weight = lang * BUCKETS + scripts(buf, off)[word], times
                    total = np.bincount(key, weight, minlength=1)
                    key = np.flatnonzero(total)
                    yield record(schema, lang=langs[key // BUCKETS].tolist(), kind=np.full(len(key), kind),
                                 bucket=key % BUCKETS, n=total[key].astype(np.int64))

    got = known.mapInArrow(run, ddl).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in got})
    if not languages:
        return None
    counts, script_counts = np.zeros((len(GRAMS), BUCKETS, len(languages))), np.zeros((len(NAMES), len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    for r in got:
        if r.kind < len(GRAMS):
            counts[r.kind, r.bucket, place[r.lang]] = r.n
        else:
            script_counts[r.bucket, place[r.lang]] = r.n
    return Model(languages, counts, script_counts)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """Per document: id, lang_pred, score, spans (first word, end word, language)."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<first:long,end:long,lang:string>>"
    schema = arrow_schema(ddl)
    held = docs.sparkSession.sparkContext.broadcast(model)      # BUCKETS x languages

    def label(texts: pa.Array):
        model, n = held.value, len(texts)
        pred, share, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
        buf, off, which, length, rows = distinct_words(texts)
        if model is None or len(which) == 0:
            return pred, share, spans
        path = viterbi(model.word_scores(buf, off), which, rows, penalty)
        row, n_lang = row_of(rows), len(model.languages)
        mass = np.bincount(row * n_lang + path, length, minlength=n * n_lang).reshape(n, n_lang)
        best, total = mass.argmax(axis=1), mass.sum(axis=1)
        ascii_only = np.bincount(row, (buf[np.append(off[:-1] + 1, 0)[which]] < 128), minlength=n) > 0
        for r in np.flatnonzero((total > 0) & ~ascii_only):
            if not _ANY_LETTER.search(texts[int(r)].as_py()):
                total[r] = 0
        edge = np.ones(len(path), bool)
        edge[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(edge)
        end = np.append(first[1:], len(path))
        for a, b, r, s in zip(first.tolist(), end.tolist(), row[first].tolist(), path[first].tolist()):
            if total[r]:
                spans[r].append({"first": a - int(rows[r]), "end": b - int(rows[r]), "lang": model.languages[s]})
        for r in np.flatnonzero(total).tolist():
            pred[r], share[r] = model.languages[best[r]], mass[r, best[r]] / total[r]
        return pred, share, spans

    def run(batches):
        for batch in batches:
            for part, _, _ in slices(batch, text_col, SLICE):
                pred, share, spans = label(part.column(part.schema.get_field_index(text_col)))
                yield record(schema, **{id_col: part.column(part.schema.get_field_index(id_col)), "lang_pred": pred,
                                        "score": share, "spans": spans})

    return docs.select(id_col, text_col).mapInArrow(run, ddl)

"""Class-based n-gram language model: exchange clustering of words, class trigrams, word emissions.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, known by 64-bit hashes; a text's words are followed by one
end token.  A text's probability is the product over its tokens of P(class | two classes before) x P(word | class).

* **Chunks.** ``chunks`` cuts the texts into chunks of about ``CHUNK_BYTES`` and writes each as one row: its distinct
  words in order of hash, and its tokens as numbers of these.  All later passes read chunks, so a word is sent
  once a chunk and not once a token.
* **Counts.** The words go to buckets by the upper bits of the hash; a bucket merges its words over all chunks.
  Buckets and chunks grow in number, not in size.
* **Exchange clustering.** Every word is described by the classes of its left and right neighbours: the ``SEEDS`` most
  frequent words are classes of their own there, all others one, and the edge of a text one.  Classes start from the
  ``classes`` most frequent words; in each round every word moves to the class that gains the most likelihood of
  class and neighbour pairs, all words by the sums of the round before (synchronous exchange, as in distributed
  clustering).  A round is one pass over the buckets with sums of fixed size.
* **Model.** Class trigrams backed off to bigrams and unigrams (Witten-Bell); P(word | class) is the word's count
  less a discount over the class's count and one; what that leaves is the class's probability of an unknown word.
  So the probabilities of all known words, the unknown word and the end sum to one after any history.
  An unknown word goes on in the class that explains it best.
* **Scores.** A text is scored from its sequence of classes, which is written once, so the texts are shuffled once.

Only fixed-size tables (class pairs and triples, the most frequent words) reach the driver or all tasks.

Defined results: null and empty texts are one end token; a null id counts as the empty text in the
fold; repeated rows are texts each; without training texts every word is unknown; an empty table gives no rows; columns
beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, arrow_schema, record, slices, words, written

CHUNK_BYTES = 4 << 20
BUCKET_WORDS = 1 << 19          # words of all chunks that meet in one bucket
CLASSES, SEEDS, ROUNDS = 64, 126, 6
OTHER, EDGE, SIDE = SEEDS, SEEDS + 1, 128       # neighbour codes; right neighbours count from SIDE
UNKNOWN = 255
BLOCK = 8192


def packed(values: np.ndarray) -> bytes:
    """Byte planes of the numbers, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(dtype).reshape(-1)


# ---- chunks and counts

def chunks(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: ids, training marks, token offsets, distinct words with training counts, tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"chunk long, doc_id array<{kind}>, train binary, at binary, n_train long, n_words long, words binary, counts binary, ids binary"
    schema = arrow_schema(ddl)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, ids, marks, lengths, hashes = 0, 0, [], [], [], []

        def flush():
            length, mark = np.concatenate(lengths), np.concatenate(marks)
            distinct, token = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.bincount(token[np.repeat(mark, length)], minlength=len(distinct))
            names = pa.concat_arrays(ids)
            return record(schema, chunk=[(TaskContext.get().partitionId() << 32) + made],
                          doc_id=pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                          train=[mark.tobytes()], at=[packed(length.astype(np.int64))], n_train=[int(mark.sum())], n_words=[len(distinct)],
                          words=[distinct.tobytes()], counts=[packed(counts.astype(np.uint32))], ids=[packed(token.astype(np.int32))])
        for batch in batches:
            for part, buf, off in slices(batch):
                _, _, h, at = words(LOWER[buf], off, ~SPACE)
                ids.append(part.column(0))
                marks.append(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                lengths.append(np.diff(at))
                hashes.append(h)
                size += len(buf)
                if size >= chunk_bytes:
                    yield flush()
                    made, size, ids, marks, lengths, hashes = made + 1, 0, [], [], [], []
        if ids:
            yield flush()

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(chunked, ddl)


def _split(hashes: np.ndarray, bits: int) -> list[slice]:
    """The places of each bucket in sorted hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    at = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
    return [slice(a, b) for a, b in zip(at[:-1], at[1:])]


def vocabulary_counts(chunk: DataFrame, bits: int) -> DataFrame:
    """One row per bucket: words, training counts, where each chunk's words are, and sums."""
    ask_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
    ddl = ("bucket int, words binary, n binary, chunks binary, sizes binary, places binary, "
           "total long, distinct_words long, once long, twice long")
    schema = arrow_schema(ddl)

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                w, c = np.frombuffer(r["words"], np.uint64), unpacked(r["counts"], np.uint32)
                for b, s in enumerate(_split(w, bits)):
                    if s.stop > s.start:
                        yield record(ask_schema, bucket=[b], chunk=[r["chunk"]], words=[w[s].tobytes()], counts=[packed(c[s])])

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        parts = [np.frombuffer(r["words"], np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([unpacked(r["counts"], np.uint32) for r in rows])).astype(np.int64)
        return pa.Table.from_batches([record(
            schema, bucket=[rows[0]["bucket"]], words=[distinct.tobytes()], n=[packed(n)], chunks=[packed(np.array([r["chunk"] for r in rows]))],
            sizes=[packed(np.array([len(p) for p in parts]))], places=[packed(place.astype(np.int32))],
            total=[int(n.sum())], distinct_words=[int((n > 0).sum())], once=[int((n == 1).sum())], twice=[int((n == 2).sum())])])

    asked = chunk.select("chunk", "words", "counts").mapInArrow(ask, "bucket int, chunk long, words binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(merge, ddl)


def frequent(vocabulary: DataFrame, k: int) -> list:
    """The ``k`` most frequent training words: (word, bucket, place in it), ties to the smaller hash."""
    schema = pa.schema([("n", pa.int64()), ("word", pa.string()), ("bucket", pa.int32()), ("place", pa.int32())])

    def top(batches):
        for batch in batches:
            for r in batch.to_pylist():
                w, n = np.frombuffer(r["words"], np.uint64), unpacked(r["n"], np.int64)
                best = np.lexsort((w, -n))[:k]
                best = best[n[best] > 0]
                yield record(schema, n=n[best], word=[f"{x:020d}" for x in w[best].tolist()], bucket=[r["bucket"]] * len(best), place=best.astype(np.int32))
    rows = vocabulary.select("bucket", "words", "n").mapInArrow(top, "n long, word string, bucket int, place int")
    return rows.orderBy(F.desc("n"), "word").limit(k).collect()


# ---- neighbours of words

def contexts(chunk: DataFrame, vocabulary: DataFrame, seeds: list[int], bits: int) -> DataFrame:
    """One row per bucket: counts of its words' neighbour codes (row lengths, codes, counts), beside the words' places."""
    ask_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("size", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])
    order = np.argsort(np.array(seeds, np.uint64))
    sorted_seeds = np.array(seeds, np.uint64)[order]

    def around(batches):
        for batch in batches:
            for r in batch.to_pylist():
                w, token = np.frombuffer(r["words"], np.uint64), unpacked(r["ids"], np.int32)
                code = np.full(len(w), OTHER, np.int64)
                at = np.searchsorted(w, sorted_seeds)
                found = (at < len(w)) & (w[np.minimum(at, max(len(w) - 1, 0))] == sorted_seeds) if len(w) else np.zeros(len(at), bool)
                code[at[found]] = order[found]
                length, mark = unpacked(r["at"], np.int64), np.frombuffer(r["train"], bool)
                token, length = token[np.repeat(mark, length)].astype(np.int64), length[mark & (length > 0)]
                if len(token) == 0:
                    continue
                end = np.cumsum(length)
                left, right = np.roll(code[token], 1), np.roll(code[token], -1)
                left[end - length] = EDGE
                right[end - 1] = EDGE
                pair, n = np.unique(np.concatenate([token * 256 + left, token * 256 + SIDE + right]), return_counts=True)
                size = np.bincount(pair >> 8, minlength=len(w)).astype(np.uint16)
                first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                codes, n = (pair & 255).astype(np.uint8), n.astype(np.uint32)
                for b, s in enumerate(_split(w, bits)):
                    if first[s.stop] > first[s.start]:
                        c = slice(first[s.start], first[s.stop])
                        yield record(ask_schema, bucket=[b], chunk=[r["chunk"]], size=[packed(size[s])], codes=[packed(codes[c])], counts=[packed(n[c])])

    ddl = "bucket int, n binary, chunks binary, sizes binary, places binary, size binary, codes binary, counts binary"
    schema = arrow_schema(ddl)

    def merge(words_of: pa.Table, around_of: pa.Table) -> pa.Table:
        if words_of.num_rows == 0:
            return schema.empty_table()
        v = words_of.to_pylist()[0]
        n, ids, sizes, places = unpacked(v["n"], np.int64), unpacked(v["chunks"], np.int64), unpacked(v["sizes"], np.int64), unpacked(v["places"], np.int32)
        end = dict(zip(ids.tolist(), zip((np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist())))
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in around_of.to_pylist():
            a, b = end[r["chunk"]]
            keys.append(np.repeat(places[a:b].astype(np.int64), unpacked(r["size"], np.uint16)) * 256 + unpacked(r["codes"], np.uint8))
            values.append(unpacked(r["counts"], np.uint32).astype(np.int64))
        pair, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(values), minlength=len(pair)).astype(np.int64)
        return pa.Table.from_batches([record(
            schema, bucket=[v["bucket"]], n=[v["n"]], chunks=[v["chunks"]], sizes=[v["sizes"]], places=[v["places"]],
            size=[packed(np.bincount(pair >> 8, minlength=len(n)).astype(np.uint16))], codes=[packed((pair & 255).astype(np.uint8))], counts=[packed(total)])])

    sent = chunk.select("chunk", "words", "ids", "at", "train").mapInArrow(around, "bucket int, chunk long, size binary, codes binary, counts binary")
    held = vocabulary.select("bucket", "n", "chunks", "sizes", "places")
    return held.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(merge, ddl)


# ---- exchange clustering

def class_logs(pairs: np.ndarray) -> np.ndarray:
    """log P(neighbour code | class) of each side, from counts (classes x 256)."""
    out = np.zeros(pairs.shape, np.float32)
    for side in (slice(0, SIDE), slice(SIDE, 2 * SIDE)):
        n = pairs[:, side].astype(float)
        every = (n.sum(0) + 0.01) / (n.sum() + 0.01 * SIDE)
        out[:, side] = np.log((n + every) / (n.sum(1, keepdims=True) + 1))
    return out


def moved(size: np.ndarray, codes: np.ndarray, counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The class of each word that gains the most (the smallest of equal ones)."""
    out = np.zeros(len(size), np.uint8)
    first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    for a in range(0, len(size), BLOCK):
        b = min(a + BLOCK, len(size))
        s = slice(first[a], first[b])
        row = np.repeat(np.arange(b - a), size[a:b])
        table = np.bincount(row * 256 + codes[s], weights=counts[s], minlength=(b - a) * 256).reshape(b - a, 256)
        out[a:b] = np.argmax(table.astype(np.float32) @ logs.T, axis=1)
    return out


def _bucket(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(r["size"], np.uint16), unpacked(r["codes"], np.uint8), unpacked(r["counts"], np.int64)


def _cells(found: DataFrame, size: int) -> np.ndarray:
    """Sum of (cell, n) rows as an array; ``size`` is fixed by the number of classes."""
    out = np.zeros(size, np.int64)
    for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


_CELL = pa.schema([("cell", pa.int32()), ("n", pa.int64())])


def _cell_rows(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return record(_CELL, cell=at.astype(np.int32), n=total[at])


def exchange(table: DataFrame, seeds: list, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log table of the classes after ``rounds`` rounds, and each class's tokens and words."""
    k = max(1, min(classes, len(seeds)))
    starts: dict[int, list] = {}
    for c, r in enumerate(seeds[:k]):
        starts.setdefault(r.bucket, []).append((c, r.place))

    def seed_cells(batches):
        total = np.zeros(k * 256, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] in starts:
                    size, codes, counts = _bucket(r)
                    first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                    for c, place in starts[r["bucket"]]:
                        s = slice(first[place], first[place + 1])
                        total[c * 256 + codes[s].astype(np.int64)] += counts[s]
        yield _cell_rows(total)

    def pair_cells(logs):
        def cells(batches):
            total = np.zeros(k * 256 + 2 * k, np.int64)
            for batch in batches:
                for r in batch.to_pylist():
                    size, codes, counts = _bucket(r)
                    n = unpacked(r["n"], np.int64)
                    c = moved(size, codes, counts, logs).astype(np.int64)
                    total[:k * 256] += np.bincount(np.repeat(c, size) * 256 + codes, weights=counts, minlength=k * 256).astype(np.int64)
                    total[k * 256:-k] += np.bincount(c, weights=n, minlength=k).astype(np.int64)
                    total[-k:] += np.bincount(c[n > 0], minlength=k)
            yield _cell_rows(total)
        return cells

    pairs = _cells(table.select("bucket", "size", "codes", "counts").mapInArrow(seed_cells, "cell int, n long"), k * 256)
    logs = class_logs(pairs.reshape(k, 256))
    rows = table.select("n", "size", "codes", "counts")
    for step in range(rounds):
        total = _cells(rows.mapInArrow(pair_cells(logs), "cell int, n long"), k * 256 + 2 * k)
        if step + 1 < rounds:       # the last pass counts the classes that ``logs`` gives
            logs = class_logs(total[:k * 256].reshape(k, 256))
    return logs, total[k * 256:-k], total[-k:]


# ---- scores

def classified(chunk: DataFrame, table: DataFrame, logs: np.ndarray, sums: dict) -> DataFrame:
    """One row per text: counts of tokens, the scores that need no history, the class of each token."""
    k = len(logs)
    kind = chunk.schema["doc_id"].dataType.elementType.simpleString()
    answer_schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("classes", pa.binary()), ("n", pa.binary())])

    def answer(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, place = unpacked(r["n"], np.int64), unpacked(r["places"], np.int32)
                c = np.where(n > 0, moved(*_bucket(r), logs), UNKNOWN).astype(np.uint8)
                at = 0
                for name, size in zip(unpacked(r["chunks"], np.int64).tolist(), unpacked(r["sizes"], np.int64).tolist()):
                    p = place[at:at + size]
                    at += size
                    yield record(answer_schema, chunk=[name], bucket=[r["bucket"]], classes=[packed(c[p])], n=[packed(n[p])])

    ddl = f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, known_score double, classes binary"
    schema = arrow_schema(ddl)
    tokens, types, ends, discount, class_tokens = (sums[x] for x in ("tokens", "types", "ends", "discount", "class_tokens"))

    def known(chunk_of: pa.Table, answers: pa.Table) -> pa.Table:
        r = chunk_of.select(["train", "at", "ids"]).to_pylist()[0]
        got = sorted(answers.to_pylist(), key=lambda a: a["bucket"])
        c = np.concatenate([np.zeros(0, np.uint8), *[unpacked(a["classes"], np.uint8) for a in got]])
        n = np.concatenate([np.zeros(0, np.int64), *[unpacked(a["n"], np.int64) for a in got]])
        token, length = unpacked(r["ids"], np.int32), unpacked(r["at"], np.int64)
        docs = len(length)
        row = np.repeat(np.arange(docs), length)
        base = np.log10((n + 1) / (tokens + types + 1))
        emit = np.where(n > 0, np.log10(np.maximum(n - discount, 1e-300) / (class_tokens[np.where(n > 0, c, 0)] + 1)), 0.0)
        end_base = np.log10((ends + 1) / (tokens + types + 1))
        sequence = np.insert(c[token], np.cumsum(length), k).astype(np.uint8)
        at = np.concatenate([[0], np.cumsum(length + 1)]).astype(np.int32)
        return pa.Table.from_batches([record(
            schema, doc_id=chunk_of["doc_id"].combine_chunks().flatten(), train=np.frombuffer(r["train"], bool), n_tokens=length + 1,
            n_known=np.bincount(row, weights=n[token] > 0, minlength=docs).astype(np.int64) + (ends > 0),
            base_score=np.bincount(row, weights=base[token], minlength=docs) + end_base,
            known_score=np.bincount(row, weights=emit[token], minlength=docs),
            classes=pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(at), pa.py_buffer(sequence.tobytes())]))])

    answers = table.select("bucket", "n", "chunks", "sizes", "places", "size", "codes", "counts").mapInArrow(
        answer, "chunk long, bucket int, classes binary, n binary")
    texts = chunk.select("chunk", "doc_id", "train", "at", "ids")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(known, ddl)


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all rows and the rows' lengths."""
    column = batch.column(batch.schema.get_field_index("classes"))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int64), np.array([len(x) for x in column.to_pylist()], np.int64)


def _before(sequence: np.ndarray, first: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one before each token; ``begin`` before a text's first."""
    one = np.roll(sequence, 1)
    one[first] = begin
    two = np.roll(one, 1)
    two[first] = begin
    return two, one


def triples(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of (class, class, class) in the training texts; class ``k`` is the end and, before a text, the begin."""
    def cells(batches):
        total = np.zeros((k + 1) ** 3, np.int64)
        for batch in batches:
            c, length = _sequences(batch)
            two, one = _before(c, np.cumsum(length) - length, k)
            total += np.bincount((two * (k + 1) + one) * (k + 1) + c, minlength=(k + 1) ** 3)
        yield _cell_rows(total)
    return _cells(texts.where("train").select("classes").mapInArrow(cells, "cell int, n long"), (k + 1) ** 3).reshape(k + 1, k + 1, k + 1)


def transition(n3: np.ndarray) -> np.ndarray:
    """P(class | two classes before), Witten-Bell."""
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p = (n1 + 1) / (n1.sum() + len(n1))
    for n in (n2, n3):
        kinds = (n > 0).sum(-1, keepdims=True)
        total = n.sum(-1, keepdims=True) + kinds
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total, 1), p)
    return p


def history_scores(sequence: np.ndarray, length: np.ndarray, p: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """log10 probability of each text's classes; an unknown word goes on in the class that explains it best."""
    k = len(p) - 1
    c = sequence.copy()
    first = np.cumsum(length) - length
    of_unknown = p[:, :, :k] * unknown          # of class c and the unknown word in it
    best, chance = of_unknown.argmax(-1), of_unknown.sum(-1)
    logs = np.zeros(len(c))
    at = np.flatnonzero(c == UNKNOWN)
    if len(at):
        # those with an unknown word less than three places before come after it
        row = np.repeat(np.arange(len(length)), length)[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 2) | (np.diff(row) > 0)
        start_of = np.repeat(first, length)
        depth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        order = np.argsort(depth, kind="stable")
        for group in np.split(at[order], np.cumsum(np.bincount(depth))[:-1]):
            start = start_of[group]
            one_c = np.where(group - 1 >= start, c[group - 1], k)
            two_c = np.where(group - 2 >= start, c[group - 2], k)
            c[group] = best[two_c, one_c]
            logs[group] = np.log10(chance[two_c, one_c])
    two, one = _before(c, first, k)
    seen = sequence != UNKNOWN
    logs[seen] = np.log10(p[two[seen], one[seen], c[seen]])
    return np.bincount(np.repeat(np.arange(len(length)), length), weights=logs, minlength=len(length))


def class_scores(docs: DataFrame, train: Column, *, classes: int = CLASSES, rounds: int = ROUNDS,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score each text by a model of the texts that ``train`` marks.

    Columns: ``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams),
    ``score`` (log10 probability), ``perplexity``, ``classes`` (one byte a token; 255: unknown word; the last is the end).
    """
    chunk = written(chunks(docs, train, chunk_bytes), "lm-chunks")
    size, ends = (x or 0 for x in chunk.agg(F.sum("n_words"), F.sum("n_train")).first())
    bits = max(2, int(np.ceil(np.log2(max(size, 1) / BUCKET_WORDS))))
    vocabulary = written(vocabulary_counts(chunk, bits), "lm-words")
    tokens, types, once, twice = (x or 0 for x in vocabulary.agg(*[F.sum(c) for c in ("total", "distinct_words", "once", "twice")]).first())
    seeds = frequent(vocabulary, SEEDS)
    table = written(contexts(chunk, vocabulary, [int(r.word) for r in seeds], bits), "lm-neighbours")
    logs, class_tokens, class_words = exchange(table, seeds, classes, rounds)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    sums = {"tokens": tokens + ends, "types": types + (ends > 0), "ends": ends, "discount": discount, "class_tokens": class_tokens}
    texts = written(classified(chunk, table, logs, sums), "lm-classes")
    p = transition(triples(texts, len(logs)))
    unknown = (discount * class_words + 1) / (class_tokens + 1)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "known_score") + ", score double"
    schema = arrow_schema(ddl)

    def score(batches):
        for batch in batches:
            got = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            total = history_scores(*_sequences(batch), p, unknown) + got.pop("known_score").to_numpy()
            yield record(schema, **got, score=total)

    out = texts.mapInArrow(score, ddl).withColumn("train_tokens", F.lit(tokens + ends).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

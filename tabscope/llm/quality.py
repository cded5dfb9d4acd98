"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one on pieces of well and one on pieces of badly marked
texts.  A text is cut into pieces of ``PIECE`` bytes (all of it), each compressed with either
dictionary; with sizes g and b summed over the pieces, the measure is (b - g) / (b + g), so
text that the good dictionary explains better is above 0.  A logistic fit on labelled rows that
trained neither dictionary turns the measure into a probability; its rows are weighted to the class shares of
all training labels.

Fitting reads at most ``per_class`` labelled rows of each class (20,000 by default: hash order,
one half for the dictionaries, the other for the fit) and ``pieces`` pieces a class for a dictionary
(6,000 of 512 bytes), whatever the size of the tables; scoring reads every whole text.

Nulls and ties: a null text counts as empty and an empty text has measure 0; an id with several
labels takes the largest; without labels of both classes the score is the smoothed share of ones (0.5
without labels).  Equal rows are each scored.  Only id, text and the label column are read.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, record, slices
from .labelled import platt, sigmoid, training_labels

PIECE = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in dictionaries:
        held = zstandard.ZstdCompressionDict(d) if d else None
        if held:
            held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)
                   if held else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
    return out


def measure(buf: np.ndarray, off: np.ndarray, packers: list) -> np.ndarray:
    """(bad - good) / (bad + good) compressed bytes of each row; 0 for an empty row."""
    data, out = memoryview(np.ascontiguousarray(buf)), np.zeros(len(off) - 1)
    good, bad = packers
    for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        g = s = 0
        for i in range(a, b, PIECE):
            piece = data[i:min(i + PIECE, b)]
            g += len(good.compress(piece))
            s += len(bad.compress(piece))
        out[r] = (s - g) / (s + g) if s + g else 0.0
    return out


def train_dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces; of few pieces, their plain content."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


def fit(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, pieces: int) -> tuple[list[bytes], tuple]:
    """Dictionaries [good, bad] and the logistic fit, from a bounded sample of labelled ids."""
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(text_col, "y", "weight", "half")
    cut_ddl = "y int, piece binary"
    cut_schema = arrow_schema(cut_ddl)

    def cut(batches):
        for batch in batches:
            y = batch.column(1).to_pylist()
            for r, t in enumerate(batch.column(0).to_pylist()):
                data = (t or "").encode()
                parts = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
                yield record(cut_schema, y=[y[r]] * len(parts), piece=parts)

    of = rows.where("half = 0").select(text_col, "y").mapInArrow(cut, cut_ddl)
    dictionaries = []
    for label in (1, 0):
        got = of.where(F.col("y") == label).orderBy(F.xxhash64("piece"), "piece").limit(pieces).collect()
        dictionaries.append(train_dictionary([bytes(r.piece) for r in got]))
    meas_ddl = "y int, weight double, x double"
    meas_schema = arrow_schema(meas_ddl)

    def measured(batches):
        packers = compressors(dictionaries)
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                yield record(meas_schema, y=part.column(1), weight=part.column(2), x=measure(buf, off, packers))

    got = rows.where("half = 1").select(text_col, "y", "weight").mapInArrow(measured, meas_ddl).collect()
    got.sort()
    return dictionaries, platt(*(np.array([r[c] for r in got]) for c in ("x", "y", "weight")))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          folds: int | None = None, held_out: int = 0, per_class: int = 20_000, pieces: int = 6_000) -> DataFrame:
    """Per document: id, score (0 to 1, higher: label 1 likelier) and measure."""
    sample = training_labels(labels, label, per_class, id_col, folds, held_out)
    dictionaries, (slope, offset, centre) = fit(docs, sample, id_col, text_col, pieces)
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, measure double"
    schema = arrow_schema(ddl)

    def run(batches):
        packers = compressors(dictionaries)
        for batch in batches:
            for part, buf, off in slices(batch, text_col):
                x = measure(buf, off, packers)
                yield record(schema, **{id_col: part.column(part.schema.get_field_index(id_col)),
                                        "score": sigmoid(slope * (x - centre) + offset), "measure": x})

    return docs.select(id_col, text_col).mapInArrow(run, ddl)

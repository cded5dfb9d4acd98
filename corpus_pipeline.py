"""Corpus preparation: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes a stage's rows as Parquet in the shared folder and reads them again for the next one.

Rows with null ids pass through by their text alone; repeated rows of one id become one row in the
near-duplicate stage; a document whose whole text is a repeat goes in the passage stage; an empty table
stays empty.  Extra columns, whatever their names, are carried along up to the last stage: a stage works on ``doc_id``,
``text`` and private names for the others (``_private``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.frames import quoted
from tabscope.llm.common import read_table, written
from tabscope.llm.decontaminate import contamination
from tabscope.llm.encode import vocabulary
from tabscope.llm.neardup import near_duplicates
from tabscope.llm.packing import pack
from tabscope.llm.suffixes import remove_repeats
from tabscope.llm.toxicity import score

TOXIC = 0.7
PASSAGE_BYTES = 200      # about 35 words of prose; a passage of over 50 words is shorter only if its words are very short


def _private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that no operator uses, and the names given for those: {given: private}."""
    names = {c: c if c in ("doc_id", "text") else f"_given_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), names


def _restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, does not reject."""
    docs, names = _private(docs)
    out = score(docs, read_table(spark, sf_dir, "labels"), "toxic", keep=tuple(docs.columns))
    return _restored(out.where(F.col("toxicity_score") < TOXIC), names)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group (5-word shingles, similarity 0.8)."""
    docs, names = _private(docs)
    groups = written(near_duplicates(docs, shingle=5, percent=80).select("doc_id", "kept"), "pipeline-groups")
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    again = groups.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return _restored(kept, names)
    rest = [c for c in docs.columns if c != "doc_id"]
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return _restored(kept.join(again, "doc_id", "left_anti").unionByName(once.select(*docs.columns)), names)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a document with a smaller id holds; wholly repeated documents go."""
    docs, names = _private(docs)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(docs, PASSAGE_BYTES, PASSAGE_BYTES - 50, keep=("text", *rest), as_text=True)
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.trim("kept") != "")).withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if count := names.get("n_chars"):
        out = out.withColumn(count, F.when(changed, F.char_length("text").cast(docs.schema[count].dataType)).otherwise(F.col(count)))
    return _restored(out, names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item."""
    docs, names = _private(docs)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    clean = contamination(docs, bench, keep=rest).where(F.col("n_hit") == 0)
    return _restored(clean, names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 2048."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("suffix_array_dedup", passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

# the classifier and the tokenizer cannot be said in SQL; tests/llm/test_pipeline.py holds the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs

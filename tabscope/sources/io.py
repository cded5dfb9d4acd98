"""File sources and sinks (SRC-1..8, SNK-1..2).

Readers are Spark's own (CSV, JSON, Parquet, text); pandas-style missing
tokens and type inference are a projection plus one aggregate, so a file is
scanned in parallel and never loaded whole on one machine.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import col, quoted
from .tables import nan_to_null

# The spellings pandas' CSV reader treats as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# what pandas reads as a number; Spark's casts also take suffixes such as 10D
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"


def extension(path: str) -> str:
    """Lower-cased extension of the path with any query string cut off."""
    base = path.split("?")[0].lower()
    return os.path.splitext(base)[1]


def _na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(col(c).isin(NA_TOKENS), F.lit(None)).otherwise(col(c)).alias(c)
                       for c in df.columns])


def _long(c: str):
    return F.when(col(c).rlike(WHOLE), F.expr(f"try_cast({quoted(c)} AS BIGINT)"))


def _double(c: str):
    return F.when(col(c).rlike(NUMBER), F.expr(f"try_cast({quoted(c)} AS DOUBLE)"))


def infer_types(df: DataFrame) -> DataFrame:
    """Type string columns as integer, float or boolean when every value parses (one pass).

    A value must look like a number before it is cast, so codes such as ``10D`` stay strings; dates stay
    strings too, as in a default pandas read.
    """
    cols = df.columns
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v = col(c)
        nn = v.isNotNull()
        aggs += [F.sum((nn & _long(c).isNull()).cast("long")).alias(f"l{i}"),
                 F.sum((nn & _double(c).isNull()).cast("long")).alias(f"d{i}"),
                 F.sum((nn & ~v.isin("True", "False")).cast("long")).alias(f"b{i}"),
                 F.sum(nn.cast("long")).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        if not r[f"n{i}"]:
            out.append(F.lit(None).cast("double").alias(c))  # an all-missing column reads as float
        elif r[f"l{i}"] == 0:
            out.append(_long(c).alias(c))
        elif r[f"d{i}"] == 0:
            out.append(_double(c).alias(c))
        elif r[f"b{i}"] == 0:
            out.append((col(c) == "True").alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def clean(df: DataFrame) -> DataFrame:
    """SRC-6: drop all-null rows, then all-null columns; strip header names."""
    if not df.columns:
        return df
    d = df.where(F.coalesce(*[F.when(col(c).isNotNull(), True) for c in df.columns], F.lit(False)))
    counts = d.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(d.columns)]).first()
    keep = [c for i, c in enumerate(d.columns) if counts[f"c{i}"]]
    return d.select(*[col(c).alias(str(c).strip()) for c in keep])


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
             multiline: bool = False) -> DataFrame:
    """SRC-1 / SRC-2: header row, every value read as text, NA tokens to null, then typed.

    ``multiline`` (quoted fields spanning lines) makes each file one task, so
    it is off unless asked for; line-oriented files split across tasks.
    """
    raw = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
                .option("inferSchema", False).option("nullValue", None).option("emptyValue", "")
                .option("multiLine", multiline).option("escape", '"').csv(path))
    return infer_types(_na_to_null(raw))


def load_table(spark: SparkSession, path: str, encoding: str = "UTF-8", strict: bool = True) -> DataFrame | None:
    """SRC-4: dispatch on the extension.  ``strict`` mirrors the upload loader
    (unknown formats raise); otherwise unknown files are tried as CSV.
    ``.tsv`` is read with a tab (the reference reads it with a comma)."""
    ext = extension(path)
    if ext == ".pdf":
        return None
    if ext in (".csv", ".txt"):
        df = read_csv(spark, path, ",", encoding)
    elif ext == ".tsv":
        df = read_csv(spark, path, "\t", encoding)
    elif ext == ".json":
        # JSON lines first (parallel); a file holding one array of records falls back to multi-line
        df = spark.read.json(path)
        if df.columns == ["_corrupt_record"]:
            df = spark.read.option("multiLine", True).json(path)
        df = nan_to_null(df)
    elif ext == ".parquet":
        df = nan_to_null(spark.read.parquet(path))
    elif strict:
        raise ValueError(f"Unsupported file format: {os.path.basename(path)}")
    else:
        df = read_csv(spark, path, ",", encoding)
    return clean(df)


@dataclass
class Loaded:
    tables: dict[str, DataFrame]
    status: DataFrame


def load_many(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> Loaded:
    """SRC-5: every file; one status row per file, failures reported and skipped."""
    tables, rows = {}, []
    for p in paths:
        name = os.path.basename(p.split("?")[0])
        try:
            df = load_table(spark, p, encoding)
            if df is None:
                rows.append((name, False, None, None, "no table in a PDF"))
                continue
            tables[name] = df
            rows.append((name, True, df.count(), len(df.columns), None))
        except Exception as e:  # reported per file, as the reference does
            rows.append((name, False, None, None, str(e)[:300]))
    status = spark.createDataFrame(rows, "file string, loaded boolean, rows bigint, cols int, error string")
    return Loaded(tables, status)


def utf8_report(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: per file, lines and lines that are not valid UTF-8 (line-parallel)."""
    t = spark.read.text(path).withColumn("file", F.input_file_name())
    return t.groupBy("file").agg(F.count(F.lit(1)).alias("lines"),
                                 F.sum((~F.is_valid_utf8("value")).cast("long")).alias("invalid_lines"))


def preview(df: DataFrame, n: int = 100, order: list[str] | None = None) -> DataFrame:
    """SRC-8: first ``n`` rows (by ``order`` when given, for a repeatable view)."""
    return (df.orderBy(*order) if order else df).limit(n)


# ---------------------------------------------------------------- SNK-1, 2
def export_type(dt: T.DataType) -> T.DataType:
    """Type map: integers -> BIGINT, floats -> DOUBLE, booleans, datetimes -> TIMESTAMP, rest -> STRING."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(dt, T.BooleanType):
        return T.BooleanType()
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return T.TimestampType()
    return T.StringType()


def typed_export(df: DataFrame, path: str) -> DataFrame:
    """SNK-1: cast by the type map and write Parquet (replace mode); returns the typed frame."""
    typed = df.select(*[col(f.name).cast(export_type(f.dataType)).alias(f.name)
                        for f in df.schema.fields])
    typed.write.mode("overwrite").parquet(path)
    return typed


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """SNK-2: one folder per report table."""
    out = []
    for name, df in tables.items():
        p = os.path.join(folder, name)
        df.write.mode("overwrite").format(fmt).save(p)
        out.append(p)
    return out

"""Column roles: numeric / categorical / datetime / text (+ target, predictors).

The role of a string column is decided by ``distinct / rows < 0.5`` (nulls
are not distinct values but do count as rows).  Distinct counts come from one
tall ``groupBy(variable, value)`` so many string columns never trigger
Catalyst's Expand rewrite of multiple ``countDistinct``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import attach_scalars, col, value_hash

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType, T.BooleanType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType)

ROLE_SCHEMA = "position int, column_name string, dtype string, role string"


def base_role(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, DATETIME):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, NESTED):
        return "other"
    return "categorical"


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, n_distinct)`` without nulls; values are shuffled as 128-bit hashes, once per map task."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct bigint")
    def hashed(c):
        one, two = value_hash([(col(c), df.schema[c].dataType)])
        return F.when(col(c).isNotNull(), F.struct(one.alias("a"), two.alias("b"))).alias(c)
    t = df.select(*[hashed(c) for c in cols]).unpivot([], [col(c) for c in cols], "column_name", "value").where(F.col("value").isNotNull())
    return t.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def infer_roles(df: DataFrame) -> DataFrame:
    """``(position, column_name, dtype, role)`` — one row per column."""
    spark = df.sparkSession
    meta = [(i, f.name, f.dataType.simpleString(), base_role(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    m = spark.createDataFrame(meta, "position int, column_name string, dtype string, base string")
    strings = [name for _, name, _, b in meta if b == "string"]
    if not strings:
        return m.select("position", "column_name", "dtype", F.col("base").alias("role"))
    n = df.agg(F.count(F.lit(1)).alias("_rows"))
    dc = distinct_counts(df, strings)
    joined = attach_scalars(m.join(F.broadcast(dc), "column_name", "left"), n)
    ratio = F.coalesce(F.col("n_distinct"), F.lit(0)) / F.greatest(F.col("_rows"), F.lit(1))
    role = F.when(F.col("base") != "string", F.col("base")) \
            .when(ratio < 0.5, "categorical").otherwise("text")
    return joined.select("position", "column_name", "dtype", role.alias("role"))


@dataclass
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    target: str | None = None

    @property
    def predictors(self) -> list[str]:
        return [c for c in self.numeric if c != self.target]

    @property
    def numeric_nonbool(self) -> list[str]:
        """``select_dtypes(number)`` view: booleans excluded."""
        return [c for c in self.numeric if c not in self.boolean]


def detect_roles(df: DataFrame, target: str | None = None) -> Roles:
    """Collects the role table (one row per column) into a driver-side record."""
    rows = infer_roles(df).orderBy("position").collect()
    r = Roles(target=target)
    bools = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    for row in rows:
        getattr(r, row["role"]).append(row["column_name"])
    r.boolean = [c for c in r.numeric if c in bools]
    return r


def column_roles(df: DataFrame, target: str | None = None) -> DataFrame:
    """SCH-2: roles plus target / predictor flags as a table."""
    t = F.lit(target)
    return (infer_roles(df)
            .withColumn("is_target", F.coalesce(F.col("column_name") == t, F.lit(False)))
            .withColumn("is_predictor", (F.col("role") == "numeric") & ~F.col("is_target")))


def column_overview(df: DataFrame) -> DataFrame:
    """SCH-3: ``(position, column_name, role, missing)``."""
    from .profile import missing_values
    miss = missing_values(df).select("column_name", F.col("missing_count").alias("missing"))
    return infer_roles(df).join(miss, "column_name").select("position", "column_name", "role", "missing")

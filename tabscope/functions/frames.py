"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """The name as one identifier, whatever characters it holds (a dot is no field access)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    ``one_row`` must hold one row (a global aggregate does): the join against it, which the
    optimiser plans as a broadcast nested loop, then adds columns and no rows.
    """
    return (df.withColumn("_one", F.lit(1))
              .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one")
              .drop("_one"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list,
                    k: int, salt_col: str | None = None, salt_buckets: int = 64,
                    rank_name: str = "rank") -> DataFrame:
    """Exact top-k rows per group in two bounded windows.

    First the top k inside (group, hash-salt) slices, then the top k of the
    at most ``k * salt_buckets`` survivors per group; a group with millions of
    distinct rows never lands whole in one task.  ``salt_col`` names a column
    to hash (defaults to every non-group column).
    """
    salt_src = [F.col(salt_col)] if salt_col else \
        [F.col(c) for c in df.columns if c not in group_cols]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (stage1.withColumn(rank_name, F.row_number().over(w2))
                  .where(F.col(rank_name) <= k).drop("_salt", "_r1"))


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows with a value (no null, no NaN) in each of the double ``cols``.

    A condition per column: ``na.drop`` makes one condition of all of them, and where columns get new names the optimiser
    keeps it under every mix of old and new names, 2 to the number of columns, on the driver.
    """
    for c in cols:
        df = df.where(col(c).isNotNull() & ~F.isnan(col(c)))
    return df


def first_by_hash(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """The ``k`` distinct rows of ``cols`` with the smallest hashes, in that order.

    Only 8-byte hashes are shuffled and ranked, those of a 64th of the table if it is large; the rows follow from the ``k``-th smallest one, so
    wide rows neither cross the shuffle nor meet on the driver by the partition.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def plain(c):      # -0.0 as 0.0, as a grouping has it
        if isinstance(kinds[c], (T.FloatType, T.DoubleType)):
            return (col(c) + F.lit(0.0).cast(kinds[c])).alias(c)
        if isinstance(kinds[c], T.ArrayType) and isinstance(kinds[c].elementType, (T.FloatType, T.DoubleType)):
            return F.transform(col(c), lambda v: v + F.lit(0.0).cast(kinds[c].elementType)).alias(c)
        return col(c)
    rows = df.select(*[plain(c) for c in cols])
    h = F.xxhash64(*[col(c) for c in cols])

    def kth(hashes):
        return hashes.distinct().orderBy("_h").limit(k).agg(F.max("_h"), F.count(F.lit(1))).first()
    hashes = rows.select(h.alias("_h"))
    low, n = kth(hashes.where(F.col("_h") < F.lit(-(1 << 63) + (1 << 58))))     # the lowest 64th of all hashes holds them in a large table
    if n < k:
        low, n = kth(hashes)
    if low is None:
        return rows.limit(0)
    return rows.where(h <= F.lit(low)).distinct().orderBy(h, *[col(c) for c in cols]).limit(k)


def spread(df: DataFrame, n: int, rows: int = 25_000) -> DataFrame:
    """``df`` of ``n`` rows in parts of about ``rows``; fewer rows stay as they are.

    A small compressed file is read by one task, and so is every pass of an iterative fit over it.
    """
    return df.repartition(-(-n // rows)) if n > rows else df


def value_hash(values: list) -> tuple:
    """Two 64-bit hashes of typed values [(column, type)], together equal for equal values only (128 bits).

    Numbers, dates and timestamps are hashed as they are (microseconds included), -0.0 as 0.0; nulls count
    by their place; arrays and structs by their JSON text with full timestamps.
    """
    plain, nulls = [], []
    for c, kind in values:
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            plain.append(c + F.lit(0.0).cast(kind))
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            plain.append(F.to_json(F.struct(c.alias("v")), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
                                                            "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}))
        else:
            plain.append(c)
        nulls.append(c.isNull().cast("long"))
    for i in range(0, len(nulls), 60):      # a bit for each null
        plain.append(sum((F.shiftleft(b, j) for j, b in enumerate(nulls[i:i + 60])), F.lit(0).cast("long")))
    return F.xxhash64(*plain), F.xxhash64(F.lit("second"), *plain)


def r4(c, digits: int = 4):
    """Round half-up to ``digits`` and turn -0.0 into 0.0 (oracle convention)."""
    return F.round(c, digits) + F.lit(0.0)


def dense_codes(df: DataFrame, col: str, small: int = 50_000) -> DataFrame:
    """``(col, _code)``: 0-based position of each distinct non-null value in sorted order.

    Up to ``small`` distinct values sort in one task; beyond that the values
    are range-partitioned (checkpointed so partition bounds stay fixed under
    retries) and numbered with per-partition offsets.
    """
    from ..session import cut_lineage
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    n = d.count()
    if n <= small:
        return d.withColumn("_code", F.row_number().over(Window.orderBy(col)) - 1)
    parts = max(2, n // small)
    d = cut_lineage(d.repartitionByRange(parts, col).withColumn("_pid", F.spark_partition_id()))
    sizes = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    off = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_pid").orderBy(col)
    return (d.withColumn("_i", F.row_number().over(w) - 1)
             .join(F.broadcast(off.select("_pid", "_off")), "_pid")
             .select(col, (F.col("_off") + F.col("_i")).alias("_code")))

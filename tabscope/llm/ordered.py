"""Positions of rows in groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def numbered(df: DataFrame, group: str, order: list, label: str) -> DataFrame:
    """``df`` with ``_pos`` (from 0, by ``order`` inside the ``group`` column) and ``_n`` (rows of the group).

    Rows are range-partitioned by group and order and written; a position is the row's place in its
    partition plus the group's rows in earlier partitions.  A group may span all partitions.  Rows
    equal in ``order`` may stand in either order, and even a group of equal rows is split.  ``group`` must not be null.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order, F.col("_tie")]
    rows = (df.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
              .withColumn("_at", F.monotonically_increasing_id()))
    rows = written(rows, label).withColumn("_part", F.shiftrightunsigned("_at", 33))
    # one row for each group and partition
    pieces = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_rows").over(Window.partitionBy(group)).alias("_n"))
    return rows.join(pieces, [group, "_part"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")

"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return r[0], r[1]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (columns u, v): the smallest node reachable.

    Each step sends a node's neighbours to its smallest neighbour; the edges become stars in about
    log(n) rounds and are written to the shared folder after each, so lineage stays short.  No node's
    neighbours are gathered: the smallest is an aggregate that combines map-side.
    """
    edges = written(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour is sent to the smallest of the neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        # small star: every smaller neighbour, and the node itself, is sent to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    low = edges.groupBy("u").agg(F.min("v").alias("component"))
    return written(low.withColumnRenamed("u", "node").union(low.select(F.col("component").alias("node"), "component").distinct()), "components")

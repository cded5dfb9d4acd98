"""Registered queries: a Spark builder and (when SQL can say it) a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and reads the whole driver tables (or
rule-made variants of them, written identically in SQL); no rows are
subset, capped or sampled to make the check cheap.  The README names the
model queries that lower boosting rounds or the clusters tried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(fn, sql, tuple(ops.split()))
        return fn
    return deco


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from . import profile_queries  # noqa: F401
    for mod in ("chart_queries", "stats_queries", "prep_queries", "model_queries",
                "page_queries", "report_queries"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if mod not in str(e):
                raise
    return REGISTRY

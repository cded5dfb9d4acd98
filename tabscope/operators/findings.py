"""Findings and analysis plan (FND-1..3).

Findings are one tall ``(section, metric, value)`` table, built by a union of
one-row aggregates from the other operators; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import missing_values, profile_summary
from .roles import distinct_counts, infer_roles

FINDING_SCHEMA = "section string, metric string, value string"


def _rows(df: DataFrame, section: str, cols: list[str]) -> DataFrame:
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
                             for c in cols]))
    return df.select(F.lit(section).alias("section"), st.alias("s")).select("section", "s.metric", "s.value")


def data_findings(df: DataFrame) -> DataFrame:
    """FND-1 (data part): size, role counts, missing cells, duplicates."""
    ps = profile_summary(df)
    roles = infer_roles(df).groupBy().pivot("role", ["numeric", "categorical", "datetime", "text"]).count()
    roles = roles.select(*[F.coalesce(F.col(c), F.lit(0)).alias(f"{c}_columns")
                           for c in ["numeric", "categorical", "datetime", "text"]])
    cols_with_missing = missing_values(df).agg(F.sum((F.col("missing_count") > 0).cast("long"))
                                               .alias("columns_with_missing"))
    return (_rows(ps, "data", ["n_rows", "n_cols", "total_missing", "duplicate_rows"])
            .unionByName(_rows(roles, "roles", roles.columns))
            .unionByName(_rows(cols_with_missing, "data", ["columns_with_missing"])))


def model_findings(regression_stats: DataFrame | None = None, classifier_best: DataFrame | None = None,
                   battery_summary: DataFrame | None = None, cluster_summary: DataFrame | None = None,
                   cluster_scores: DataFrame | None = None) -> list[DataFrame]:
    """FND-1 (analysis part): R², best model and its own F1, tests, k and silhouette."""
    out = []
    if regression_stats is not None:
        out.append(_rows(regression_stats, "regression", ["r2", "adj_r2"]))
    if classifier_best is not None:
        out.append(_rows(classifier_best, "classification", ["model", "f1_score"]))
    if battery_summary is not None:
        out.append(_rows(battery_summary, "hypothesis", ["total_tests", "significant_count"]))
    if cluster_summary is not None:
        out.append(_rows(cluster_summary, "clustering", ["best_k"]))
        if cluster_scores is not None:
            best = cluster_summary.select(F.col("best_k").alias("k")).join(cluster_scores, "k")
            out.append(_rows(best, "clustering", ["silhouette"]))
    return out


def findings(df: DataFrame, *parts: DataFrame) -> DataFrame:
    out = data_findings(df)
    for p in parts:
        out = out.unionByName(p)
    return out


def analysis_plan(df: DataFrame, target: str | None) -> DataFrame:
    """FND-3: which analyses run, and why (one small job for the target's distinct count)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
           or isinstance(f.dataType, T.BooleanType)]
    rows = [("profile", True, "always"), ("descriptive", True, "always"),
            ("correlation", len(num) >= 2, f"{len(num)} numeric columns"),
            ("clustering", len(num) >= 2, f"{len(num)} numeric columns")]
    if target is None:
        rows += [("regression", False, "no target"), ("classification", False, "no target"),
                 ("feature_importance", False, "no target")]
    else:
        is_num = target in num
        nd = distinct_counts(df, [target]).first()
        nd = int(nd["n_distinct"]) if nd else 0
        rows += [("regression", is_num, "numeric target" if is_num else "target not numeric"),
                 ("classification", 2 <= nd <= 20, f"{nd} distinct target values"),
                 ("feature_importance", is_num, "numeric target" if is_num else "target not numeric")]
    return df.sparkSession.createDataFrame(rows, "analysis string, runs boolean, reason string")

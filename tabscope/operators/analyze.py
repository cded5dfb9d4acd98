"""The whole run for a table and a target: every analysis that the plan allows, and the findings filled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.frames import col
from . import findings as FD
from .classify import compare_classifiers
from .cluster import cluster_analysis
from .correlation import pearson_matrix, top_pairs
from .hypothesis import hypothesis_tests
from .profile import describe, frequency_table, missing_table, profile_summary
from .regress import compare_regressors, ols
from .roles import column_overview, detect_roles


def analyze(df: DataFrame, target: str | None = None, key: str | None = None, trees: int = 100, boost_iter: int = 100,
            max_k: int = 10, restarts: int = 10) -> dict[str, DataFrame]:
    """Result tables by name: ``plan``, ``profile``, ``overview``, ``missing``, ``describe``, ``frequency``, ``pearson``, ``top_pairs``,
    the tests, ``ols``, ``regressors``, the classifier tables, the cluster tables, and ``findings``.

    What the plan rules out is absent.  ``key`` names the row id; it is no feature, and without one no model is
    compared (splits and folds are drawn by it).
    """
    plan = FD.analysis_plan(df, target)
    runs = {r["analysis"]: r["runs"] for r in plan.collect()}
    body = df.select(*[col(c) for c in df.columns if c != key]) if key else df
    roles = detect_roles(body, target)
    numeric, categorical = roles.numeric_nonbool, roles.categorical
    out = {"plan": plan, "profile": profile_summary(df), "overview": column_overview(df), "missing": missing_table(df),
           "describe": describe(body, numeric), "frequency": frequency_table(body, categorical)}
    found: dict = {}
    if len(numeric) >= 2:
        out["pearson"] = pearson_matrix(body, numeric)
        out["top_pairs"] = top_pairs(out["pearson"])
    if categorical:
        tests = hypothesis_tests(body, numeric, categorical)
        out.update({"test_summary" if name == "summary" else name: t for name, t in tests.items()})
        found["battery_summary"] = tests["summary"]
    if runs["regression"] and roles.predictors:
        out["ols"], stats = ols(body, target, roles.predictors)
        out["ols_stats"] = found["regression_stats"] = stats
        if key:
            out["regressors"], out["regressor_importance"] = compare_regressors(df, target, roles.predictors, [key], trees=trees, boost_iter=boost_iter)
    if runs["classification"] and key:
        got = compare_classifiers(df, target, [c for c in numeric if c != target], [c for c in categorical if c != target], [key],
                                  trees=trees, boost_iter=boost_iter)
        if got:
            out.update({f"classifier_{name}": t for name, t in got.items()})
            found["classifier_best"] = got["best"]
    features = [c for c in numeric if c != target]
    clusters = cluster_analysis(body, features, max_k, restarts) if len(features) >= 2 else None
    if clusters:
        out.update({f"cluster_{name}": t for name, t in clusters.items()})
        found.update(cluster_summary=clusters["summary"], cluster_scores=clusters["scores"])
    out["findings"] = FD.findings(df, *FD.model_findings(**found))
    return out

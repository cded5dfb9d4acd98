"""Driver contract and a fast slice of the Spark-vs-DuckDB oracle checks (sf0.01).

``tools/check.py`` runs every registered query against its oracle; this file
keeps the quick ones in the test suite.
"""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE

FAST = ["roles_lineitem", "profile_summary_lineitem", "missing_orders_nulls", "describe_orders",
        "frequency_orders_nulls", "mode_part", "histogram_lineitem", "bars_part", "pearson_lineitem",
        "spearman_part", "ttest_lineitem", "anova_events", "chi_square_orders_nulls",
        "scale_standard_lineitem_nulls", "one_hot_orders", "split_stratified_orders",
        "kfold_stratified_orders", "metrics_macro_orders", "auc_documents", "ols_coef_part",
        "ridge_part", "knn_classifier_part", "mutual_info_orders", "page_titles",
        "raw_data_urls_pages_marked", "findings_lineitem"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_other_queries_without_the_training_data_package(monkeypatch):
    import sys
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)       # as if it were deleted
    names = set(E.queries())
    assert len(names) >= 120 and not any(n == "pipeline" or n.startswith("op1") for n in names)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "variable" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_ORACLE)
    sc, srows = _canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    oc, orows = _canon([d[0] for d in cur.description], cur.fetchall())
    assert sc == oc
    assert srows == orows

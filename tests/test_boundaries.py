"""Boundary fixtures (literal frames, values by hand) for the reference's guards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_outliers_need_four_values(spark):
    from tabscope.operators.profile import outlier_counts
    three = spark.createDataFrame([(1.0,), (2.0,), (100.0,)], "x double")
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,)], "x double")
    assert rows(outlier_counts(three, ["x"])) == []
    assert rows(outlier_counts(four, ["x"])) == [{"column_name": "x", "outliers": 1}]


def test_describe_all_null_and_single(spark):
    from tabscope.operators.profile import describe
    df = spark.createDataFrame([(None, 5.0), (None, None)], "a double, b double")
    out = {r["variable"]: r for r in describe(df, ["a", "b"]).collect()}
    assert "a" not in out
    assert out["b"]["count"] == 1 and out["b"]["std"] is None and out["b"]["median"] == 5.0


def test_role_switch_at_half(spark):
    from tabscope.operators.roles import infer_roles
    half = spark.createDataFrame([("a",), ("b",), ("a",), ("b",)], "c string")       # 2/4 -> text
    below = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "c string")  # 2/5 -> categorical
    assert infer_roles(half).first()["role"] == "text"
    assert infer_roles(below).first()["role"] == "categorical"


def test_frequency_top20_with_null(spark):
    from tabscope.operators.profile import frequency_table
    vals = [f"c{i:02d}" for i in range(25) for _ in range(i + 1)] + [None] * 3
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    out = frequency_table(df, ["c"]).orderBy("rank").collect()
    assert len(out) == 20
    assert out[0]["category"] == "c24" and out[0]["count"] == 25
    assert out[0]["percent"] == round(25 / len(vals) * 100, 2)


def test_correlation_needs_two_columns(spark):
    from tabscope.operators.correlation import pearson_matrix
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert pearson_matrix(df, ["x"]).count() == 0


def test_ols_needs_p_plus_10(spark):
    from tabscope.operators.regress import ols
    mk = lambda n: spark.createDataFrame([(float(i), float(2 * i + (i % 3))) for i in range(n)], "x double, y double")
    assert ols(mk(10), "y", ["x"])[0].count() == 0
    coefs = {r["term"]: r for r in ols(mk(11), "y", ["x"])[0].collect()}
    x = np.arange(11.0)
    y = 2 * x + (np.arange(11) % 3)
    b, a = np.polyfit(x, y, 1)
    assert math.isclose(coefs["x"]["coef"], b, rel_tol=1e-9)
    assert math.isclose(coefs["const"]["coef"], a, rel_tol=1e-9)


def test_compare_regressors_needs_20(spark):
    from tabscope.operators.regress import compare_regressors
    df = spark.createDataFrame([(i, float(i), float(3 * i)) for i in range(19)], "k long, x double, y double")
    cmp, _ = compare_regressors(df, "y", ["x"], ["k"], models=["Linear Regression"])
    assert cmp.count() == 0


@pytest.mark.parametrize("n,task", [(2, "binary_classification"), (3, "multiclass_classification"),
                                    (20, "multiclass_classification"), (21, "regression")])
def test_task_detection_numbers(spark, n, task):
    from tabscope.operators.automl import detect_task
    df = spark.createDataFrame([(float(i % n),) for i in range(3 * n)], "y double")
    assert detect_task(df, "y") == task


def test_task_detection_strings(spark):
    from tabscope.operators.automl import detect_task
    df = spark.createDataFrame([(f"s{i}",) for i in range(21)], "y string")
    assert detect_task(df, "y") == "multiclass_classification"


def test_ttest_drops_small_group_and_zero_variance(spark):
    from tabscope.operators.hypothesis import ttests
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", 2.0)], "g string, x double")
    assert ttests(small, ["x"], ["g"], p_values=False).count() == 0
    flat = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)] * 3, "g string, x double")
    assert ttests(flat, ["x"], ["g"], p_values=False).first()["cohens_d"] == 0.0


def test_ttest_matches_welch_by_hand(spark):
    from tabscope.operators.hypothesis import ttests
    a = [1.0, 2.0, 4.0, 7.0]
    b = [3.0, 5.0, 6.0, 9.0, 12.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, x double")
    r = ttests(df, ["x"], ["g"]).first()
    va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va / 4 + vb / 5)
    assert math.isclose(r["t_stat"], t, rel_tol=1e-9)
    assert 0 < r["p_value"] < 1


def test_chi_square_yates_2x2(spark):
    from tabscope.operators.hypothesis import chi_squares
    obs = np.array([[10, 20], [30, 40]])
    data = [(i, j) for i in range(2) for j in range(2) for _ in range(obs[i, j])]
    df = spark.createDataFrame([(f"r{i}", f"c{j}") for i, j in data], "a string, b string")
    r = chi_squares(df, ["a", "b"]).first()
    e = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    d = np.abs(obs - e)
    chi2 = (((d - np.minimum(0.5, d)) ** 2) / e).sum()
    assert r["yates"] and math.isclose(r["chi2"], chi2, rel_tol=1e-12)


def test_chi_square_needs_two_by_two(spark):
    from tabscope.operators.hypothesis import chi_squares
    df = spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string")
    assert chi_squares(df, ["a", "b"], p_values=False).count() == 0


def test_chi_square_pairs_all_columns(spark):
    from tabscope.operators.hypothesis import chi_squares
    df = spark.createDataFrame([tuple(f"v{(i * k) % 3}" for k in range(1, 6)) for i in range(30)],
                               "a string, b string, c string, d string, e string")
    names = {(r["variable1"], r["variable2"]) for r in chi_squares(df, df.columns, p_values=False).collect()}
    assert len(names) == 6 and any("e" in p for p in names)      # c is constant here: no test with it
    names = {(r["variable1"], r["variable2"]) for r in chi_squares(df, df.columns, first=4, p_values=False).collect()}
    assert len(names) == 3 and all("e" not in p for p in names)


@pytest.mark.parametrize("kind,value,label", [
    ("cohens_d", 0.19, "Negligible"), ("cohens_d", -0.2, "Small"), ("cohens_d", 0.5, "Medium"),
    ("cohens_d", 0.8, "Large"), ("eta_squared", 0.0099, "Negligible"), ("eta_squared", 0.06, "Medium"),
    ("eta_squared", 0.14, "Large"), ("cramers_v", 0.1, "Small"), ("cramers_v", 0.49, "Medium"),
    ("cramers_v", 0.5, "Large")])
def test_effect_labels(spark, kind, value, label):
    from tabscope.operators.hypothesis import effect_label
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(effect_label(kind, F.col("v"))).first()[0] == label


def test_one_hot_and_codes_by_level_count(spark):
    from tabscope.operators.prep import encode_categoricals
    df = spark.createDataFrame([("k", f"l{i % 2}", f"m{i % 16:02d}", "only") for i in range(32)],
                               "key string, two string, many string, one string")
    out, n = encode_categoricals(df, ["two", "many", "one"])
    assert "two_l1" in out.columns and "two_l0" not in out.columns
    assert "one" in out.columns and n == 2
    codes = sorted({r["many"] for r in out.select("many").collect()})
    assert codes == list(range(16))


def test_label_codes_missing_is_minus_one(spark):
    from tabscope.operators.prep import label_codes
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    got = sorted((r["c"] for r in label_codes(df, "c").collect()))
    assert got == [-1, 0, 1]


def test_class_limits(spark):
    from tabscope.operators.classify import compare_classifiers
    one = spark.createDataFrame([(i, float(i), "a") for i in range(30)], "k long, x double, y string")
    assert compare_classifiers(one, "y", ["x"], [], ["k"], models=["Logistic Regression"]) is None
    many = spark.createDataFrame([(i, float(i), f"c{i % 51}") for i in range(204)], "k long, x double, y string")
    assert compare_classifiers(many, "y", ["x"], [], ["k"], models=["Logistic Regression"]) is None


def test_one_hot_has_no_level_limit(spark):
    from tabscope.operators.prep import encode_labels, feature_frame
    df = spark.createDataFrame([(float(i), None if i % 30 == 7 else f"v{i % 30:02d}", float(i % 3)) for i in range(90)],
                               "x double, c string, y double")
    x, names = feature_frame(df, "y", ["x"], ["c"])
    assert names == ["x"] + [f"c_v{i:02d}" for i in range(1, 30) if i != 7]
    assert x.agg(F.sum("c_v29")).first()[0] == 3.0
    lab, classes = encode_labels(spark.createDataFrame([(f"k{i:03d}",) for i in range(60)] + [(None,)], "t string"), "t")
    assert classes == [f"k{i:03d}" for i in range(60)]
    assert sorted((r.label for r in lab.collect()), key=str)[-1] is None and lab.agg(F.max("label")).first()[0] == 59.0


def test_clustering_guard(spark):
    from tabscope.operators.cluster import cluster_analysis
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 3.0), (4.0, 4.0)], "a double, b double")
    assert cluster_analysis(df, ["a", "b"]) is None
    assert cluster_analysis(df, ["a"]) is None


def test_qq_needs_five(spark):
    from tabscope.operators.charts import qq_fit
    four = spark.createDataFrame([(float(i),) for i in range(4)], "x double")
    five = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    assert qq_fit(four, ["x"]).count() == 0
    assert qq_fit(five, ["x"]).first()["n"] == 5

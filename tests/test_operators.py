"""Operator properties: literature values, exact sizes, brute-force parity, page parsing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.functions.distributions import chi2_sf, f_sf, t_sf2


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.073388), (2.228, 10, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert abs(float(t_sf2(t, df)) - p) < 2e-4


@pytest.mark.parametrize("x,k,p", [(3.841459, 1, 0.05), (18.307, 10, 0.05), (9.488, 4, 0.05)])
def test_chi2_tail(x, k, p):
    assert abs(float(chi2_sf(x, k)) - p) < 2e-4


def test_f_tail():
    assert abs(float(f_sf(3.708, 3, 10)) - 0.05) < 2e-4
    assert abs(float(f_sf(4.351, 1, 20)) - 0.05) < 2e-4


def test_exact_quantiles_match_numpy(spark):
    from tabscope.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=997) * 10, 1)
    df = spark.createDataFrame([(float(x),) for x in v], "value double")
    q = {r["p"]: r["q"] for r in exact_quantiles(df, [0.01, 0.25, 0.5, 0.99], []).collect()}
    for p, got in q.items():
        assert math.isclose(got, np.quantile(v, p), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("margin", [4e-4, 0.0, 0.3])
def test_quantiles_of_any_bracket_are_exact(spark, margin):
    """Brackets that miss their rank, overlap or hold most of the rows give the same values."""
    from tabscope.functions.quantiles import column_quantiles, exact_quantiles
    rng = np.random.default_rng(5)
    cols = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.full(3000, 7.0),
            "hot": np.where(rng.random(3000) < .9, 1.0, rng.random(3000))}
    rows = [tuple(float(x) for x in r) + (None,) for r in zip(*cols.values())]
    rows += [(None, None, None, None, None)] * 10
    df = spark.createDataFrame(rows, ", ".join(f"`{c}.x` double" for c in [*cols, "none"]))
    probs = {f"q{p}": p for p in (0.0, .001, .1, .11, .5, .9, 1.0)}
    got = {r["variable"]: r for r in column_quantiles(df, df.columns, probs, margin=margin).collect()}
    assert got.keys() == {f"{c}.x" for c in cols}
    tall = df.selectExpr(*[f"`{c}.x` AS {c}" for c in cols]).unpivot([], list(cols), "k", "value")
    groups = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(tall, list(probs.values()), ["k"], margin=margin).collect()}
    for c, v in cols.items():
        assert got[f"{c}.x"]["n"] == 3000
        for name, p in probs.items():
            want = np.quantile(v, p)
            assert math.isclose(got[f"{c}.x"][name], want, rel_tol=1e-12, abs_tol=1e-12), (c, p)
            assert math.isclose(groups[c, p], want, rel_tol=1e-12, abs_tol=1e-12), (c, p)


def test_quantiles_scan_twice(spark):
    """Two scans whatever the number of columns, and no distinct values outside the brackets are shuffled."""
    from tabscope.functions.quantiles import column_quantiles
    df = spark.range(200_000).selectExpr("id * 1.0 AS a", "-id * 2.0 AS b", "id % 7 AS c")
    q = {r["variable"]: (r["m"], r["h"]) for r in column_quantiles(df, ["a", "b", "c"], {"m": .5, "h": .99}).collect()}
    want = {"a": (99999.5, 197999.01), "b": (-199999.0, -3999.98), "c": (3.0, 6.0)}
    assert q.keys() == want.keys() and all(q[k] == pytest.approx(want[k], rel=1e-12) for k in q)


def test_many_strata_share_by_largest_remainder(spark):
    """Ten thousand strata of one to three rows, with a null stratum and tied keys; exact size and repeatable."""
    from tabscope.operators.split import kfold, train_test_split
    df = spark.range(20_000).selectExpr("id AS k", "CASE WHEN id < 19990 THEN id % 9973 END AS s")
    one = train_test_split(df, ["k"], stratify=F.col("s")).where("is_test")
    two = train_test_split(df.repartition(7), ["k"], stratify=F.col("s")).where("is_test")
    a, b = sorted(r.k for r in one.collect()), sorted(r.k for r in two.collect())
    assert a == b and len(a) == 4000
    assert kfold(df, ["k"], 2, stratify=F.col("s")).where("s IS NULL").groupBy("fold").count().orderBy("fold").collect() == [(0, 5), (1, 5)]


def test_split_sizes_and_repeatable(spark):
    from tabscope.operators.split import kfold, train_test_split
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(1003)], "k long, s string")
    s1 = train_test_split(df, ["k"], stratify=F.col("s"))
    assert s1.where("is_test").count() == math.ceil(0.2 * 1003)
    s2 = train_test_split(df, ["k"], stratify=F.col("s"))
    assert sorted(r.k for r in s1.where("is_test").collect()) == sorted(r.k for r in s2.where("is_test").collect())
    sizes = sorted(r["count"] for r in kfold(df, ["k"], 5).groupBy("fold").count().collect())
    assert sizes == [200, 200, 201, 201, 201]


def test_knn_matches_brute_force(spark):
    from tabscope.operators.classify import knn_predict
    rng = np.random.default_rng(7)
    tr = rng.normal(size=(300, 3))
    ytr = rng.integers(0, 4, size=300).astype(float)
    te = rng.normal(size=(40, 3))
    trdf = spark.createDataFrame([tuple(map(float, r)) + (float(y),) for r, y in zip(tr, ytr)], "a double, b double, c double, label double")
    tedf = spark.createDataFrame([(i,) + tuple(map(float, r)) for i, r in enumerate(te)], "id long, a double, b double, c double")
    got = {r["id"]: r["prediction"] for r in knn_predict(trdf, tedf, ["a", "b", "c"], "id", 5, "regression",
                                                          block_rows=70).collect()}
    for i, q in enumerate(te):
        d = np.sqrt(((tr - q) ** 2).sum(1))
        nn = np.lexsort((ytr, d))[:5]
        assert math.isclose(got[i], ytr[nn].mean(), rel_tol=1e-12)


def test_auc_with_ties(spark):
    from tabscope.operators.metrics import auc
    lab = [1, 0, 1, 1, 0, 0, 1, 0]
    sc = [0.9, 0.9, 0.7, 0.5, 0.5, 0.2, 0.1, 0.1]
    df = spark.createDataFrame(list(zip(lab, sc)), "label int, score double")
    pos = [s for l, s in zip(lab, sc) if l == 1]
    neg = [s for l, s in zip(lab, sc) if l == 0]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(auc(df).first()["auc"], u, rel_tol=1e-12)


def test_macro_f1_over_label_union(spark):
    from tabscope.operators.metrics import prf
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (1, 3)], "label int, prediction int")
    r = prf(df, average="macro").first()
    # classes 0..3: f1 = 2tp/(npred+ntrue) -> 0: 2/3, 1: 2/5, 2: 2/3, 3: 0
    assert math.isclose(r["f1"], (2 / 3 + 2 / 5 + 2 / 3 + 0) / 4, rel_tol=1e-12)


def test_isolation_forest_flags_about_contamination(spark):
    from tabscope.operators.isoforest import isolation_forest_table
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    r = isolation_forest_table(df, ["a", "b"], n_trees=30).first()
    assert r["rows"] == 2000 and 90 <= r["flagged"] <= 110


def test_visible_text_and_links():
    from tabscope.operators.pages import found_links, parse_page, visible_text
    html = ("<html><head><title> T </title><style>x{}</style></head><body><p>Hello &amp; bye</p>"
            "<script>var a=1;</script><pre>code</pre><div>\n  line two \n</div>"
            "<a href='#top'>t</a><a href='/files/1/download'>f</a><a href='javascript:x()'>j</a>"
            "<img src='i.png'><link href='s.css'></body></html>")
    assert visible_text(html) == "T\nHello & bye\nline two\nt\nf\nj"
    links = found_links(parse_page(html), "https://h.example/a/b.html", html)
    assert [(k["method"], k["pos"], k["url"]) for k in links] == [(1, 0, "https://h.example/files/1/download"),
                                                                 (1, 1, "https://h.example/a/s.css")]


def test_page_parse_keeps_text_after_unclosed_tags():
    from tabscope.operators.pages import parse_page, visible_text
    assert visible_text("<p>a <code>x</p><p>rest of page</p>") == "a\nrest of page"
    assert visible_text("a<br>b<br/>c</code> d <pre>no</pre> e") == "a\nb\nc\nd\ne"
    assert visible_text("<!-- <p>x</p> -->1 < 2 &lt; 3<script>if (a < b) { '</p>' }</script> end") == "1 < 2 < 3\nend"
    assert visible_text("<div title='a > b'>t</div><textarea>u") == "t\nu"
    assert visible_text(None) == visible_text("") == visible_text("<script>x") == ""
    assert parse_page('<A HREF=x.html DATA-URL="y&amp;z"><source src=\'s\'><a href>').hrefs == ["x.html", "y&z", "s"]


def test_file_name_of_any_url(spark):
    from tabscope.operators.pages import file_name
    urls = ["https://h.example/a|b.csv", "https://h.example/a/b.csv?x=/y", "https://h.example", "h/x.txt#f", "", None, "https://[bad/z.csv"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(file_name(F.col("u"))).collect()] == \
        ["a|b.csv", "b.csv", "downloaded_data", "x.txt", "downloaded_data", "downloaded_data", "z.csv"]


@pytest.mark.parametrize("url,ok", [
    ("https://h/x/data.CSV?dl=1", True), ("https://h/courses/1/files/2/download", True),
    ("https://h/courses/1/assignments/2/file.csv", False), ("https://h/page.html", False),
    ("https://h/preview?x", False), ("https://h/api/v1/files/3", True)])
def test_is_data_url(spark, url, ok):
    from tabscope.operators.pages import is_data_url
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(is_data_url(F.col("u"))).first()[0] is ok


def test_page_links_first_method_wins(spark):
    from tabscope.operators.pages import page_links
    html = ('<a href="https://h.example/files/9/submissions/x.csv">a</a> '
            'https://h.example/files/9/submissions/x.csv https://h.example/d.json')
    df = spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")
    got = {r["url"]: (r["is_data"], r["method"]) for r in page_links(df).collect()}
    assert got["https://h.example/files/9/submissions/x.csv"] == (False, 1)
    assert got["https://h.example/d.json"] == (True, 2)


def test_kendall_tau_b_with_ties(spark):
    from tabscope.operators.correlation import kendall_tau_b
    rng = np.random.default_rng(9)
    x = rng.integers(0, 12, size=300).astype(float)
    y = np.round(x * 0.5 + rng.normal(size=300), 0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = kendall_tau_b(df, "x", "y").first()["tau_b"]
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(300) for j in range(i))
    n0 = 300 * 299 / 2
    _, cx = np.unique(x, return_counts=True)
    _, cy = np.unique(y, return_counts=True)
    n1, n2 = (cx * (cx - 1) / 2).sum(), (cy * (cy - 1) / 2).sum()
    assert math.isclose(got, s / math.sqrt((n0 - n1) * (n0 - n2)), rel_tol=1e-12)


def test_omnibus_normal_sample_not_significant():
    from tabscope.operators.regress import omnibus
    k2, p = omnibus(1000, 0.02, 3.05)
    assert k2 >= 0 and p > 0.3


def test_tails_at_any_degrees_of_freedom():
    import math
    from tabscope.functions.distributions import chi2_sf, f_sf, gammaincc, t_sf2
    # P(X > k) of chi-square at its mean: 1/2 - 1 / (3 sqrt(pi k)) + O(k^-3/2)
    for k in (1e3, 1e4, 1e5, 1e6, 1e7, 1e9):
        assert abs(float(chi2_sf(k, k)) - (0.5 - 1 / (3 * math.sqrt(math.pi * k)))) < 0.1 * k ** -1.5
    # the t tail tends to the normal one; the first correction is (x^3 + x) phi(x) / (2 df)
    for x in (0.5, 3.0):
        for df in (1e4, 1e6, 1e9, 1e11):
            phi = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
            assert abs(float(t_sf2(x, df)) - (math.erfc(x / math.sqrt(2)) + (x ** 3 + x) * phi / (2 * df))) < 5 / df ** 2 + 1e-9
    # F with many denominator degrees tends to chi-square / d1
    for d1 in (1, 3, 20):
        for d2 in (1e6, 1e9):
            assert abs(float(f_sf(2.0, d1, d2)) - float(chi2_sf(2.0 * d1, d1))) < 20 / d2 + 1e-9
    # both gamma forms agree where one takes over from the other
    for shift in (-150, 0, 150):
        assert abs(float(gammaincc(9999.0, 9999.0 + shift)) - float(gammaincc(10001.0, 10001.0 + shift * (10001 / 9999) ** 0.5))) < 3e-6
    assert str(float(t_sf2(float("nan"), 3))) == "nan"


def test_csv_keeps_codes_and_dotted_headers(spark, tmp_path):
    from tabscope.operators.profile import describe, missing_values, profile_summary
    from tabscope.sources.io import load_many, load_table
    path = tmp_path / "a.csv"
    path.write_text("a.b, code ,n`x,f,e\n1,10D,3,1.5,\n2,20F,4,1e3,\n,7d,NA,.5,\n,,,,\n2,7d,5,-2,\n2,7d,5,-2,\n")
    df = load_table(spark, str(path))
    assert df.dtypes == [("a.b", "bigint"), ("code", "string"), ("n`x", "bigint"), ("f", "double")]
    assert [tuple(r) for r in df.collect()] == [(1, "10D", 3, 1.5), (2, "20F", 4, 1000.0), (None, "7d", None, 0.5), (2, "7d", 5, -2.0), (2, "7d", 5, -2.0)]
    assert {r["variable"] for r in describe(df).collect()} == {"a.b", "n`x", "f"}
    assert [r["missing_count"] for r in missing_values(df).orderBy("position").collect()] == [1, 0, 1, 0]
    assert profile_summary(df).first()["duplicate_rows"] == 1
    for i in range(12):
        (tmp_path / f"f{i}.csv").write_text(f"x\n{i}\n")
    got = load_many(spark, [str(tmp_path / f"f{i}.csv") for i in range(12)] + [str(tmp_path / "none.xyz")])
    assert len(got.tables) == 12 and got.status.count() == 13


def test_knn_with_many_ties(spark):
    from tabscope.operators.classify import knn_predict
    train = spark.createDataFrame([(i, 1.0, 2.0, float(i % 100)) for i in range(300)], "k long, a double, b double, label double")
    test = spark.createDataFrame([(1000, 1.0, 2.0), (1001, 5.0, 5.0)], "k long, a double, b double")
    for block in (8192, 40):
        got = {r.k: r.prediction for r in knn_predict(train, test, ["a", "b"], "k", 5, "regression", block_rows=block).collect()}
        assert got == {1000: (0 * 3 + 1 * 2) / 5, 1001: (0 * 3 + 1 * 2) / 5}


def test_isolation_forest_draws_copies_one_by_one(spark):
    from tabscope.operators.isoforest import isolation_forest_flags
    import random
    rng = random.Random(1)
    rows = [(i, 0.0, 0.0) for i in range(1800)] + [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(1800, 2000)] + [(2000, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = isolation_forest_flags(df, ["a", "b"], n_trees=50).collect()
    assert len(got) == 2001
    same = [r.iso_score for r in got if r.k < 1800]
    rest = [r.iso_score for r in got if 1800 <= r.k < 2000]
    assert max(same) == min(same) > sum(rest) / len(rest) + 0.1
    assert sum(1 for r in got if r.is_outlier) <= 100 and not any(r.is_outlier for r in got if r.k < 1800)
    assert [r.iso_score for r in got if r.k == 2000] == [None]
    again = isolation_forest_flags(df.repartition(7), ["a", "b"], n_trees=50)
    assert {r.k: r.iso_score for r in again.collect()} == {r.k: r.iso_score for r in got}


def test_analyze_fills_the_findings(spark):
    import random
    from tabscope.operators.analyze import analyze
    rng = random.Random(5)
    rows = []
    for i in range(120):
        a = rng.gauss(0, 1)
        rows.append((i, a, a * 2 + rng.gauss(0, .1), rng.choice("xy"), rng.choice("pqr"), int(a > 0)))
    df = spark.createDataFrame(rows, "k long, a double, b double, c string, d string, y int")
    out = analyze(df, "y", "k", trees=3, boost_iter=2, max_k=3, restarts=1)
    got = {(r.section, r.metric): r.value for r in out["findings"].collect()}
    assert float(got["classification", "f1_score"]) > 0.9 and 0 < float(got["regression", "r2"]) < 1
    assert int(got["hypothesis", "total_tests"]) > 0 and got["clustering", "best_k"] in "23" and got["data", "n_rows"] == "120"
    assert {r.model for r in out["regressors"].collect()} == {"Linear Regression", "Random Forest", "Gradient Boosting"}


def test_failing_model_is_a_row(spark, monkeypatch):
    from tabscope.operators import classify, regress
    df = spark.createDataFrame([(i, float(i % 7), float(i), "ab"[i % 2]) for i in range(40)], "k long, x double, y double, c string")
    real = classify.classifier

    class Broken:
        def fit(self, data):
            raise ValueError("no fit")
    monkeypatch.setattr(classify, "classifier", lambda name, *a: Broken() if name == "Random Forest" else real(name, *a))
    got = {r.model: r for r in classify.compare_classifiers(df, "c", ["x", "y"], [], ["k"], models=["Logistic Regression", "Random Forest"])["comparison"].collect()}
    assert got["Random Forest"].error == "no fit" and got["Random Forest"].f1_score is None
    assert got["Logistic Regression"].error is None and got["Logistic Regression"].accuracy is not None
    real_r = regress.regression_estimators
    monkeypatch.setattr(regress, "regression_estimators", lambda names, *a: {"Lasso": Broken(), **real_r(["Linear Regression"], *a)})
    cmp, _ = regress.compare_regressors(df, "y", ["x"], ["k"], models=["Lasso", "Linear Regression"])
    assert {r.model: r.error for r in cmp.collect()} == {"Lasso": "no fit", "Linear Regression": None}


class _Unfit:
    def __init__(self, problem):
        self.problem = problem

    def fit(self, data):
        raise self.problem


def _part_rows(spark, folder):
    """A small table ``part`` of our own rows."""
    spark.range(60).select(F.col("id").alias("p_partkey"), F.concat(F.lit("T"), F.col("id") % 3).alias("p_type"), (F.col("id") % 7).cast("int").alias("p_size"),
                           (F.col("id") * 3.0 + F.col("id") % 5).alias("p_retailprice")).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_failure_of_spark_is_no_model_row(spark, monkeypatch):
    """Only a model that cannot be fitted is a row of the comparison; a lost task or a full heap is raised."""
    from tabscope.operators import regress
    df = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(40)], "k long, x double, y double")
    real = regress.regression_estimators
    monkeypatch.setattr(regress, "regression_estimators", lambda names, *a: {"Lasso": _Unfit(RuntimeError("lost executor")), **real(["Linear Regression"], *a)})
    with pytest.raises(RuntimeError, match="lost executor"):
        regress.compare_regressors(df, "y", ["x"], ["k"], models=["Lasso", "Linear Regression"])


@pytest.mark.parametrize("query", ["compare_regressors_part", "regression_importance_part"])
def test_query_of_regressors_shows_a_failing_model(spark, monkeypatch, tmp_path, query):
    """The query has no column for the error, so a model without a result is no row and no missing share."""
    import __spark_entry__ as E
    from tabscope.operators import regress
    real, asked = regress.regression_estimators, []

    def some(names, n, sigma, trees, boost_iter, *a):
        asked.append((sorted(names), trees, boost_iter))
        return {**real(["Linear Regression"], n, sigma, trees, boost_iter, *a), "Random Forest": _Unfit(ValueError("no fit"))}
    monkeypatch.setattr(regress, "regression_estimators", some)
    with pytest.raises(RuntimeError, match="Random Forest failed: no fit"):
        E.queries()[query](spark, _part_rows(spark, tmp_path)).collect()
    assert set(map(str, asked)) == {str((["Gradient Boosting", "Linear Regression", "Random Forest"], 100, 100))}


def test_query_of_auto_ml_fits_default_sizes(spark, monkeypatch, tmp_path):
    """Sizes of the reference; a failure of Spark is raised, a model that cannot be fitted fails the query, which has no column for it."""
    import __spark_entry__ as E
    from tabscope.operators import automl
    d = spark.range(80).select(F.col("id").alias("doc_id"), (F.col("id") * 7 % 50).alias("n_chars"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    d.select("doc_id", (F.col("n_chars") > 25).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    real, sizes, problem = automl.classifier, set(), [ValueError("no fit")]

    def some(name, n, classes, trees, boost_iter, seed, max_iter):
        sizes.add((trees, boost_iter, max_iter))
        return _Unfit(problem[0]) if name == "SVM" else real("Logistic Regression", n, classes)
    monkeypatch.setattr(automl, "classifier", some)
    with pytest.raises(RuntimeError, match="SVM failed: no fit"):
        E.queries()["auto_ml_documents"](spark, str(tmp_path))
    assert sizes == {(150, 100, 300)}
    problem[0] = RuntimeError("lost executor")
    with pytest.raises(RuntimeError, match="^lost executor"):
        E.queries()["auto_ml_documents"](spark, str(tmp_path))


def test_regressor_without_a_score_is_a_row(spark):
    """A label that does not vary has no r2."""
    from tabscope.operators import regress
    df = spark.createDataFrame([(i, float(i % 7), 2.0) for i in range(40)], "k long, x double, y double")
    got = regress.compare_regressors(df, "y", ["x"], ["k"], models=["Linear Regression"])[0].collect()
    assert len(got) == 1 and got[0].error and got[0].cv_r2_mean is None


def test_duplicates_and_distinct_by_typed_values(spark):
    """Microseconds, signed zeros, places of nulls, dotted names and nested nulls tell rows apart."""
    import datetime as dt
    from tabscope.operators.profile import profile_summary
    from tabscope.operators.roles import distinct_counts
    a, b = dt.datetime(2020, 1, 1, 0, 0, 0, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 2)
    rows = [(a, 0.0, "x", None, [1, None]), (b, 0.0, "x", None, [1, None]), (a, -0.0, "x", None, [1, None]),
            (a, 0.0, None, "x", [1, None]), (a, 0.0, "x", None, [None, 1]), (None, None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "t timestamp, `v.x` double, s string, u string, l array<int>")
    assert profile_summary(df).first()["duplicate_rows"] == 2          # the signed zero and the null row
    got = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, df.columns).collect()}
    assert got == {"t": 2, "v.x": 1, "s": 1, "u": 1, "l": 2}


def test_spearman_pairwise_complete(spark):
    """Ties, nulls in several columns and a constant one, against ranks of each pair's complete rows."""
    import pandas as pd
    from tabscope.operators.correlation import spearman_matrix
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 400).astype(float), "b.c": rng.normal(size=400), "d": rng.integers(0, 3, 400).astype(float),
                        "e": rng.normal(size=400), "k": np.ones(400)})
    pdf.loc[rng.random(400) < .3, "b.c"] = np.nan
    pdf.loc[rng.random(400) < .2, "d"] = np.nan
    rows = [tuple(None if x != x else float(x) for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns))
    for r in spearman_matrix(df, list(pdf.columns)).collect():
        if r.i == r.j:
            assert r.r == 1.0
        elif "k" in (r.var1, r.var2):
            assert r.r is None or r.r != r.r
        else:
            pair = pdf[[r.var1, r.var2]].dropna().rank()
            assert math.isclose(r.r, np.corrcoef(pair.iloc[:, 0], pair.iloc[:, 1])[0, 1], rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("pivots,block_rows", [(1024, 8192), (12, 50), (1, 64)])
def test_knn_visits_few_balls_and_stays_exact(spark, pivots, block_rows):
    """Clusters, a third of all train rows equal, tied distances; the neighbours are those of a full comparison."""
    from tabscope.operators.classify import nearest_train
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(8, 3)) * 40
    x = np.concatenate([centre[rng.integers(0, 8, 1000)] + rng.normal(size=(1000, 3)), np.tile(centre[0], (500, 1))])
    y = rng.integers(0, 4, len(x)).astype(float)
    q = np.concatenate([centre[rng.integers(0, 8, 120)] + rng.normal(size=(120, 3)), rng.normal(size=(5, 3)) * 200])
    train = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, `b.c` double, d double, label double")
    test = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "id long, a double, `b.c` double, d double")
    best, more = nearest_train(train, test, ["a", "b.c", "d"], "id", 7, "label", block_rows, pivots)
    got = {}
    for r in best.collect():
        got.setdefault(r["id"], []).append((r["_d"], r["_y"]))
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        want = sorted(zip(d, y))[:7]
        assert [b for _, b in sorted(got[i])] == [b for _, b in want]
        assert np.allclose([a for a, _ in sorted(got[i])], [a for a, _ in want], rtol=1e-12, atol=1e-12)
    if pivots > 1:      # eight far clusters: most of the other balls are ruled out
        balls = min(pivots, 1500 // 64)
        assert more.count() < 0.4 * len(q) * (balls - 1)


def test_cross_validation_of_any_estimator(spark):
    """MLlib's classifier and a function estimator; named scores, an own score, strata, rows without a label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from tabscope.operators.crossval import SCORERS, Fitted, cross_validate, score_summary
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal() + 2 * (i % 3 == 0)), None if i == 7 else int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, label int")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression()])
    scores = cross_validate(df, model, ["accuracy", "f1_macro", "roc_auc"], ["k"], k=4, stratified=True)
    got = {r["scorer"]: r for r in score_summary(scores).collect()}
    assert all(len(r["scores"]) == 4 == r["n_splits"] for r in got.values()) and got["roc_auc"]["mean"] > .8
    assert math.isclose(got["accuracy"]["std"], np.std(got["accuracy"]["scores"]), abs_tol=1e-12)
    rule = Fitted(lambda train: lambda test: test.withColumn("prediction", (F.col("x") > 1).cast("double")))
    every = cross_validate(df, rule, {"rows": lambda p, keys: p.groupBy(*keys).agg(F.count(F.lit(1)).alias("score")), "accuracy": SCORERS["accuracy"]}, ["k"])
    by = {}
    for r in every.collect():
        by.setdefault(r["scorer"], {})[r["fold"]] = r["score"]
    assert sum(by["rows"].values()) == 299
    right = sum((x > 1) == (y == 1) for _, x, y in rows if y is not None)
    assert math.isclose(sum(by["accuracy"][f] * by["rows"][f] for f in by["rows"]), right, abs_tol=1e-9)


def test_kmeans_of_all_k_together(spark):
    """Three far groups: k = 3 wins, its centres are the groups' means, and no restart has less inertia."""
    from tabscope.operators.cluster import centre_scores, fit_many
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 2)) + c for c in ((0, 0), (20, 0), (0, 20))])
    points = spark.createDataFrame([([float(a), float(b)],) for a, b in x], "x array<double>").repartition(5)
    centres = fit_many(points, [2, 3, 5], restarts=4)
    got = {r["k"]: r for r in centre_scores(points, centres).collect()}
    assert max(got, key=lambda k: got[k]["silhouette"]) == 3
    means = sorted(x[i * 60:(i + 1) * 60].mean(axis=0).tolist() for i in range(3))
    assert np.allclose(sorted(centres[3].tolist()), means)
    assert math.isclose(got[3]["inertia"], sum(((x[i * 60:(i + 1) * 60] - x[i * 60:(i + 1) * 60].mean(axis=0)) ** 2).sum() for i in range(3)), rel_tol=1e-9)
    assert got[2]["inertia"] > got[3]["inertia"] > got[5]["inertia"]


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a "x" ', "</a ", "<!x", "<script>", "<div>", "<b></i>", "http://", "<a<", "<div></p>"])
def test_hostile_pages_take_linear_time(piece):
    """Tags that never end, unclosed elements and end tags of no element: twice the page, about twice the time."""
    import time
    from tabscope.operators.pages import found_links, parse_page

    def seconds(n):
        source, start = piece * (n // len(piece)), time.process_time()
        found_links(parse_page(source), "http://x/", source)
        return time.process_time() - start
    seconds(10_000)
    small = min(seconds(100_000) for _ in range(3))
    assert seconds(800_000) < 24 * max(small, 0.01)


def test_tags_end_outside_quotes():
    from tabscope.operators.pages import parse_page
    page = parse_page("""a<b title="x>y" href='no'>c</b><a href="u>v" data-file=w>d</A>< e <!-- <p> --> f<!doctype x>g<a 'h""")
    assert page.text == "a\nc\nd\n< e\nf\ng<a 'h" and page.hrefs == ["u>v", "w"]
    assert parse_page("<script>1<2</script>x<code>y<p>z</code>w<a href=q").text == "x\nw<a href=q"


def test_forest_draws_of_a_row_with_a_billion_copies(spark):
    """Copies are drawn by order statistics: as many draws below the bound as expected, in a second and without a row per copy."""
    from tabscope.operators.isoforest import draws
    copies = spark.createDataFrame([(0.0, 1_000_000_000)] + [(float(i), 1) for i in range(1, 1001)], "a double, _n long")
    got = draws(copies, ["a"], 1_000_001_000, 50, 256, 42).groupBy("_tree").agg(F.count(F.lit(1)).alias("n"), F.max("_u").alias("most")).collect()
    assert len(got) == 50 and all(850 < r["n"] < 1200 and r["most"] <= 1024 / 1_000_001_000 for r in got)
    # equal chances: of 300 copies beside 100 rows, three in four draws are copies
    few = spark.createDataFrame([(0.0, 300)] + [(float(i), 1) for i in range(1, 101)], "a double, _n long")
    low = draws(few, ["a"], 400, 400, 8, 1)
    share = low.agg(F.avg((F.col("a") == 0).cast("double"))).first()[0]
    assert abs(share - .75) < .02
    one = low.where("a = 0").groupBy("_tree").count().agg(F.avg("count")).first()[0]
    assert abs(one - 300 * 32 / 400) < 1.5


def test_crosstab_of_many_levels(spark):
    from tabscope.operators.hypothesis import crosstab_cells
    df = spark.range(60_000).selectExpr("id % 20000 AS x", "CASE WHEN id % 7 > 0 THEN id % 15000 END AS `y.z`")
    cells = crosstab_cells(df, "x", "y.z")
    got = cells.agg(F.max("row_code"), F.max("col_code"), F.sum("count")).first()
    assert tuple(got) == (19999, 14999, 60_000 - len(range(0, 60_000, 7)))
    names = sorted({str(i % 20000) for i in range(60_000) if i % 7})
    assert cells.where("row = '19'").first()["row_code"] == names.index("19")


def test_durbin_watson_of_tied_keys(spark):
    """Rows of equal order keys stand by residual: the same value from any layout and any number of partitions."""
    from tabscope.operators.regress import durbin_watson
    rng = np.random.default_rng(9)
    rows = sorted((int(k), float(e)) for k, e in zip(rng.integers(0, 12, 400), rng.normal(size=400)))
    e = np.array([r[1] for r in rows])
    want = (np.diff(e) ** 2).sum() / (e ** 2).sum()
    df = spark.createDataFrame([rows[i] for i in rng.permutation(400)], "`k.t` int, residual double")
    for parts, per in ((1, 1000), (6, 1000), (5, 37)):
        got = durbin_watson(df.repartition(parts), "k.t", rows_per_part=per).first()["durbin_watson"]
        assert math.isclose(got, want, rel_tol=1e-12)


def test_knn_compares_each_point_once(spark):
    """Crowds at few points: at most k train rows of a point and one row of each test point are compared."""
    from tabscope.operators import classify as C
    train = spark.range(9000).select("id", (F.col("id") % 3 * 10.0).alias("a"), (F.col("id") * 7 % 9000).cast("double").alias("label"))
    test = spark.range(20000, 26000).select("id", (F.col("id") % 2 * 10.0 + F.lit(1.0)).alias("a"))
    few = C._few_labels(train.select("a", F.col("label").alias("_y"), F.xxhash64("id").alias("_row")), ["a"], 4)
    assert few.count() == 12
    best, more = C.nearest_train(train, test, ["a"], "id", 4, "label")
    assert more.select("id").distinct().count() <= 2
    got = {}
    for r in best.collect():
        got.setdefault(r["id"], []).append((r["_d"], r["_y"]))
    rows = train.collect()
    want = {e: sorted((abs(r["a"] - (e * 10 + 1)), r["label"]) for r in rows)[:4] for e in (0, 1)}
    assert len(got) == 6000 and all(sorted(v) == want[i % 2] for i, v in got.items())


def test_first_by_hash_is_the_order_of_distinct_rows(spark):
    from tabscope.functions.frames import first_by_hash
    df = spark.range(500).select((F.col("id") % 40 - F.lit(20.0)).alias("a"), F.array(F.col("id") % 3 * F.lit(-0.0), F.lit(1.0)).alias("x"))
    for cols in (["a"], ["x"], ["a", "x"]):
        want = df.select(*cols).distinct().orderBy(F.xxhash64(*cols), *cols).limit(7).collect()
        assert first_by_hash(df, cols, 7).collect() == want
    assert first_by_hash(df.limit(0), ["a"], 7).count() == 0


def test_filled_up_trees_give_the_path_lengths():
    """Leaves at any depth, infinite values among them, against a walk node by node."""
    from tabscope.operators.isoforest import _full_tree, _grow, _path_lengths, c_factor
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 3)), np.zeros((40, 3)), [[np.inf, -np.inf, 0.0], [-np.inf, np.inf, np.inf]]])
    for depth, rows in ((8, 256), (3, 20), (0, 5), (8, 1)):
        nodes = np.asarray(_grow(x[:rows], rng, depth), float)
        tree = {k: nodes[:, i] if k == "threshold" else nodes[:, i].astype(int) for i, k in enumerate(("feature", "threshold", "left", "right", "size", "depth"))}
        want = []
        for v in x:
            p = 0
            while tree["feature"][p] >= 0:
                p = tree["left" if v[tree["feature"][p]] < tree["threshold"][p] else "right"][p]
            want.append(tree["depth"][p] + c_factor([tree["size"][p]])[0])
        assert _path_lengths(np.ascontiguousarray(x.T), _full_tree(tree)).tolist() == want


def test_kmeans_row_between_centres_counts_once(spark):
    """A row as near to two centres goes to the first one only; blocks hold every row."""
    from tabscope.operators.cluster import _blocks, _moments
    points = spark.createDataFrame([([0.0, 0.0],), ([-2.0, 0.0],), ([2.0, 0.0],)] * 50, "x array<double>").repartition(3)
    blocks = _blocks(points)
    assert blocks.agg(F.sum("n")).first()[0] == 150
    n, sums, norms, inertia = _moments(blocks, {"r": np.array([[-1.0, 0.0], [1.0, 0.0]])})["r"]
    assert n.tolist() == [100, 50] and sums.tolist() == [[-100, 0], [100, 0]]
    assert norms.tolist() == [200, 200] and inertia.tolist() == [100, 50]


@pytest.mark.parametrize("d", [1, 3, 8])
def test_kmeans_boxes_equal_all_distances(spark, d):
    """Boxes that go to one centre as a whole give the sums of all distances; few of their points are compared."""
    from tabscope.operators import cluster as K
    rng = np.random.default_rng(d)
    x = rng.normal(size=(16_384, d))
    y = K.in_boxes(x)
    assert sorted(map(tuple, x)) == sorted(map(tuple, y))
    if d < 8:       # neighbours: the boxes are small
        assert np.ptp(y.reshape(-1, K.BOX, d), axis=1).mean() < 0.5 * np.ptp(x.reshape(-1, K.BOX, d), axis=1).mean()
    runs = [rng.normal(size=(k, d)) for k in (2, 5, 10)] + [np.zeros((3, d)), x[:4]]
    want = []
    for c in runs:
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        want += [np.bincount(at, w, len(c)) for w in (np.ones(len(x)), *x.T, (x * x).sum(axis=1))]
    got = np.split(K._box_sums(y, runs), np.cumsum([len(c) for c in runs])[:-1])
    assert all(np.allclose(a, b) for a, b in zip([col for g in got for col in g.T], want))


def test_kmeans_blocks_hold_neighbours(spark, monkeypatch):
    """Every point is in one block, also of a crowded cell, and a large part is cut; most boxes are settled without their points."""
    from tabscope.operators import cluster as K
    monkeypatch.setattr(K, "PART", 8_192)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(size=(40_000, 2)), np.full((9_000, 2), 0.25)]).round(6)
    rng.shuffle(x)
    points = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    blocks = K._blocks(points)
    got = np.concatenate([np.frombuffer(r["b"], float).reshape(r["n"], 2) for r in blocks.collect()])
    assert np.array_equal(got[np.lexsort(got.T)], x[np.lexsort(x.T)])
    assert blocks.rdd.getNumPartitions() > 1
    large = [np.frombuffer(r["b"], float).reshape(r["n"], 2) for r in blocks.collect() if r["n"] >= 2_048]
    c = np.array([[0.2, 0.2], [0.7, 0.8], [0.9, 0.1]])
    box = np.concatenate(large).T.reshape(2, -1, K.BOX)
    low, high = box.min(axis=2), box.max(axis=2)
    assert K._whole(c, (low + high) / 2, (high - low) / 2)[1].mean() > 0.7
    n, sums, norms, inertia = K._moments(blocks, {"r": c})["r"]
    at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    assert n.tolist() == np.bincount(at).tolist() and np.allclose(sums[:, 0], np.bincount(at, x[:, 0]))
    assert math.isclose(inertia.sum(), ((x - c[at]) ** 2).sum(), rel_tol=1e-9)


def test_first_by_hash_of_many_and_few(spark):
    """The lowest 64th of the hashes is enough, or not: the same rows as over all hashes."""
    from tabscope.functions.frames import first_by_hash
    df = spark.range(5_000).select((F.col("id") % 4_000).alias("v"))
    order = [r["v"] for r in df.distinct().orderBy(F.xxhash64("v")).collect()]
    for k in (3, 20, 2_000, 9_000):
        assert [r["v"] for r in first_by_hash(df, ["v"], k).collect()] == order[:k]
    assert first_by_hash(df.where("v < 0"), ["v"], 3).count() == 0


def test_spearman_sends_ranks_as_they_are(spark, monkeypatch):
    """The ranks meet by row in one exchange of (row, column, ranks); no partial aggregate, wide in all columns, goes before it."""
    from tabscope.operators import correlation as K
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a, f=type(spark.range(1)).repartition: seen.append(self.columns) or f(self, *a))
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                 F.when(F.col("id") % 3 > 0, -F.col("id")).cast("double").alias("c"))
    monkeypatch.setattr(K, "FEW", 20)       # b by broadcast, a and c by a shuffle
    got = {(r.var1, r.var2): r.r for r in K.spearman_matrix(df, ["a", "b", "c"]).collect()}
    assert math.isclose(got["a", "c"], -1.0)
    assert seen == [["_id", "_c", "r_f0", "r_f1"]]


def test_pages_are_parsed_in_slices():
    import pyarrow as pa
    from tabscope.operators.pages import page_slices
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "s": ["x" * n if n is not None else None for n in (5, 3, None, 30, 1, 9, 2)]})
    got = [p.column("i").to_pylist() for p in page_slices(batch, "s", 10)]
    assert got == [[0, 1, 2], [3], [4, 5], [6]]
    assert [p.num_rows for p in page_slices(batch.slice(0, 0), "s")] == []


def test_quantile_of_many_rows_cuts_at_one_sketch(spark):
    """More rows than a sketch holds: its random brackets are the same in all branches of the plan."""
    from tabscope.functions.quantiles import exact_quantiles
    df = spark.range(0, 1_500_000, numPartitions=8).select((F.xxhash64("id") % 1_000_000_007).cast("double").alias("value"))
    want = np.quantile(df.toPandas()["value"].to_numpy(), [.05, .5])
    for _ in range(2):
        got = {r["p"]: r["q"] for r in exact_quantiles(df, [.05, .5], []).collect()}
        assert np.allclose([got[.05], got[.5]], want, rtol=1e-12)


def test_forty_columns_are_prepared_for_clusters(spark):
    """Null and NaN rows go; the plan of many renamed columns stays small."""
    from tabscope.operators.cluster import prepare
    from tabscope.session import cut_lineage
    names = [f"c{i}" for i in range(40)]
    df = spark.range(30).select(*[F.when((F.col("id") == i) & F.lit(i < 10), F.lit(None)).when((F.col("id") == 20) & F.lit(i == 39), F.lit(float("nan")))
                                  .otherwise(F.col("id") * (i + 1)).cast("double").alias(c) for i, c in enumerate(names)])
    data, n = prepare(df, names)
    assert n == cut_lineage(data).count() == 19


def test_fits_read_rows_in_parts(spark, monkeypatch):
    """A table in one part is dealt over several before the fits; a small one stays as it is."""
    from pyspark.sql import functions as F
    from tabscope.functions.frames import spread
    from tabscope.operators import regress
    df = spark.range(0, 60_000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 97).alias("x"), (F.col("id") % 97 * 2.0).alias("y"))
    assert spread(df, 60_000).rdd.getNumPartitions() == 3 and spread(df, 20_000).rdd.getNumPartitions() == 1
    assert spread(df, 60_000).exceptAll(df).isEmpty()
    parts, cut = [], regress.cut_lineage

    def counted(rows):
        parts.append(rows.rdd.getNumPartitions())
        return cut(rows)
    monkeypatch.setattr(regress, "cut_lineage", counted)
    cmp, _ = regress.compare_regressors(df, "y", ["x"], ["k"], models=["Linear Regression"])
    assert parts == [3] and cmp.first()["r2"] > 0.999


@pytest.mark.parametrize("classes", [0, 4])
def test_forest_importance_equals_mllib(spark, classes):
    """One tree over every row, grown in one group and in many, against MLlib's (rf_importance fits this forest)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from tabscope.operators.forest import forest_importance
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, k, 1500) for k in (20, 7, 2, 31)], axis=1).astype(float)
    y = np.sin(x[:, 0]) * 3 + x[:, 1] * x[:, 2] + rng.normal(size=1500)
    y = np.digitize(y, [-1.0, 1.0, 4.0]).astype(float) if classes else y
    names = ["a", "b b", "c.c", "d"]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ["f0", "f1", "f2", "f3", "y"])
    kind = RandomForestClassifier if classes else RandomForestRegressor
    data = VectorAssembler(inputCols=df.columns[:4], outputCol="features").transform(df.withColumnRenamed("y", "label"))
    # a deep tree has nodes of few rows, where features part them equally well and rounding picks one
    for depth, subtree, close in ((4, 1 << 15, 1e-9), (4, 200, 1e-9), (30, 200, 1e-2)):
        want = kind(numTrees=1, featureSubsetStrategy="all", maxDepth=depth, bootstrap=False).fit(data).featureImportances
        got = forest_importance(df.toDF(*names, "y"), "y", names, classes, trees=1, max_depth=depth, bootstrap=False, subtree=subtree)
        print("DIFF", classes, depth, subtree, np.abs(got - want.toArray()).max())
        assert np.allclose(got, want.toArray(), atol=close)


def test_forest_draws_and_groups(spark):
    """Draws have mean 1 and differ by tree; a forest in small groups equals one in whole trees."""
    from tabscope.operators.forest import forest_importance, weights
    rid = np.arange(50_000)
    w = np.stack([weights(rid, t, 42) for t in range(3)]).astype(float)
    assert np.allclose(w.mean(axis=1), 1, atol=0.02) and np.allclose(w.var(axis=1), 1, atol=0.03)
    assert np.abs(np.corrcoef(w) - np.eye(3)).max() < 0.02
    df = spark.range(0, 2000, 1, 2).selectExpr("cast(pmod(xxhash64(id), 50) as double) a", "cast(pmod(xxhash64(id, 1), 9) as double) b",
                                               "pmod(xxhash64(id, 2), 100) / 7.0 + pmod(xxhash64(id), 50) y")
    whole, parts = (forest_importance(df, "y", ["a", "b"], trees=5, subtree=s) for s in (1 << 15, 150))
    assert np.allclose(whole, parts, atol=1e-9) and whole[0] > whole[1] > 0

"""Registered queries: sources, sinks, findings and the analysis plan.

Round trips write Spark-derived copies of the driver tables under the
session's checkpoint folder (the shared folder on a cluster) and read them
back through the loaders.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import findings as FD
from ..session import ensure_checkpoint_dir
from ..sources import io as IO
from .profile_queries import ORDERS_NULLS_SQL, orders_nulls
from .registry import register, t


def _scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "exports", uuid.uuid4().hex, name)


def _types_sql(pairs, src):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, '{ty}' AS dtype, CAST(COUNT({c}) AS BIGINT) AS non_null FROM {src}"
        for c, ty in pairs)


_ORD_CSV = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "string"), ("o_orderpriority", "string")]


@register("csv_roundtrip_orders_nulls", "SRC-1 SRC-4 SRC-6", _types_sql(_ORD_CSV, ORDERS_NULLS_SQL))
def csv_roundtrip_orders_nulls(spark, sf):
    path = _scratch(spark, "orders.csv")
    orders_nulls(spark, sf).write.option("header", True).csv(path)
    df = IO.load_table(spark, path)
    aggs = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    rows = [(f.name, f.dataType.simpleString(), int(aggs[f.name])) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column_name string, dtype string, non_null bigint")


@register("tsv_json_roundtrip_part", "SRC-2 SRC-3 SRC-5", """
SELECT 'part.tsv' AS file, TRUE AS loaded, CAST(COUNT(*) AS BIGINT) AS rows, 6 AS cols FROM part
UNION ALL SELECT 'part.json', TRUE, CAST(COUNT(*) AS BIGINT), 6 FROM part
UNION ALL SELECT 'part.xyz', FALSE, NULL, NULL""")
def tsv_json_roundtrip_part(spark, sf):
    p = t(spark, sf, "part")
    tsv, js = _scratch(spark, "part.tsv"), _scratch(spark, "part.json")
    p.write.option("header", True).option("sep", "\t").csv(tsv)
    p.write.json(js)
    bogus = _scratch(spark, "part.xyz")
    res = IO.load_many(spark, [tsv, js, bogus])
    return res.status.select("file", "loaded", "rows", "cols")


@register("utf8_report_documents", "SRC-7")
def utf8_report_documents(spark, sf):
    path = _scratch(spark, "documents_text")
    t(spark, sf, "documents").select("text").write.text(path)
    r = IO.utf8_report(spark, path)
    return r.agg(F.sum("lines").alias("lines"), F.sum("invalid_lines").alias("invalid_lines"))


@register("preview_orders", "SRC-8", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100""")
def preview_orders(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus",
                                      "o_totalprice")
    return IO.preview(o, 100, ["o_orderkey"])


_LI_EXPORT = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
              ("l_linenumber", "bigint"), ("l_quantity", "double"), ("l_extendedprice", "double"),
              ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
              ("l_linestatus", "string"), ("l_shipdate", "timestamp")]


@register("typed_export_lineitem", "SNK-1", _types_sql(_LI_EXPORT, "lineitem"))
def typed_export_lineitem(spark, sf):
    path = _scratch(spark, "lineitem_typed")
    IO.typed_export(t(spark, sf, "lineitem"), path)
    back = spark.read.parquet(path)
    aggs = back.agg(*[F.count(F.col(c)).alias(c) for c in back.columns]).first()
    rows = [(f.name, f.dataType.simpleString(), int(aggs[f.name])) for f in back.schema.fields]
    return spark.createDataFrame(rows, "column_name string, dtype string, non_null bigint")


@register("report_tables_orders", "SNK-2 FND-2")
def report_tables_orders(spark, sf):
    from ..operators.profile import missing_table
    o = orders_nulls(spark, sf)
    folder = _scratch(spark, "report")
    IO.write_report({"findings": FD.data_findings(o), "missing": missing_table(o)}, folder)
    return spark.read.parquet(os.path.join(folder, "findings"))


@register("findings_lineitem", "FND-1", """
SELECT 'data' AS section, 'n_rows' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM lineitem
UNION ALL SELECT 'data', 'n_cols', '11'
UNION ALL SELECT 'data', 'total_missing', '0'
UNION ALL SELECT 'data', 'duplicate_rows',
  CAST((SELECT COUNT(*) FROM lineitem) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS VARCHAR)
UNION ALL SELECT 'roles', 'numeric_columns', '8'
UNION ALL SELECT 'roles', 'categorical_columns',
  CAST((CASE WHEN COUNT(DISTINCT l_returnflag) * 1.0 / COUNT(*) < 0.5 THEN 1 ELSE 0 END)
     + (CASE WHEN COUNT(DISTINCT l_linestatus) * 1.0 / COUNT(*) < 0.5 THEN 1 ELSE 0 END) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'roles', 'datetime_columns', '1'
UNION ALL SELECT 'roles', 'text_columns',
  CAST((CASE WHEN COUNT(DISTINCT l_returnflag) * 1.0 / COUNT(*) < 0.5 THEN 0 ELSE 1 END)
     + (CASE WHEN COUNT(DISTINCT l_linestatus) * 1.0 / COUNT(*) < 0.5 THEN 0 ELSE 1 END) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'data', 'columns_with_missing', '0'""")
def findings_lineitem(spark, sf):
    return FD.data_findings(t(spark, sf, "lineitem"))


@register("analysis_plan_lineitem", "FND-3", """
SELECT 'profile' AS analysis, TRUE AS runs, 'always' AS reason
UNION ALL SELECT 'descriptive', TRUE, 'always'
UNION ALL SELECT 'correlation', TRUE, '8 numeric columns'
UNION ALL SELECT 'clustering', TRUE, '8 numeric columns'
UNION ALL SELECT 'regression', FALSE, 'target not numeric'
UNION ALL SELECT 'classification', COUNT(DISTINCT l_returnflag) BETWEEN 2 AND 20,
                 CAST(COUNT(DISTINCT l_returnflag) AS VARCHAR) || ' distinct target values' FROM lineitem
UNION ALL SELECT 'feature_importance', FALSE, 'target not numeric'""")
def analysis_plan_lineitem(spark, sf):
    return FD.analysis_plan(t(spark, sf, "lineitem"), "l_returnflag")


@register("findings_with_models_part", "FND-1")
def findings_with_models_part(spark, sf):
    from ..operators.regress import ols
    p = t(spark, sf, "part")
    _, st = ols(p, "p_retailprice", ["p_partkey", "p_size"])
    return FD.findings(p, *FD.model_findings(regression_stats=st))


@register("findings_analyze_documents", "FND-1 FND-3")
def findings_analyze_documents(spark, sf):
    """The whole run on labelled documents: every section of the findings is filled."""
    from ..operators.analyze import analyze
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", "toxic", "lang", "source", "quality")
    return analyze(d, "quality", "doc_id", trees=10, boost_iter=5, max_k=4, restarts=1)["findings"].select("section", "metric")

"""Benchmark: headline registered queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query runs once to warm up, then three timed runs; the median wall time
is reported.  A run executes the whole plan through the ``noop`` sink (no
rows are collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabscope.plans.registry import load_all  # noqa: E402
from tabscope.session import get_spark  # noqa: E402

HEADLINE = [
    "describe_lineitem", "profile_summary_lineitem", "missing_orders_nulls", "outliers_lineitem",
    "frequency_part", "histogram_lineitem", "boxplot_lineitem", "qq_fit_lineitem",
    "pearson_lineitem", "spearman_lineitem", "ttest_lineitem", "anova_lineitem",
    "chi_square_lineitem_flags", "winsorize_lineitem_nulls", "scale_robust_lineitem_nulls",
    "split_lineitem", "kfold_lineitem", "auc_documents", "ols_coef_part", "knn_regressor_part",
    "mutual_info_orders", "page_titles", "page_links_pages_marked",
]


def run_once(spark, fn, sf):
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(shuffle_partitions=int(os.environ.get("TABSCOPE_SHUFFLE_PARTITIONS", "16")))
    reg = load_all()
    times = {}
    for name in names:
        fn = reg[name].fn
        run_once(spark, fn, sf)
        times[name] = round(statistics.median(run_once(spark, fn, sf) for _ in range(reps)), 3)
    total = round(sum(times.values()), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_median_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": os.environ.get("BENCH_CPUS", "8")}))


if __name__ == "__main__":
    main()

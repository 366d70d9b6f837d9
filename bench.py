"""Headline queries on local Spark; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the number of threads.  Each query runs once to warm up and
then BENCH_RUNS times (default 1); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from abacist import build_session
from abacist.catalog import load_all
from abacist.catalog.base import QUERIES

HEADLINE = (
    "describe_numeric", "describe_categorical", "group_summary", "histogram", "contingency", "quality_scores", "duplicate_rows",
    "normalize_zscore", "bin_quantile", "row_index", "rolling", "forward_fill", "merge_nation_region",
    "t_independent_pooled", "levene", "anova_one_way", "chi_square", "mann_whitney", "chart_heatmap", "correlation_spearman",
    "ols_multiple", "durbin_watson", "pca_variance", "acf", "auc", "regression_metrics",
    "correlation_kendall", "knn_classify", "dbscan", "isolation_forest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    taken = {}
    for name in HEADLINE:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        taken[name] = round(statistics.median(times), 3)
    spark.stop()
    total = round(sum(taken.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": taken, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

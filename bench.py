"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of three after a warm-up. Prints one JSON line;
`queries` holds whole times, `built` the part of them that building the DataFrame took."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from pulltally.samples.queries import QUERIES
from pulltally.session import configure

HEADLINE = (
    "activity_summary", "repo_counts", "monthly_counts", "recent_prs", "activity_report",
    "select_last_n", "select_largest_n", "select_last_negative", "select_last_90d",
    "diff_line_counts", "pr_metrics", "analysis_metrics", "analysis_result", "analysis_bundles",
    "bundle_documents", "api_pull_requests", "language_filter", "assessment_markdown", "merge_insights",
    "coaching_prompt",
)
RUNS = 3


def session(cpus: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("pulltally-bench")
    spark = (
        configure(builder)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Computes every row and column, without storing them."""
    df.write.format("noop").mode("overwrite").save()


def seconds(spark: SparkSession, name: str, folder: str) -> tuple[float, float]:
    """Median time of the query, planning included, once its code is compiled; and that of building the DataFrame alone."""
    times, built = [], []
    for _ in range(1 + RUNS):
        start = time.perf_counter()
        query = QUERIES[name](spark, folder)
        built.append(time.perf_counter() - start)
        run(query)
        times.append(time.perf_counter() - start)
    return round(median(times[1:]), 3), round(median(built[1:]), 3)


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {name: seconds(spark, name, folder) for name in names or HEADLINE}
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(t for t, _ in times.values()), 3),
        "unit": "sec",
        "queries": {name: t for name, (t, _) in times.items()},
        "built": {name: b for name, (_, b) in times.items()},
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

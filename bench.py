"""Times the headline queries and prints one JSON line.

Each query is built and run to a no-op sink; one warm run, then the median of the timed ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from panelmill import queries
from panelmill.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINES = [
    "bar_count", "bar_count_asc", "percent_of_all", "pie_share", "group_sum", "group_sum_largest", "group_mean", "group_median",
    "group_median_many_keys", "group_std", "group_reducers", "group_skew", "group_first_last", "line_daily", "line_simple",
    "other_type_count", "colors_of_points", "missing_values", "describe_numeric", "describe_categorical", "describe_datetime",
    "correlations", "top_values", "distinct_counts", "time_sample", "row_sample", "spec_union", "basic_dashboard",
    "dashboards_per_source", "analysis_document", "summary_document", "json_extract_reply", "owner_join", "owner_check",
    "key_conflicts", "catalog_latest", "catalog_upsert", "catalog_delete", "catalog_page", "backfill_owner", "constraint_report",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    queries.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINES
    spark = local_session("panelmill-bench", CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 4)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm, median of runs", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. Every query runs twice over its whole tables;
``queries`` holds the second time, ``cold`` the first, ``shuffle_bytes`` what the second run shuffled.
With BENCH_FILES the tables are first dealt into so many files each, as real tables are, so scans run side by side.
"""

from __future__ import annotations

import glob
import json
import os
import time

from checks.queries import QUERIES
from tabulyse.session import build_session, scratch_dir

HEADLINE = """
dataset_summary duplicate_rows column_profile column_profile_text numeric_stats deciles datetime_stats top_values top_values_text
histogram category_distribution box_plot outliers_iqr daily_counts correlation_matrix top_correlations scatter_sample what_if
preview_page preview_deep null_tokens parse_numbers parse_booleans parse_dates clean_strings normalize_table_default
csv_roundtrip sql_dump_roundtrip extract_records synth_orders_like usage_daily sessions newest_per_owner recent_history identity_link
""".split()


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def shuffled(spark) -> int:
    """Bytes all shuffles of the session have written so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def dealt(spark, sf: str, files: int) -> str:
    """The tables once more, each in so many files."""
    folder = scratch_dir(spark, "bench")
    for path in glob.glob(os.path.join(sf, "*.parquet")):
        spark.read.parquet(path).repartition(files).write.parquet(os.path.join(folder, os.path.basename(path)))
    return folder


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = build_session("bench", cpus, **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    files = int(os.environ.get("BENCH_FILES", 0))
    tables = dealt(spark, sf, files) if files else sf
    cold, warm, moved = {}, {}, {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        cold[name] = round(run(spark, name, tables), 3)
        before = shuffled(spark)
        warm[name] = round(run(spark, name, tables), 3)
        moved[name] = shuffled(spark) - before
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "shuffle_bytes": moved,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": cpus,
                "files": files or None,
            }
        )
    )


if __name__ == "__main__":
    main()

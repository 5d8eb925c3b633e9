"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default 8).
Each query runs once to warm up where it is short, and its best of two runs counts.
Results are written to Spark's no-op sink, so all columns of all rows are made.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lexispark.plans import catalog

HEADLINE = """text_block_stats text_scan text_scan_scored text_workload_mixed text_nested text_scored text_prefix_mix text_not text_term_stats text_block_search text_bitmap_and rel_project_filter join_inner_residual join_left_semi agg_basic agg_cube
agg_statistics win_rank win_rows win_groups set_intersect_all sort_limit_offset fn_string fn_date tpch_q1 tpch_q3 tpch_q5 tpch_q6 tpch_q7 tpch_q8 tpch_q10 tpch_q14 tpch_q15 tpch_q18 events_tumbling events_sessions""".split()


def session(cpus: int) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def timed(run, spark, sf: str) -> float:
    began = time.perf_counter()
    run(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    took = {}
    for name in HEADLINE:
        runs = [timed(known[name], spark, sf) for _ in range(2)]
        took[name] = round(min(runs), 3)
        print(f"{name}: {took[name]} s", file=sys.stderr)
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

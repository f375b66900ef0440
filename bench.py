"""Times the headline queries and prints one JSON line.

Every query runs once to warm up and then $BENCH_RUNS times (default 3); the best time counts.
All rows are produced and dropped by the noop sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from webposture.plans.workload import QUERIES

HEADLINE = (
    "scan_content", "scan_page", "extract_links", "resolve_links", "crawl_frontier", "robots_decision",
    "token_bucket_wait", "dns_posture", "tls_posture", "ct_subdomains", "summary",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Recording the call site of every expression takes longer than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(min(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total of the best run of each headline query",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Input tables are stored first and not timed, like files on disk. ``prepare`` is timed on
its own; the single operators start from prepared pairs, the pipeline steps from the table
the step before wrote. Every result is fully computed. Mean of RUNS runs after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from checks import registry

RUNS = 2
# query -> stored tables it starts from
QUERIES = {
    "prepare": [], "simultaneous_distance": ["prepared"], "closest_pair": ["prepared"], "pet": ["prepared"],
    "find_anchor": ["prepared"], "circle_crossing": ["prepared"], "arc_resample": ["prepared"],
    "extract_params": [], "kde_loo_grid": ["params"], "kde_bandwidth": ["params"], "sample_table": ["params", "model"],
    "sample_params": ["params"], "control_points": ["params"], "ego_replay": [], "run_log_files": ["run_files"],
}


def seconds(spark: SparkSession, sf_dir: str, name: str) -> float:
    if name == "prepare":
        registry.forget()
    for table in QUERIES[name]:
        getattr(registry, table)(spark, sf_dir)
    start = time.perf_counter()
    if name == "prepare":
        registry.prepared(spark, sf_dir)
    else:
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry.tracks(spark, sf_dir), registry.scenarios(spark, sf_dir)
    times: dict[str, float] = {}
    for name in QUERIES:
        seconds(spark, sf_dir, name)
        times[name] = round(statistics.mean(seconds(spark, sf_dir, name) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

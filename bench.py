"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the table folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query is materialised in full (noop sink) once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from murmura.plans import all_queries  # noqa: E402

HEADLINE = (
    "batch_metrics", "nearest_centroid", "silhouette", "absorb", "centroids", "fixed_batches",
    "trip_points", "parse_points", "drift_update", "drift_summary", "core_distance", "mst_edges",
    "density_cut", "offline_cluster", "micro_cluster_update", "micro_clusters",
)
ONCE = {"micro_clusters"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    queries, seconds = all_queries(), {}
    for name in wanted:
        for _ in range(1 if name in ONCE else 2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

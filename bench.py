"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_RUNS    timed runs per query, the median counts, so that the first, cold one does not (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from workbench.queries import QUERIES

HEADLINE = (
    "range_to_points", "range_to_points_top", "dense_cloud", "voxel_nearest", "first_hits", "first_hits_banded", "sparse_scan",
    "points_1f", "box_counts_inverse", "box_counts_far", "split_points", "label_lines", "history_pairs", "points_2f", "points_4f",
    "tracks_4f", "raster_height", "raster_overlap", "raster_overlap_height", "obb_training_lines", "plane_to_sensor",
    "first_hits_near", "generated_obb_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("scanmill-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

Every query runs over its whole tables. Writing the stored tables and files the
queries read (detections, nodes, raw table, facts, CSV) is timed apart, as
``inputs``; it is not part of the total. The audit fact is timed twice more, from
scratch, as ``fct_map_audit`` and inside ``audit_summary_metrics``.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from mapaudit import inputs
from mapaudit.plans.registry import QUERIES, prepare

HEADLINE = [
    "stg_perception_data", "confidence_histogram", "detections_over_time", "merge_tiles", "project_detections",
    "fct_map_audit", "audit_summary_metrics", "discrepancy_details", "dq_all_checks", "match_summary",
    "radius_join_inner", "nearest_node", "compare_bidirectional", "unique_signs", "read_detections_csv",
    "batch_csv_to_topic",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("mapaudit-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    started = time.perf_counter()
    rows = {"detections": inputs.detections(spark, sf_dir).count(), "nodes": inputs.osm_nodes(spark, sf_dir).count()}
    prepare(spark, sf_dir)
    derived = time.perf_counter() - started

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else sf_dir, "inputs": round(derived, 3), "rows": rows,
        "detections_per_sec": {n: round(rows["detections"] / s) for n, s in seconds.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()

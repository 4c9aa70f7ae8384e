"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES (names, comma-separated).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from vidlake.plans import catalog

HEADLINE = [
    "track_history", "crossline_totals", "stop_events", "stopped_now", "jam_events", "decode_yolo", "nms", "decode_face", "classify",
    "sync_merge", "sync_update", "pair_channels", "select_clips", "search_topk", "match_pairs", "json_messages", "ba_messages", "first_per_track", "latency",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # the session's own start is not timed
    seconds = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Time the headline queries: warm median of three runs each, one JSON line on stdout."""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roamlog.catalog import QUERIES  # noqa: E402
from roamlog.session import build_session  # noqa: E402
from roamlog.sources.fixtures import checkins  # noqa: E402

HEADLINE = [
    "trips", "trip_summary", "trip_checkins", "order_rows", "next_markers", "summary", "by_month", "countries", "cities",
    "city_centroids", "day_heatmap", "discovery_rate", "discovery_rate_by_user", "venue_loyalty", "venues_page",
    "top_venues", "category_groups", "category_explorer", "unique_places", "venue_heatmap", "companions", "companion_feed",
    "feed", "feed_gaps", "recent", "clean_checkins", "infer_city", "nearest_centroid", "full_merge", "duplicate_rows",
    "diff_snapshots", "rank_cities_by_user", "match_world_cities", "weather_join", "flatten_checkins", "objects_where",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "roamlog-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.sql.files.maxPartitionBytes": "1m",
            "spark.sql.files.openCostInBytes": "64k",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    start = time.perf_counter()
    checkins(spark, sf_dir)
    build_log = round(time.perf_counter() - start, 3)
    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_warm_median", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "build_log_cold": build_log,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Every query is executed in full (all rows and columns, no write); two
queries run on the smallest tables first so that JVM and Python workers are
warm."""

from __future__ import annotations

import json
import os
import sys
import time

from tapewatch.plans import detection_queries, registry  # noqa: F401  (registers its queries)
from tapewatch.session import build_session, intermediate_tables

HEADLINE = [
    "surveillance",
    "detect",
    "stream_to_tables",
    "tune_components",
    "tick_index",
    "rolling_zscore",
    "wash_lookback",
    "trailing_two_hours",
    "ohlc_bars",
    "bar_statistics",
    "nearest_bar",
    "bar_markers",
    "ticker_metrics",
    "alert_rollup",
    "recent_anomalies",
    "frame_diff",
    "completeness",
    "latency_stats",
    "log_order_report",
    "label_scores",
    "event_metrics",
    "incident_metrics",
    "threshold_sweep",
    "leave_one_ticker_out",
    "naive_tuning",
    "replay_schedule",
    "inject_anomalies",
    "evaluation_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    for name in ("surveillance", "detect"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        with intermediate_tables(spark):
            start = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    ticks = spark.read.parquet(f"{folder}/events.parquet").count()
    rates = {n: round(ticks / seconds[n], 1) for n in ("detect", "stream_to_tables") if n in seconds}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "ticks": ticks,
                "ticks_per_s": rates,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

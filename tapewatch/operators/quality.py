"""Checks on logs, tables and latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.quantiles import exact_percentiles
from tapewatch.operators.slices import Slicing, drop_halo, with_previous_rows

LOG = Slicing(width_ms=1_000_000, keys=("partition",), time="offset", tie=())


def latency_stats(
    rows: DataFrame, column: str, by: Sequence[str] = (), approximate: bool = False, digits: int = 1
) -> DataFrame:
    """n, min, p50, p95, p99, max and mean. Percentiles are exact unless
    ``approximate`` asks for the one-pass sketch."""
    by = list(by)
    x = F.col(column).cast("double")
    basic = rows.groupBy(*by).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean")
    )
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if approximate:
        marks = F.percentile_approx(x, F.array(*[F.lit(p) for p in wanted.values()]), 10_000)
        marked = rows.groupBy(*by).agg(marks.alias("_m"))
        exact = marked.select(*by, *[F.col("_m")[i].alias(k) for i, k in enumerate(wanted)])
    else:
        exact = exact_percentiles(rows, column, wanted, by).drop("n")
    if by:
        both = basic.join(exact, by)
    else:
        both = basic.withColumn("_k", F.lit(1)).join(exact.withColumn("_k", F.lit(1)), "_k").drop("_k")
    names = ["min", "p50", "p95", "p99", "max", "mean"]
    return both.select(*by, "n", *[F.round(c, digits).alias(c) for c in names])


def latency_by_phase(rows: DataFrame, column: str, time: str, down_ms: int, up_ms: int) -> DataFrame:
    """Latency before, during and after an outage ``[down_ms, up_ms)``."""
    t = F.col(time)
    phase = F.when(t < down_ms, "before").when(t < up_ms, "during").otherwise("after")
    stats = latency_stats(rows.withColumn("phase", phase), column, ["phase"])
    return stats.select("phase", F.col("n").alias("ticks"), "p50", "p95", "p99", "max")


def throughput(rows: DataFrame, time_ms: str) -> DataFrame:
    """Rows per second between the first and last value of a time column;
    null when no time passed."""
    span = (F.max(time_ms) - F.min(time_ms)) / 1000.0
    return rows.agg(F.count("*").alias("rows"), span.alias("span_s")).withColumn(
        "rows_per_s", F.round(F.try_divide(F.col("rows").cast("double"), F.col("span_s")), 1)
    )


def partition_sizes(table: DataFrame) -> DataFrame:
    """Rows per (ticker, day) partition, largest first."""
    return table.groupBy("ticker", "day").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "ticker", "day")


def partition_consistency(log: DataFrame) -> DataFrame:
    """Keys that appear on more than one partition (none when all is well)."""
    return (
        log.select("key", "partition").distinct().groupBy("key").agg(F.count("*").alias("partitions"))
        .filter(F.col("partitions") > 1)
    )


def with_order_violation(log: DataFrame, s: Slicing = LOG) -> DataFrame:
    """Marks messages older than the one before them in their partition. Log
    records need partition, offset and event_time_ms."""
    halo = with_previous_rows(log, 1, s, ["event_time_ms"])
    before = F.lag("event_time_ms").over(s.window())
    marked = halo.withColumn("violation", F.coalesce(F.col("event_time_ms") < before, F.lit(False)))
    return drop_halo(marked).drop("slice_id")


def order_report(log: DataFrame, s: Slicing = LOG) -> DataFrame:
    """Per partition: keys, messages, newest event time, order violations."""
    totals = with_order_violation(log, s).groupBy("partition").agg(
        F.count("*").alias("messages"),
        F.max("event_time_ms").alias("newest_ms"),
        F.count_if("violation").alias("violations"),
    )
    keys = log.select("partition", "key").distinct().groupBy("partition").agg(F.count("*").alias("keys"))
    return totals.join(keys, "partition")


def topic_message_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("messages"))


def session_sigma(indexed_ticks: DataFrame, population: bool = False, floor: float = 1e-4) -> DataFrame:
    """Deviation of price differences per session, with a floor (needs
    ``price_diff`` and ``session_id``)."""
    sd = F.stddev_pop("price_diff") if population else F.stddev_samp("price_diff")
    return indexed_ticks.groupBy("ticker", "session_id").agg(
        F.greatest(F.coalesce(sd, F.lit(floor)), F.lit(floor)).alias("sigma")
    )

"""Tick-shaped views of the test tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.session import ensure_utc


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as labelled ticks: the event type is the ticker, the event id
    the arrival order."""
    ensure_utc(spark)
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.select(
        F.col("event_type").alias("ticker"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"),
        (100 + F.col("value") / 1000).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"),
        F.when(F.col("event_id") % 97 == 0, "price_shock")
        .when(F.col("event_id") % 89 == 0, "wash_trade")
        .otherwise("normal")
        .alias("label"),
        F.col("event_id").alias("arrival"),
    )


TICKS_SQL = """ticks AS (
  SELECT event_type AS ticker, epoch_us(ts) // 1000 AS event_time_ms, 100 + value / 1000 AS price,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) + 1 AS volume,
         CASE WHEN event_id % 97 = 0 THEN 'price_shock' WHEN event_id % 89 = 0 THEN 'wash_trade' ELSE 'normal' END AS label,
         event_id AS arrival
  FROM events)"""


def indexed_sql(gap_ms: int) -> str:
    """CTEs ``ticks`` and ``idx`` (pos, gap_ms, session_id, price_diff, ms_seq, tick_id)."""
    return f"""{TICKS_SQL},
lagged AS (
  SELECT *, row_number() OVER w - 1 AS pos, event_time_ms - lag(event_time_ms) OVER w AS gap_ms,
         price - lag(price) OVER w AS raw_diff
  FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY event_time_ms, arrival)),
idx AS (
  SELECT ticker, event_time_ms, price, volume, label, arrival, pos, gap_ms,
         CASE WHEN gap_ms > {gap_ms} THEN NULL ELSE raw_diff END AS price_diff,
         CAST(sum(CASE WHEN gap_ms > {gap_ms} THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival) AS BIGINT) AS session_id,
         row_number() OVER (PARTITION BY ticker, event_time_ms ORDER BY arrival) - 1 AS ms_seq,
         concat_ws('-', ticker, event_time_ms, row_number() OVER (PARTITION BY ticker, event_time_ms ORDER BY arrival) - 1) AS tick_id
  FROM lagged)"""


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as scored rows in the stored layout; labelled events are the
    flagged ones, a third of them without an incident id or a risk score."""
    ensure_utc(spark)
    e = spark.read.parquet(f"{folder}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    label = (
        F.when(F.col("event_id") % 7 == 0, "price_shock").when(F.col("event_id") % 11 == 0, "wash_trade")
    )
    gone = F.col("event_id") % 3 == 0
    return e.select(
        F.col("event_type").alias("ticker"),
        F.timestamp_millis(ms).alias("event_time"),
        ms.alias("event_time_ms"),
        F.to_date(F.timestamp_millis(ms)).alias("day"),
        F.concat_ws("-", "event_type", ms, F.lit("0")).alias("tick_id"),
        (100 + F.col("value") / 1000).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"),
        ((F.col("value") - 50) / 25).alias("zscore"),
        (F.col("value") / 5000).alias("vwap_divergence"),
        label.isNotNull().alias("is_anomaly"),
        label.alias("anomaly_type"),
        F.lit(0.0).alias("ewma_divergence"),
        F.lit(0.0).alias("cusum_price"),
        F.lit(0.0).alias("cusum_volume"),
        F.when(~gone, F.col("value") / 40).alias("risk_score"),
        F.when(label.isNotNull() & ~gone, F.when(label == "wash_trade", "wash_rule").otherwise("zscore,vwap")).alias("signals"),
        F.when(
            label.isNotNull() & ~gone, F.concat_ws("-", F.col("event_type"), F.floor(ms / 7_200_000) * 7_200_000)
        ).alias("incident_id"),
    )


ANOMALIES_SQL = """scored AS (
  SELECT event_type AS ticker, epoch_us(ts) // 1000 AS event_time_ms, CAST(ts AS DATE) AS day,
         concat_ws('-', event_type, epoch_us(ts) // 1000, '0') AS tick_id,
         100 + value / 1000 AS price, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) + 1 AS volume,
         (value - 50) / 25 AS zscore, value / 5000 AS vwap_divergence,
         (event_id % 7 = 0 OR event_id % 11 = 0) AS is_anomaly,
         CASE WHEN event_id % 7 = 0 THEN 'price_shock' WHEN event_id % 11 = 0 THEN 'wash_trade' END AS anomaly_type,
         CASE WHEN event_id % 3 <> 0 THEN value / 40 END AS risk_score,
         CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'zscore,vwap' WHEN event_id % 11 = 0 THEN 'wash_rule' END AS signals,
         CASE WHEN event_id % 3 <> 0 AND (event_id % 7 = 0 OR event_id % 11 = 0)
              THEN concat_ws('-', event_type, epoch_us(ts) // 1000 // 7200000 * 7200000) END AS incident_id,
         event_id
  FROM events)"""


def log_records(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as log records; every 13th carries a time an hour too early."""
    ensure_utc(spark)
    e = spark.read.parquet(f"{folder}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        (F.col("user_id") % 4).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("event_type").alias("key"),
        (ms - F.when(F.col("event_id") % 13 == 0, 3_600_000).otherwise(0)).alias("event_time_ms"),
    )


LOG_SQL = """log AS (
  SELECT user_id % 4 AS "partition", event_id AS "offset", event_type AS key,
         epoch_us(ts) // 1000 - CASE WHEN event_id % 13 = 0 THEN 3600000 ELSE 0 END AS event_time_ms
  FROM events)"""

"""Alerts rolled up from stored anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.columns import alert_message, finite, severity, text
from tapewatch.operators.signals import group_start
from tapewatch.operators.slices import SLICE, Slicing, drop_halo, with_previous_rows
from tapewatch.operators.ticks import TICKS
from tapewatch.params import AlertConfig


def alert_id(ticker: Column, key: Column, start_ms: Column) -> Column:
    """Stable id of a burst: the same rows always give the same id."""
    return F.md5(F.concat_ws("|", ticker, key, start_ms))


def normalised_events(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Anomaly rows with every field an alert needs, sanitised."""
    kind = F.nullif(text("anomaly_type"), F.lit(""))
    return rows.select(
        *keep,
        "ticker",
        F.unix_millis("event_time").alias("event_time_ms"),
        F.coalesce(kind, F.lit("price_shock")).alias("anomaly_type"),
        *[finite(c).alias(c) for c in ("price", "volume", "zscore", "vwap_divergence", "risk_score")],
        text("signals").alias("signals"),
        F.nullif(text("incident_id"), F.lit("")).alias("incident_id"),
        F.nullif(text("tick_id"), F.lit("")).alias("tick_id"),
    )


def _legacy_groups(rows: DataFrame, gap_ms: int, s: Slicing) -> DataFrame:
    """Rows without an incident id, grouped by type while pauses stay short."""
    line = s.by(keys=("ticker", "anomaly_type"), tie=("tick_id",))
    halo = with_previous_rows(rows, 1, line, [])
    w = line.window()
    opens = F.coalesce(F.col(line.time) - F.lag(line.time).over(w) > gap_ms, F.lit(True))
    marked = drop_halo(halo.withColumn("_opens", opens))
    return group_start(marked, "_opens", line).withColumn(
        "_key", F.concat_ws("@", "anomaly_type", "_start_ms")
    ).drop("_start_ms", SLICE)


def alerts_batch(rows: DataFrame, cfg: AlertConfig = AlertConfig(), s: Slicing = TICKS) -> DataFrame:
    """One alert per (ticker, incident): times, tick count, volume, peaks, the
    signals at peak risk and the severity (critical as soon as one tick is,
    otherwise that of the first tick)."""
    events = normalised_events(rows)
    known = events.filter(F.col("incident_id").isNotNull()).withColumn("_key", F.col("incident_id"))
    legacy = _legacy_groups(events.filter(F.col("incident_id").isNull()), cfg.burst_window_ms, s)
    level = severity("zscore", "vwap_divergence", "anomaly_type", "risk_score", cfg)
    both = known.unionByName(legacy).withColumn("_level", level)
    at = F.struct("event_time_ms", "tick_id")
    early = -F.col("event_time_ms")

    def peak(column: str, size: Column) -> Column:
        return F.max_by(column, F.struct(size, early))

    grouped = both.groupBy("ticker", "_key").agg(
        F.when(F.bool_or(F.col("_level") == "CRITICAL"), "CRITICAL")
        .otherwise(F.min_by("_level", at))
        .alias("severity"),
        F.min_by("anomaly_type", at).alias("anomaly_type"),
        F.min("event_time_ms").alias("start_ms"),
        F.max("event_time_ms").alias("end_ms"),
        F.max_by("price", at).alias("last_price"),
        peak("zscore", F.abs("zscore")).alias("peak_zscore"),
        peak("vwap_divergence", F.abs("vwap_divergence")).alias("peak_vwap_div"),
        F.sum("volume").alias("total_volume"),
        F.count("*").alias("tick_count"),
        F.max("risk_score").alias("peak_risk_score"),
        peak("signals", F.col("risk_score")).alias("signals"),
        peak("tick_id", F.col("risk_score")).alias("tick_id"),
        F.first("incident_id").alias("incident_id"),
    )
    return grouped.select(
        alert_id(F.col("ticker"), F.coalesce("incident_id", "anomaly_type"), F.col("start_ms")).alias("alert_id"),
        "ticker",
        "severity",
        "anomaly_type",
        F.timestamp_millis("start_ms").alias("start_time"),
        F.timestamp_millis("end_ms").alias("end_time"),
        F.col("last_price").alias("peak_price"),
        "last_price",
        "peak_zscore",
        "peak_vwap_div",
        "total_volume",
        "tick_count",
        alert_message(
            "ticker", "severity", "anomaly_type", "last_price", "peak_zscore", "peak_vwap_div",
            "peak_risk_score", "signals", "tick_count",
        ).alias("message"),
        "peak_risk_score",
        "signals",
        "incident_id",
        "tick_id",
    )

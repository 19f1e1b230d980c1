"""Bars that follow the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bars(ticks: DataFrame, width: str = "30 seconds", late: str = "1 minute", tie: str | None = "arrival") -> DataFrame:
    """Tumbling OHLC bars of a tick stream with ``event_time``."""
    order = F.struct("event_time_ms", tie) if tie and tie in ticks.columns else F.struct("event_time_ms", "price")
    bars = (
        ticks.withWatermark("event_time", late)
        .groupBy("ticker", F.window("event_time", width))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("volume").alias("volume"),
        )
    )
    return bars.select(
        "ticker", F.unix_millis("window.start").alias("bar_ms"), "open", "high", "low", "close", "volume",
        F.col("window.start").alias("bar_start"),
    )

"""Desk questions over stored anomalies: look-backs, newest rows, metrics."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime, timedelta
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.columns import (
    asset_status,
    case_id,
    desk_status,
    finite,
    legacy_risk,
    regulatory_rule,
    severity,
    text,
)
from tapewatch.operators.bars import price_change
from tapewatch.params import AlertConfig


def flagged(scored: DataFrame) -> DataFrame:
    return scored.filter("is_anomaly")


def scan_partitions(table: DataFrame, tickers: Iterable[str], start: datetime, end: datetime) -> DataFrame:
    """Rows of some tickers in ``[start, end]``. The day range is stated next
    to the time range, so only the touched (ticker, day) folders are read."""
    lo, hi = F.lit(start), F.lit(end)
    return table.filter(
        F.col("ticker").isin(list(tickers))
        & F.col("day").between(F.to_date(lo), F.to_date(hi))
        & F.col("event_time").between(lo, hi)
    )


def partition_days(table: DataFrame) -> dict[str, list[date]]:
    """Days per ticker, newest first, of a stored table: from the listing of
    its files, which Spark has at hand, without opening one."""
    days: dict[str, set[date]] = {}
    for path in table.inputFiles():
        found = re.search(r"/ticker=([^/]*)/day=([^/]*)/", path)
        if found is None:
            raise ValueError("the table is not partitioned by ticker and day")
        # once for the URI, once for the escapes of partition values
        ticker, day = (unquote(unquote(x)) for x in found.groups())
        days.setdefault(ticker, set()).add(date.fromisoformat(day))
    return {t: sorted(d, reverse=True) for t, d in days.items()}


def _of_days(table: DataFrame, wanted: dict[str, set[date]]) -> DataFrame:
    """Rows of some (ticker, day) partitions, stated as constants. Tickers that
    want the same days share a condition."""
    by_days: dict[tuple[date, ...], list[str]] = {}
    for ticker, days in wanted.items():
        by_days.setdefault(tuple(sorted(days)), []).append(ticker)
    parts = [F.col("ticker").isin(tickers) & F.col("day").isin(list(days)) for days, tickers in by_days.items()]
    return table.filter(reduce(Column.__or__, parts, F.lit(False)))


def _newest_before(table: DataFrame, days: dict[str, list[date]], end: datetime) -> dict[str, datetime]:
    """Each ticker's newest event up to ``end``, looking at its newest day
    first and at an older one only where that day starts after ``end``."""
    left, found = {t: list(d) for t, d in days.items()}, {}
    while left := {t: d for t, d in left.items() if d and t not in found}:
        day = _of_days(table, {t: {d.pop(0)} for t, d in left.items()})
        newest = day.filter(F.col("event_time") <= F.lit(end)).groupBy("ticker").agg(F.max("event_time").alias("at"))
        # one row per ticker; seconds, so that no clock of this process matters
        found |= {r["ticker"]: r["at"] for r in newest.select("ticker", F.unix_micros("at").alias("at")).collect()}
    return found


def lookback(table: DataFrame, now: datetime, minutes: float, fallback: bool = True) -> DataFrame:
    """Rows of the last ``minutes`` of a table stored by (ticker, day). A
    ticker without any falls back to the minutes before its newest row.

    Only days of the look-back are read; for an empty ticker its newest day is
    known from the listing, and that day and those its minutes reach back into
    are read as well."""
    start = now - timedelta(minutes=minutes)
    in_days = F.col("day").between(F.lit(start.date()), F.lit(now.date()))
    recent = table.filter(in_days & F.col("event_time").between(F.lit(start), F.lit(now)))
    if not fallback:
        return recent
    seen = {r["ticker"] for r in recent.select("ticker").distinct().collect()}
    days = {t: [x for x in d if x <= now.date()] for t, d in partition_days(table).items() if t not in seen}
    newest = _newest_before(table, days, now)
    if not newest:
        return recent
    span = round(minutes * 60_000_000)
    utc = {t: (_utc(at - span), _utc(at)) for t, at in newest.items()}
    wanted = {t: {d for d in days[t] if lo.date() <= d <= hi.date()} for t, (lo, hi) in utc.items()}
    edges = table.sparkSession.createDataFrame([(t, at - span, at) for t, at in newest.items()], "ticker string, _lo long, _hi long")
    older = _of_days(table, wanted).join(edges, "ticker")
    inside = F.unix_micros("event_time").between(F.col("_lo"), F.col("_hi"))
    return recent.unionByName(older.filter(inside).select(*table.columns))


def _utc(micros: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def newest_rows(rows: DataFrame, limit: int, tie: str = "tick_id") -> DataFrame:
    """The newest ``limit`` rows per ticker, then overall, newest first. A
    hot ticker is cut down in every map task before the shuffle."""
    w = Window.partitionBy("ticker").orderBy(F.desc("event_time"), F.desc(tie))
    per_ticker = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
    return per_ticker.orderBy(F.desc("event_time"), F.desc(tie), "ticker").limit(limit)


def recent_anomalies(
    rows: DataFrame, now: datetime, minutes: float = 15, ticker: str | None = None, limit: int = 200
) -> DataFrame:
    """Newest anomalies of the look-back with sanitised numbers."""
    if ticker is not None:
        rows = rows.filter(F.col("ticker") == ticker)
    found = newest_rows(lookback(rows, now, minutes), limit)
    numbers = ["price", "volume", "zscore", "vwap_divergence", "ewma_divergence", "cusum_price", "cusum_volume"]
    return found.withColumn("risk_score", legacy_risk("risk_score", "zscore", "vwap_divergence")).withColumns(
        {c: finite(c) for c in numbers if c in found.columns}
    )


def latest_event(table: DataFrame) -> DataFrame:
    """Newest event per ticker of a stored table: the newest day comes from the
    listing, then only rows of that day are read."""
    newest = {t: {d[0]} for t, d in partition_days(table).items()}
    return _of_days(table, newest).groupBy("ticker").agg(F.max("event_time").alias("latest_event"))


def lookback_metrics(anomalies: DataFrame, bars: DataFrame, now: datetime, minutes: float, tickers: DataFrame) -> DataFrame:
    """Ticker metrics over the look-back of the stored anomalies and the bars
    (``bar_time``) of the same minutes."""
    recent = F.col("bar_time").between(F.lit(now - timedelta(minutes=minutes)), F.lit(now))
    return ticker_metrics(lookback(anomalies, now, minutes), bars.filter(recent), tickers)


def desk_filter(
    rows: DataFrame,
    anomaly_type: str | None = None,
    level: str | None = None,
    min_z: float = 0.0,
    min_risk: float = 0.0,
    cfg: AlertConfig = AlertConfig(),
) -> DataFrame:
    """Rows with their severity, kept by type, severity, |z| and risk."""
    out = rows.withColumn("severity", severity("zscore", "vwap_divergence", "anomaly_type", "risk_score", cfg))
    if anomaly_type:
        out = out.filter(F.col("anomaly_type") == anomaly_type)
    if level:
        out = out.filter(F.col("severity") == level)
    if min_z > 0:
        out = out.filter(F.abs("zscore") >= min_z)
    if min_risk > 0:
        out = out.filter(F.col("risk_score") >= min_risk)
    return out


def kpis(rows: DataFrame) -> DataFrame:
    """One row of totals over rows with ``severity``."""
    return rows.agg(
        F.count("*").alias("total_flags"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_flags"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_flags"),
        F.count_if(F.col("anomaly_type") == "price_shock").alias("price_shocks"),
        F.count_if(F.col("anomaly_type") == "wash_trade").alias("wash_trades"),
        F.coalesce(F.max(F.abs("zscore")), F.lit(0.0)).alias("peak_zscore"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("peak_risk"),
    )


def ticker_metrics(anomalies: DataFrame, bars: DataFrame, tickers: DataFrame) -> DataFrame:
    """One row per monitored ticker (``tickers`` has a ticker column), zeros
    where there is nothing."""
    counts = anomalies.groupBy("ticker").agg(
        F.count("*").alias("anomaly_count"),
        F.count_if(F.col("anomaly_type") == "price_shock").alias("price_shocks"),
        F.count_if(F.col("anomaly_type") == "wash_trade").alias("wash_trades"),
        F.max(F.abs("zscore")).alias("max_zscore"),
        F.max("risk_score").alias("max_risk_score"),
        F.max("event_time").alias("latest_event_time"),
    )
    # distinct incidents separately: its two-step plan spreads a hot ticker
    incidents = (
        anomalies.filter(F.col("incident_id").isNotNull())
        .select("ticker", "incident_id")
        .distinct()
        .groupBy("ticker")
        .agg(F.count("*").alias("incident_count"))
    )
    moves = price_change(bars).select("ticker", F.col("last_close").alias("latest_price"), "pct_change")
    out = tickers.join(counts, "ticker", "left").join(incidents, "ticker", "left").join(moves, "ticker", "left")
    zeros = ["anomaly_count", "price_shocks", "wash_trades", "max_zscore", "max_risk_score", "incident_count",
             "latest_price", "pct_change"]
    return out.fillna(0, subset=zeros)


def with_asset_status(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("status", asset_status("max_risk_score", "max_zscore", "wash_trades"))


def audit_view(rows: DataFrame, cfg: AlertConfig = AlertConfig(), keep: Iterable[str] = ()) -> DataFrame:
    """The exportable audit log of anomaly rows, with the columns ``keep``."""
    level = severity("zscore", "vwap_divergence", "anomaly_type", "risk_score", cfg)
    return rows.select(
        case_id("incident_id", "ticker", "event_time").alias("case_id"),
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("time_utc"),
        "ticker",
        desk_status(level).alias("desk_status"),
        regulatory_rule("anomaly_type").alias("regulatory_rule"),
        F.format_string("$%.2f", "price").alias("price_text"),
        F.format_string("%,d", F.col("volume").cast("long")).alias("volume_text"),
        F.format_string("%.2f", "risk_score").alias("risk_text"),
        F.coalesce("signals", F.lit("legacy")).alias("signals"),
        F.format_string("%+.2f", finite("zscore")).alias("zscore_text"),
        F.format_string("%.2f%%", finite("vwap_divergence") * 100).alias("vwap_text"),
        *keep,
    )


def recent_alerts(alerts: DataFrame, k: int = 50, time: str = "created_at") -> DataFrame:
    """The last k alerts, newest first."""
    return alerts.orderBy(F.desc(time), F.desc("alert_id")).limit(k)

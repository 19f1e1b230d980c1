"""Seen-event removal and alert debouncing as streaming operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tapewatch.functions.columns import alert_message, severity
from tapewatch.operators.alerts import normalised_events
from tapewatch.params import AlertConfig
from tapewatch.schemas import ALERT, ALERT_STATE
from tapewatch.session import ensure_state_store

ALERT_FIELDS = ALERT_STATE.fieldNames()


def with_event_key(events: DataFrame) -> DataFrame:
    """``event_key``: the tick id, else ticker and time."""
    known = F.nullif(F.coalesce("tick_id", F.lit("")), F.lit(""))
    return events.withColumn("event_key", F.coalesce(known, F.concat_ws(":", "ticker", F.unix_millis("event_time"))))


def dedupe_events(events: DataFrame, late: str = "1 minute", time: str = "event_time") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return with_event_key(events).withWatermark(time, late).dropDuplicatesWithinWatermark(["event_key"])


# What the debouncer emits: an alert without its text, which is written from
# these columns afterwards, and the type the text is about.
BURST = StructType([f for f in ALERT.fields if f.name != "message"] + [StructField("text_type", StringType())])


class Debouncer(StatefulProcessor):
    """One burst of flags per key (ticker, incident or type).

    The first flag opens a burst and alerts. Later flags are absorbed; only the
    first critical one alerts again. A burst closes after a silence, seen by an
    event-time timer, and a new one of the same key stays silent until the
    cooldown since the last alert is over."""

    def __init__(self, cfg: AlertConfig):
        self._cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("burst", ALERT_STATE)

    def _load(self) -> dict:
        if self._state.exists():
            return dict(zip(ALERT_FIELDS, self._state.get()))
        return {**dict.fromkeys(ALERT_FIELDS), "burst_open": False}

    def _row(self, ticker: str, incident: str | None, burst: dict, event: str, text_type: str | None = None) -> dict:
        return {
            "alert_id": burst["alert_id"],
            "ticker": ticker,
            "severity": burst["severity"],
            "anomaly_type": burst["anomaly_type"],
            "start_time": pd.Timestamp(burst["start_ms"], unit="ms", tz="UTC"),
            "end_time": pd.Timestamp(burst["end_ms"], unit="ms", tz="UTC"),
            "peak_price": burst["last_price"],
            "last_price": burst["last_price"],
            "peak_zscore": burst["peak_zscore"],
            "peak_vwap_div": burst["peak_vwap_div"],
            "total_volume": burst["total_volume"],
            "tick_count": burst["tick_count"],
            "peak_risk_score": burst["peak_risk_score"],
            "signals": burst["signals"],
            "incident_id": incident,
            "tick_id": burst["tick_id"],
            "event": event,
            "text_type": text_type or burst["anomaly_type"],
        }

    def _absorb(self, b: dict, e) -> bool:
        """Adds a flag to the open burst; True when it escalates."""
        b["end_ms"], b["last_price"] = int(e.event_time_ms), float(e.price)
        b["tick_count"] += 1
        b["total_volume"] += float(e.volume)
        for field, value in (("peak_zscore", e.zscore), ("peak_vwap_div", e.vwap_divergence)):
            if abs(value) > abs(b[field]):
                b[field] = float(value)
        if e.risk_score > b["peak_risk_score"]:
            b.update(peak_risk_score=float(e.risk_score), signals=e.signals, tick_id=e.tick_id)
        if b["severity"] == "CRITICAL" or e.severity != "CRITICAL":
            return False
        b["severity"] = "CRITICAL"
        return True

    def _open(self, ticker: str, burst_key: str, e) -> dict:
        start = int(e.event_time_ms)
        return {
            "burst_open": True,
            "alert_id": hashlib.md5(f"{ticker}|{burst_key}|{start}".encode()).hexdigest(),
            "severity": e.severity,
            "anomaly_type": e.anomaly_type,
            "start_ms": start,
            "end_ms": start,
            "last_price": float(e.price),
            "peak_zscore": float(e.zscore),
            "peak_vwap_div": float(e.vwap_divergence),
            "total_volume": float(e.volume),
            "tick_count": 1,
            "peak_risk_score": float(e.risk_score),
            "signals": e.signals,
            "tick_id": e.tick_id,
            "last_alert_ms": start,
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticker, burst_key = key
        events = pd.concat(list(rows), ignore_index=True).sort_values(["event_time_ms", "tick_id"], kind="stable")
        events = events.astype(object).where(events.notna(), None)
        b, cfg, out = self._load(), self._cfg, []
        incident = None
        for e in events.itertuples(index=False):
            incident = e.incident_id
            if b["burst_open"]:
                pause = e.event_time_ms - b["end_ms"]
                silent = pause > cfg.burst_window_ms
                if incident or 0 <= pause <= cfg.burst_window_ms:
                    if self._absorb(b, e):
                        out.append(self._row(ticker, incident, b, "escalated", e.anomaly_type))
                    continue
                if silent:
                    out.append(self._row(ticker, incident, b, "closed"))
                    b["burst_open"] = False
            last = b["last_alert_ms"]
            if last is not None and 0 <= e.event_time_ms - last < cfg.cooldown_ms:
                continue
            b = self._open(ticker, burst_key, e)
            out.append(self._row(ticker, incident, b, "opened"))
        self._state.update(tuple(b[k] for k in ALERT_FIELDS))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        # a state that stays always has a timer: the end of the silence, or of
        # the cooldown and all that may still arrive before it
        if b["burst_open"]:
            self._handle.registerTimer(b["end_ms"] + cfg.burst_window_ms)
        else:
            self._handle.registerTimer(b["last_alert_ms"] + cfg.cooldown_ms + cfg.burst_window_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = self._load()
        if b["burst_open"]:
            incident = key[1] if key[1] != b["anomaly_type"] else None
            yield pd.DataFrame([self._row(key[0], incident, b, "closed")])
            b["burst_open"] = False
            self._state.update(tuple(b[k] for k in ALERT_FIELDS))
            self._handle.registerTimer(b["last_alert_ms"] + self._cfg.cooldown_ms + self._cfg.burst_window_ms)
        else:
            self._state.clear()  # cooldown is over too: nothing left to remember

    def close(self) -> None:
        pass


def alerts_stream(events: DataFrame, cfg: AlertConfig = AlertConfig(), late: str | None = "1 minute") -> DataFrame:
    """Alerts from a stream of anomaly rows with ``event_time``. ``event`` tells
    what happened: opened, escalated or closed. Pass ``late=None`` when the
    input already has a watermark (``dedupe_events``)."""
    ensure_state_store(events.sparkSession)
    if late is not None:
        events = events.withWatermark("event_time", late)
    rows = normalised_events(events, keep=["event_time"])
    keyed = rows.withColumn(
        "severity", severity("zscore", "vwap_divergence", "anomaly_type", "risk_score", cfg)
    ).withColumn("burst_key", F.coalesce("incident_id", "anomaly_type"))
    bursts = keyed.groupBy("ticker", "burst_key").transformWithStateInPandas(
        statefulProcessor=Debouncer(cfg),
        outputStructType=BURST,
        outputMode="Append",
        timeMode="EventTime",
    )
    message = alert_message(
        "ticker", "severity", "text_type", "last_price", "peak_zscore", "peak_vwap_div", "peak_risk_score", "signals",
        "tick_count",
    )
    return bursts.withColumn("message", message).select(*ALERT.fieldNames())

"""Alert rules: severity, bursts, cooldown, incidents, rollup."""

from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.functions import columns as fn
from tapewatch.operators.alerts import alerts_batch
from tapewatch.operators.desk import audit_view, recent_alerts
from tapewatch.params import AlertConfig
from tapewatch.schemas import ANOMALIES
from tapewatch.streaming.alerts import Debouncer, alerts_stream, dedupe_events
from tapewatch.streaming.sinks import alert_log_batch

T0 = datetime(2026, 9, 16, 14, 30, tzinfo=timezone.utc)
SHORT = AlertConfig(burst_window_ms=5_000, cooldown_ms=15_000)


@pytest.mark.parametrize("z, v, kind, risk, want", [
    (5.0, 0.0, "price_shock", 0.0, "CRITICAL"),
    (0.0, 0.06, "price_shock", 0.0, "CRITICAL"),
    (3.5, 0.0, "price_shock", 0.0, "WARNING"),
    (-3.0, 0.03, "price_shock", 0.0, "WARNING"),
    (0.5, 0.0, "wash_trade", 0.0, "WARNING"),
    (1.0, 0.001, "price_shock", 0.5, "INFO"),
    (1.0, 0.0, "price_shock", 1.2, "WARNING"),
    (1.0, 0.0, None, 2.0, "CRITICAL"),
])
def test_severity(spark, z, v, kind, risk, want):
    df = spark.createDataFrame([(z, v, kind, risk)], "z double, v double, k string, r double")
    assert df.select(fn.severity("z", "v", "k", "r")).first()[0] == want


def test_sanitising(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "s string")
    assert [r[0] for r in df.select(fn.finite("s", -1.0)).collect()] == [1.5, -1.0, -1.0, -1.0, -1.0]
    assert [r[0] for r in df.select(fn.text("s")).collect()] == ["1.5", "x", "NaN", "Infinity", ""]


def event(ticker, seconds, kind="price_shock", z=0.0, v=0.0, risk=0.0, incident=None, price=100.0, volume=10.0, n=0):
    return dict(
        ticker=ticker, day=T0.date(), event_time=T0 + timedelta(seconds=seconds), tick_id=f"{ticker}-{seconds}-{n}", price=price,
        volume=volume, zscore=z, vwap_divergence=v, is_anomaly=True, anomaly_type=kind, ewma_divergence=None,
        cusum_price=None, cusum_volume=None, risk_score=risk, signals="zscore", incident_id=incident,
    )


class Handle:
    """What a processor needs of Spark's handle, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return sorted(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Desk:
    """Feeds events one by one, each key with its own state."""

    def __init__(self, cfg):
        self.cfg, self.keys = cfg, {}

    def _for(self, key):
        if key not in self.keys:
            p, h = Debouncer(self.cfg), Handle()
            p.init(h)
            self.keys[key] = (p, h)
        return self.keys[key]

    def send(self, spark, **e):
        from tapewatch.operators.alerts import normalised_events

        df = normalised_events(spark.createDataFrame([tuple(e[c] for c in ANOMALIES.fieldNames())], ANOMALIES))
        df = df.withColumn("severity", fn.severity("zscore", "vwap_divergence", "anomaly_type", "risk_score", self.cfg))
        pdf = df.toPandas()
        key = (e["ticker"], e["incident_id"] or e["anomaly_type"])
        p, _ = self._for(key)
        out = [r for f in p.handleInputRows(key, iter([pdf]), None) for r in f.to_dict("records")]
        return [r for r in out if r["event"] != "closed"]

    def flush(self, seconds):
        now = int((T0 + timedelta(seconds=seconds)).timestamp() * 1000)
        out = []
        for key, (p, h) in self.keys.items():
            for t in [t for t in h.listTimers() if t < now]:
                h.deleteTimer(t)
                out += [r for f in p.handleExpiredTimer(key, None, None) for r in f.to_dict("records")]
        return out


def test_burst_absorbs_and_escalates_once(spark):
    d = Desk(SHORT)
    (a,) = d.send(spark, **event("AAPL", 0, z=3.2))
    assert a["severity"] == "WARNING" and a["tick_count"] == 1
    assert d.send(spark, **event("AAPL", 2, z=3.4)) == []
    (b,) = d.send(spark, **event("AAPL", 4, z=4.8, v=0.055, price=101.0))
    assert b["severity"] == "CRITICAL" and b["event"] == "escalated" and b["tick_count"] == 3
    assert b["peak_zscore"] == 4.8 and b["alert_id"] == a["alert_id"] and b["last_price"] == 101.0
    assert d.send(spark, **event("AAPL", 5, z=9.0)) == []


def test_cooldown_after_a_burst(spark):
    d = Desk(SHORT)
    assert len(d.send(spark, **event("TSLA", 0, kind="wash_trade"))) == 1
    (closed,) = d.flush(6)
    assert closed["event"] == "closed" and closed["incident_id"] is None
    assert d.send(spark, **event("TSLA", 10, kind="wash_trade")) == []
    assert len(d.send(spark, **event("TSLA", 25, kind="wash_trade"))) == 1


def test_incident_ids_group_and_separate(spark):
    d = Desk(SHORT)
    assert len(d.send(spark, **event("MSFT", 0, risk=1.25, incident="MSFT-1000"))) == 1
    (b,) = d.send(spark, **event("MSFT", 8, risk=2.4, incident="MSFT-1000"))
    assert b["event"] == "escalated" and b["tick_count"] == 2 and b["peak_risk_score"] == 2.4
    (c,) = d.send(spark, **event("MSFT", 9, risk=1.1, incident="MSFT-10000"))
    assert c["event"] == "opened" and c["incident_id"] == "MSFT-10000"


def test_state_goes_once_nothing_needs_it(spark):
    d = Desk(SHORT)
    d.send(spark, **event("A", 0, z=3.2))
    assert len(d.flush(6)) == 1
    assert d.flush(100) == []
    assert d.keys[("A", "price_shock")][1].value is None


@pytest.mark.parametrize("later", [20, 45])
def test_state_goes_after_a_flag_that_stays_silent(spark, later):
    """A flag after the silence but within the cooldown closes the burst and
    opens none; the state must not stay for ever."""
    d = Desk(AlertConfig(burst_window_ms=10_000, cooldown_ms=60_000))
    d.send(spark, **event("A", 0, z=3.2))
    if later == 45:
        assert [x["event"] for x in d.flush(12)] == ["closed"]
    d.send(spark, **event("A", later, z=3.2))
    assert d.keys[("A", "price_shock")][1].value is not None and d.keys[("A", "price_shock")][1].timers
    d.flush(1000)
    assert d.keys[("A", "price_shock")][1].value is None


def test_rollup(spark):
    rows = [
        event("A", 0, z=3.2, incident="A-1", price=100.0, risk=1.1),
        event("A", 60, z=-5.0, incident="A-1", price=103.0, risk=2.5),
        event("A", 61, kind="wash_trade", risk=1.2), event("A", 65, kind="wash_trade", risk=1.5), event("A", 80, kind="wash_trade", risk=1.1),
    ]
    df = spark.createDataFrame([tuple(e[c] for c in ANOMALIES.fieldNames()) for e in rows], ANOMALIES)
    got = {(r["incident_id"], r["start_time"].second): r for r in alerts_batch(df).collect()}
    assert len(got) == 3
    a = got[("A-1", 0)]
    assert a["severity"] == "CRITICAL" and a["tick_count"] == 2 and a["peak_zscore"] == -5.0 and a["last_price"] == 103.0
    w = got[(None, 1)]
    assert w["tick_count"] == 2 and w["peak_risk_score"] == 1.5 and w["severity"] == "WARNING"
    assert [r["alert_id"] for r in recent_alerts(alerts_batch(df), 1, "end_time").collect()] == [got[(None, 20)]["alert_id"]]
    assert {r["case_id"] for r in audit_view(df).collect() if r["case_id"].startswith("INC-")} and audit_view(df).count() == 5


@pytest.mark.parametrize("kind, z, want", [
    ("price_shock", 3.25, "[WARNING] A price spike to $101.50 (risk: 1.75, Z-score: +3.25, VWAP divergence: 1.25%, signals: zscore,vwap, 3 ticks)"),
    ("price_shock", -3.25, "[WARNING] A price drop to $101.50 (risk: 1.75, Z-score: -3.25, VWAP divergence: 1.25%, signals: zscore,vwap, 3 ticks)"),
    ("wash_trade", 0.5, "[WARNING] A suspected wash trade at $101.50 (risk: 1.75, VWAP div: 1.25%, signals: zscore,vwap, 3 ticks)"),
    ("other", 1.25, "[WARNING] A anomalous behavior detected (risk: 1.75, Z-score: +1.25, signals: zscore,vwap)"),
])
def test_message_text(spark, kind, z, want):
    df = spark.createDataFrame([("A", "WARNING", kind, 101.5, z, 0.0125, 1.75, "zscore,vwap", 3)], "t string, l string, k string, p double, z double, v double, r double, s string, n int")
    assert df.select(fn.alert_message("t", "l", "k", "p", "z", "v", "r", "s", "n")).first()[0] == want


def test_alert_stream_with_repeats_and_audit_log(spark, tmp_path):
    """Delivered twice, alerted once; expiry by event time; log per dispatch."""
    columns = ANOMALIES.fieldNames()

    def file(*events):
        spark.createDataFrame([tuple(e[c] for c in columns) for e in events], ANOMALIES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    first, second = event("AAPL", 0, z=3.2), event("AAPL", 2, z=4.8)
    file(first, second)
    file(first, event("MSFT", 1, risk=1.25, incident="MSFT-1000"))
    file(event("ZZZ", 300, z=3.1))  # moves the watermark on
    file(event("ZZZ", 900, z=3.1))
    stream = spark.readStream.schema(ANOMALIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    alerts = alerts_stream(dedupe_events(stream, "1 minute"), late=None)
    out = []

    def keep(batch, batch_id):
        batch = batch.persist()
        out.extend(batch.collect())
        alert_log_batch(str(tmp_path / "log"))(batch, batch_id)
        batch.unpersist()

    q = alerts.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck"))
    q.trigger(availableNow=True).start().awaitTermination()
    seen = [(r["ticker"], r["event"], r["tick_count"]) for r in out]
    assert seen.count(("AAPL", "opened", 2)) + seen.count(("AAPL", "opened", 1)) == 1
    assert ("AAPL", "escalated", 2) in seen and ("AAPL", "closed", 2) in seen
    assert ("MSFT", "opened", 1) in seen and ("MSFT", "closed", 1) in seen
    assert all(r["message"].startswith(f"[{r['severity']}] {r['ticker']} price spike") for r in out if r["ticker"] == "AAPL")
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == len([e for e in seen if e[1] != "closed"])
    assert log.filter(F.col("detection_latency_ms").isNull()).count() == 0
    assert isinstance(pd.Timestamp(log.first()["created_at"]), pd.Timestamp)

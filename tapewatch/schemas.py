"""Declared schemas of every table and message the library reads or writes."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


# Payload of one tick message.
TICK = _struct(
    ticker=StringType(),
    event_time_ms=LongType(),
    price=DoubleType(),
    volume=DoubleType(),
    bid=DoubleType(),
    ask=DoubleType(),
    label=StringType(),
)

# Column order of the labelled history files.
TICK_CSV = _struct(
    ticker=StringType(),
    event_time_ms=LongType(),
    price=DoubleType(),
    bid=DoubleType(),
    ask=DoubleType(),
    volume=DoubleType(),
    label=StringType(),
)

# One log record with its coordinates.

# One scored tick.
SCORED = _struct(
    ticker=StringType(),
    timestamp=TimestampType(),
    price=DoubleType(),
    volume=DoubleType(),
    zscore=DoubleType(),
    vwap_divergence=DoubleType(),
    is_anomaly=BooleanType(),
    anomaly_type=StringType(),
    ewma_divergence=DoubleType(),
    cusum_price=DoubleType(),
    cusum_volume=DoubleType(),
    risk_score=DoubleType(),
    signals=StringType(),
    incident_id=StringType(),
    tick_id=StringType(),
)
SCORED_COLUMNS = SCORED.fieldNames()
FLOAT_FIELDS = [
    "price", "volume", "zscore", "vwap_divergence", "ewma_divergence", "cusum_price", "cusum_volume", "risk_score",
]
EXACT_FIELDS = ["is_anomaly", "anomaly_type", "signals", "incident_id", "tick_id"]

# Stored tables; both are partitioned by (ticker, day) and keyed by ROW_KEY.
PARTITION_COLUMNS = ["ticker", "day"]
ROW_KEY = ["ticker", "day", "event_time", "tick_id"]
RAW_EVENTS = _struct(
    ticker=StringType(),
    day=DateType(),
    event_time=TimestampType(),
    tick_id=StringType(),
    price=DoubleType(),
    volume=DoubleType(),
    side=StringType(),
)
ANOMALIES = _struct(
    ticker=StringType(),
    day=DateType(),
    event_time=TimestampType(),
    tick_id=StringType(),
    price=DoubleType(),
    volume=DoubleType(),
    zscore=DoubleType(),
    vwap_divergence=DoubleType(),
    is_anomaly=BooleanType(),
    anomaly_type=StringType(),
    ewma_divergence=DoubleType(),
    cusum_price=DoubleType(),
    cusum_volume=DoubleType(),
    risk_score=DoubleType(),
    signals=StringType(),
    incident_id=StringType(),
)

ALERT = _struct(
    alert_id=StringType(),
    ticker=StringType(),
    severity=StringType(),
    anomaly_type=StringType(),
    start_time=TimestampType(),
    end_time=TimestampType(),
    peak_price=DoubleType(),
    last_price=DoubleType(),
    peak_zscore=DoubleType(),
    peak_vwap_div=DoubleType(),
    total_volume=DoubleType(),
    tick_count=LongType(),
    message=StringType(),
    peak_risk_score=DoubleType(),
    signals=StringType(),
    incident_id=StringType(),
    tick_id=StringType(),
    event=StringType(),
)

# Carried state of the detector for one ticker. Lists are parallel primitive
# arrays: window_* hold the last ticks of the rolling baseline, hist_* the
# ticks still inside the trailing wash lookback.
DETECTOR_STATE = _struct(
    last_ts=LongType(),
    late_dropped=LongType(),
    same_ts_seq=LongType(),
    window_price=ArrayType(DoubleType()),
    window_clipped=ArrayType(DoubleType()),
    window_volume=ArrayType(DoubleType()),
    hist_ts=ArrayType(LongType()),
    hist_price=ArrayType(DoubleType()),
    hist_volume=ArrayType(DoubleType()),
    ewma_fast=DoubleType(),
    ewma_slow=DoubleType(),
    ewma_div_ms=DoubleType(),
    ewma_n=LongType(),
    rate_dt_ms=DoubleType(),
    rate_n=LongType(),
    cusum_up=DoubleType(),
    cusum_down=DoubleType(),
    cusum_vol=DoubleType(),
    cusum_prev_price=DoubleType(),
    cusum_diff_ms=DoubleType(),
    cusum_logv_mean=DoubleType(),
    cusum_logv_var=DoubleType(),
    cusum_n=LongType(),
    incident_id=StringType(),
    ticks_since_flag=LongType(),
)
# Part of every detector checkpoint path: raise it whenever DETECTOR_STATE or
# the meaning of one of its fields changes.
STATE_LAYOUT_VERSION = 1

ALERT_STATE = _struct(
    burst_open=BooleanType(),
    alert_id=StringType(),
    severity=StringType(),
    anomaly_type=StringType(),
    start_ms=LongType(),
    end_ms=LongType(),
    last_price=DoubleType(),
    peak_zscore=DoubleType(),
    peak_vwap_div=DoubleType(),
    total_volume=DoubleType(),
    tick_count=LongType(),
    peak_risk_score=DoubleType(),
    signals=StringType(),
    tick_id=StringType(),
    last_alert_ms=LongType(),
)

"""Registered queries: each reads the whole test tables, most with the same
question in SQL next to it.

``covers`` names the rows of the operator inventory that a query exercises.
Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.functions import columns as fn
from tapewatch.operators import alerts, bars, desk, diff, evaluate, quality, signals, tuning
from tapewatch.operators import ticks as tk
from tapewatch.operators.quantiles import exact_percentiles
from tapewatch.operators.slices import DAY_MS, Slicing, plan_width
from tapewatch.plans.inputs import (
    ANOMALIES_SQL,
    LOG_SQL,
    TICKS_SQL,
    anomalies,
    indexed_sql,
    log_records,
    ticks,
)
from tapewatch.plans.surveillance import surveil
from tapewatch.schemas import SCORED_COLUMNS, TICK_CSV
from tapewatch.session import checkpoint_folder, cut_lineage
from tapewatch.sources import files, log
from tapewatch.streaming import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}

# The test ticks are minutes apart, so gaps and look-backs are hours.
GAP_MS = 5_400_000
HOUR = 3_600_000
NOW = datetime(2024, 1, 20, 12, 0, tzinfo=timezone.utc)
NOW_MS = 1_705_752_000_000
NOW_SQL = "1705752000000"


def query(name: str, *covers: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return register


@lru_cache(maxsize=32)
def _planned_width(application: str, folder: str, keys: tuple[str, ...]) -> int:
    t = ticks(SparkSession.getActiveSession(), folder).select("ticker", "event_time_ms")
    return plan_width(t, Slicing(keys=keys))


def slices(spark: SparkSession, folder: str, least_ms: int = 1_000, keys: tuple[str, ...] = ("ticker",)) -> Slicing:
    """A day per slice, or less where the busiest ticker (without keys: all
    tickers together) has more than a million ticks a day; never less than a
    query's look-back."""
    planned = _planned_width(spark.sparkContext.applicationId, folder, keys)
    return Slicing(width_ms=max(least_ms, min(DAY_MS, planned)))


def timeline(spark: SparkSession, folder: str) -> Slicing:
    """Slices for one order over all tickers, sized by all of them."""
    return Slicing(width_ms=slices(spark, folder, keys=()).width_ms)


def r6(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + 0.0).alias(name or column)


def s6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


# --- time, sessions, ids ----------------------------------------------------


@query("tick_days", "P-2", "P-3", "P-8", "U-4", sql=f"""
WITH {TICKS_SQL}
SELECT ticker, CAST(CAST(make_timestamp_ms(event_time_ms) AS DATE) AS VARCHAR) AS day, count(*) AS ticks FROM ticks
WHERE CAST(make_timestamp_ms(event_time_ms) AS DATE) IN ('2024-01-03', '2024-01-04', '2024-01-10')
GROUP BY ALL""")
def tick_days(spark, folder):
    t = tk.slice_days(ticks(spark, folder), ["2024-01-03", "2024-01-04", "2024-01-10"])
    day = tk.utc_day(tk.event_time()).cast("string").alias("day")
    return t.groupBy("ticker", day).agg(F.count("*").alias("ticks"))


@query("days_covered", "P-9", sql=f"""
WITH {TICKS_SQL}, r AS (SELECT ticker, date_trunc('day', make_timestamp_ms(min(event_time_ms))) a,
  date_trunc('day', make_timestamp_ms(max(event_time_ms))) b FROM ticks GROUP BY ticker)
SELECT ticker, CAST(CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day FROM r""")
def days_covered(spark, folder):
    t = ticks(spark, folder)
    ranges = t.groupBy("ticker").agg(
        tk.event_time(F.min("event_time_ms")).alias("start"), tk.event_time(F.max("event_time_ms")).alias("end")
    )
    return tk.days_covered(ranges).select("ticker", F.col("day").cast("string").alias("day"))


@query("tick_gaps", "W-3", sql=f"""
WITH {indexed_sql(GAP_MS)} SELECT ticker, arrival, gap_ms, CASE WHEN gap_ms IS NOT NULL THEN least(gap_ms, 60000) END AS capped_gap_ms FROM idx""")
def tick_gaps(spark, folder):
    return tk.with_gap(ticks(spark, folder), slices(spark, folder)).select("ticker", "arrival", "gap_ms", "capped_gap_ms")


@query("session_ids", "W-4", sql=f"WITH {indexed_sql(GAP_MS)} SELECT ticker, arrival, session_id FROM idx")
def session_ids(spark, folder):
    return tk.with_session(ticks(spark, folder), GAP_MS, slices(spark, folder)).select("ticker", "arrival", "session_id")


@query("tick_ids", "W-5", sql=f"WITH {indexed_sql(GAP_MS)} SELECT ticker, arrival, ms_seq, tick_id FROM idx")
def tick_ids(spark, folder):
    return tk.with_tick_id(ticks(spark, folder), slices(spark, folder)).select("ticker", "arrival", "ms_seq", "tick_id")


@query("tick_positions", "W-15", sql=f"WITH {indexed_sql(GAP_MS)} SELECT ticker, arrival, pos FROM idx")
def tick_positions(spark, folder):
    return tk.with_pos(ticks(spark, folder), slices(spark, folder)).select("ticker", "arrival", "pos")


@query("tick_index", "W-3", "W-4", "W-5", "W-15", sql=f"""
WITH {indexed_sql(GAP_MS)}
SELECT ticker, arrival, pos, session_id, gap_ms, ms_seq, tick_id, {s6('price_diff')} FROM idx""")
def tick_index(spark, folder):
    return tk.indexed(ticks(spark, folder), GAP_MS, slices(spark, folder)).select(
        "ticker", "arrival", "pos", "session_id", "gap_ms", "ms_seq", "tick_id", r6("price_diff")
    )


@query("tick_returns", "W-7", sql=f"""
WITH {TICKS_SQL}
SELECT ticker, arrival, round(coalesce(abs(price / lag(price) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival) - 1), 0.0), 9) + 0.0 AS abs_return FROM ticks""")
def tick_returns(spark, folder):
    return tk.with_return(ticks(spark, folder), slices(spark, folder)).select(
        "ticker", "arrival", (F.round("abs_return", 9) + 0.0).alias("abs_return")
    )


@query("tick_side", "P-14", sql=f"""
WITH {TICKS_SQL}
SELECT ticker, arrival, CASE WHEN coalesce(price - lag(price) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival), 0) >= 0 THEN 'buy' ELSE 'sell' END AS side FROM ticks""")
def tick_side(spark, folder):
    return tk.with_side(ticks(spark, folder), "ticker", slices(spark, folder)).select("ticker", "arrival", "side")


@query("tick_side_global", "P-14", sql=f"""
WITH {TICKS_SQL}
SELECT ticker, arrival, CASE WHEN coalesce(price - lag(price) OVER (ORDER BY event_time_ms, arrival), 0) >= 0 THEN 'buy' ELSE 'sell' END AS side FROM ticks""")
def tick_side_global(spark, folder):
    return tk.with_side(ticks(spark, folder), "global", timeline(spark, folder)).select("ticker", "arrival", "side")


REPLAY_SQL = """
WITH {t}, g AS (SELECT *, coalesce(event_time_ms - lag(event_time_ms) OVER ({p} ORDER BY event_time_ms, arrival), 0) AS gap FROM ticks),
e AS (SELECT *, sum(least(CAST(gap AS DOUBLE), 100000.0)) OVER ({p} ORDER BY event_time_ms, arrival) / 1000.0 / 50.0 AS target FROM g)
SELECT ticker, arrival, round(target, 6) + 0.0 AS target_s FROM e"""


@query("replay_schedule", "W-16", sql=REPLAY_SQL.format(t=TICKS_SQL, p=""))
def replay_schedule(spark, folder):
    return tk.replay_schedule(ticks(spark, folder), 50.0, 2.0, "global", s=timeline(spark, folder)).select("ticker", "arrival", r6("target_s"))


@query("replay_schedule_per_ticker", "W-16", sql=REPLAY_SQL.format(t=TICKS_SQL, p="PARTITION BY ticker"))
def replay_schedule_per_ticker(spark, folder):
    return tk.replay_schedule(ticks(spark, folder), 50.0, 2.0, "ticker", s=slices(spark, folder)).select("ticker", "arrival", r6("target_s"))


@query("period_split", "P-15", "A-10", sql=f"""
WITH {TICKS_SQL}, c AS (SELECT quantile_cont(CAST(event_time_ms AS DOUBLE), 0.7) AS cutoff FROM ticks)
SELECT CASE WHEN event_time_ms <= cutoff THEN 'train' ELSE 'test' END AS period, count(*) AS ticks,
       count(DISTINCT ticker) AS tickers, count(DISTINCT CAST(make_timestamp_ms(event_time_ms) AS DATE)) AS days,
       {s6("avg(CAST(label = 'price_shock' AS DOUBLE))", 'price_shock')}, {s6("avg(CAST(label = 'wash_trade' AS DOUBLE))", 'wash_trade')},
       {s6("avg(CAST(label <> 'normal' AS DOUBLE))", '"any"')}
FROM ticks, c GROUP BY 1""")
def period_split(spark, folder):
    p = evaluate.prevalence(tk.period_mask(ticks(spark, folder)), "period")
    return p.select("period", "ticks", "tickers", "days", r6("price_shock"), r6("wash_trade"), r6("any"))


# --- detector signals -------------------------------------------------------

PREVIOUS_20 = "(PARTITION BY ticker ORDER BY event_time_ms, arrival ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("rolling_zscore", "W-1", "P-1", sql=f"""
WITH {TICKS_SQL}, w AS (SELECT *, count(*) OVER {PREVIOUS_20} n, avg(price) OVER {PREVIOUS_20} m, stddev_pop(price) OVER {PREVIOUS_20} sd FROM ticks)
SELECT ticker, arrival, {s6('CASE WHEN n >= 10 THEN CASE WHEN sd > 1e-9 THEN (price - m) / sd ELSE 0 END END', 'zscore')} FROM w""")
def rolling_zscore(spark, folder):
    return signals.rolling_z(tk.detector_input(ticks(spark, folder)), 20, 10, slices(spark, folder)).select("ticker", "arrival", r6("zscore"))


@query("rolling_vwap", "W-2", "K-2", sql=f"""
WITH {TICKS_SQL}, w AS (SELECT *, sum(price * volume) OVER {PREVIOUS_20} / nullif(sum(volume) OVER {PREVIOUS_20}, 0) AS vw FROM ticks)
SELECT ticker, arrival, round(abs(price - vw) / vw, 9) + 0.0 AS vwap_divergence FROM w""")
def rolling_vwap(spark, folder):
    return signals.rolling_vwap(ticks(spark, folder), 20, 1, slices(spark, folder)).select(
        "ticker", "arrival", (F.round("vwap_divergence", 9) + 0.0).alias("vwap_divergence")
    )


TRAIL = "(PARTITION BY ticker ORDER BY event_time_ms RANGE BETWEEN {ms} PRECEDING AND 1 PRECEDING)"


WASH_SQL = f"""
WITH {TICKS_SQL}, w AS (
  SELECT *, min(price) OVER t lo, max(price) OVER t hi, sum(volume) OVER t pv, count(price) OVER t n
  FROM ticks WINDOW t AS {TRAIL.format(ms=6 * HOUR)}),
f AS (SELECT *, coalesce(lo > 0 AND (hi - lo) / lo < 0.003, FALSE) AS flat FROM w)
SELECT ticker, arrival, n AS prior_ticks, {s6('pv', 'prior_volume')}, flat AS flat_market,
  {s6('CASE WHEN flat AND n >= 4 AND pv > 0 THEN volume / (0.3 * pv) ELSE 0 END', 'wash_ratio')} FROM f"""


def _wash(spark, folder, s: Slicing):
    w = signals.wash_lookback(ticks(spark, folder), 6 * HOUR, 0.003, 0.3, 4, s)
    return w.select("ticker", "arrival", "prior_ticks", r6("prior_volume"), "flat_market", r6("wash_ratio"))


@query("wash_lookback", "J-11", "K-7", sql=WASH_SQL)
def wash_lookback(spark, folder):
    return _wash(spark, folder, slices(spark, folder))


@query("wash_lookback_narrow", "J-11", "K-7", sql=WASH_SQL)
def wash_lookback_narrow(spark, folder):
    """The same with slices of a tenth of the look-back."""
    return _wash(spark, folder, Slicing(width_ms=6 * HOUR // 10))


@query("adaptive_cutoff", "W-13", sql=f"""
WITH {indexed_sql(GAP_MS)}
SELECT ticker, arrival, CAST(max(event_time_ms - 1000 * CAST(volume AS BIGINT) * 60) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival) AS BIGINT) AS cutoff_ms FROM idx""")
def adaptive_cutoff(spark, folder):
    look = F.lit(60_000) * F.col("volume").cast("long")
    return signals.adaptive_cutoff(ticks(spark, folder), look, slices(spark, folder)).select("ticker", "arrival", "cutoff_ms")


TRAILING_SQL = f"""
WITH {TICKS_SQL}, w AS (
  SELECT *, avg(price) OVER t m, stddev_samp(price) OVER t sd,
    sum(price * volume) OVER c / sum(volume) OVER c AS vw
  FROM ticks WINDOW t AS {TRAIL.format(ms=2 * HOUR)}, c AS (PARTITION BY ticker ORDER BY event_time_ms, arrival ROWS UNBOUNDED PRECEDING))
SELECT ticker, arrival, {s6('CASE WHEN sd >= 1e-4 THEN greatest(-6.0, least(6.0, (price - m) / sd)) ELSE 0 END', 'zscore')},
  {s6('abs(price - vw) / vw', 'vwap_divergence')} FROM w"""


@query("trailing_two_hours", "W-12", sql=TRAILING_SQL)
def trailing_two_hours(spark, folder):
    rows = signals.trailing_time_stats(ticks(spark, folder), 2 * HOUR, s=slices(spark, folder))
    return rows.select("ticker", "arrival", r6("zscore"), r6("vwap_divergence"))


@query("trailing_two_hours_narrow", "W-12", sql=TRAILING_SQL)
def trailing_two_hours_narrow(spark, folder):
    """The same with slices of less than a tenth of the look-back."""
    rows = signals.trailing_time_stats(ticks(spark, folder), 2 * HOUR, s=Slicing(width_ms=11 * 60_000))
    return rows.select("ticker", "arrival", r6("zscore"), r6("vwap_divergence"))


ENRICHED_SQL = f"""
WITH {TICKS_SQL}, w AS (
  SELECT *, avg(price) OVER t m, stddev_samp(price) OVER t sd,
    sum(price * volume) OVER c / sum(volume) OVER c AS vw
  FROM ticks WINDOW t AS {TRAIL.format(ms=2 * HOUR)}, c AS (PARTITION BY ticker ORDER BY event_time_ms, arrival ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, CASE WHEN sd >= 1e-4 THEN greatest(-6.0, least(6.0, (price - m) / sd)) ELSE 0 END AS z, abs(price - vw) / vw AS vd
  FROM w WHERE label <> 'normal'),
o AS (SELECT *, coalesce(event_time_ms - lag(event_time_ms) OVER p > {24 * HOUR} OR label <> lag(label) OVER p, TRUE) AS opens
  FROM a WINDOW p AS (PARTITION BY ticker ORDER BY event_time_ms, arrival))
SELECT ticker, arrival, label AS anomaly_type, {s6('z', 'zscore')}, {s6('greatest(abs(z) / 5.0, abs(vd) / 0.01, 1.01)', 'risk_score')},
  CASE WHEN label = 'wash_trade' THEN 'wash_rule' ELSE 'zscore' END AS signals,
  concat_ws('-', ticker, max(CASE WHEN opens THEN event_time_ms END) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival)) AS incident_id FROM o"""


@query("labelled_enrichment_narrow", "W-14", "D-5", sql=ENRICHED_SQL)
def labelled_enrichment_narrow(spark, folder):
    """The same with slices of a twelfth of the look-back."""
    return labelled_enrichment(spark, folder, Slicing(width_ms=10 * 60_000))


@query("labelled_enrichment", "W-14", "D-5", sql=ENRICHED_SQL)
def labelled_enrichment(spark, folder, s: Slicing | None = None):
    rows = signals.enrich_labelled(ticks(spark, folder), 2 * HOUR, 24 * HOUR, s or slices(spark, folder))
    return rows.select("ticker", "arrival", "anomaly_type", r6("zscore"), r6("risk_score"), "signals", "incident_id")


SURVEIL = dict(
    z_threshold=3.0, vwap_threshold=0.0025, lookback_ms=6 * HOUR, price_range=0.003, volume_ratio=0.3, session_gap_ms=GAP_MS
)


SURVEIL_SQL = f"""
WITH {indexed_sql(GAP_MS)}, w AS (
  SELECT *, count(*) OVER p n, avg(price) OVER p m, stddev_pop(price) OVER p sd,
    sum(price * volume) OVER p / nullif(sum(volume) OVER p, 0) vw,
    min(price) OVER t lo, max(price) OVER t hi, sum(volume) OVER t pv, count(price) OVER t pn
  FROM idx WINDOW p AS {PREVIOUS_20}, t AS {TRAIL.format(ms=6 * HOUR)}),
r AS (SELECT *,
  coalesce(CASE WHEN n >= 10 THEN CASE WHEN sd > 1e-9 THEN abs(price - m) / sd ELSE 0 END END / 3.0, 0) AS rz,
  coalesce(CASE WHEN n >= 10 THEN abs(price - vw) / vw END / 0.0025, 0) AS rv,
  CASE WHEN coalesce(lo > 0 AND (hi - lo) / lo < 0.003, FALSE) AND pn >= 4 AND pv > 0 THEN volume / (0.3 * pv) ELSE 0 END AS rw FROM w),
f AS (SELECT *, greatest(rz, rv, rw) AS risk,
  concat_ws(',', CASE WHEN rz > 1 THEN 'zscore' END, CASE WHEN rv > 1 THEN 'vwap' END, CASE WHEN rw > 1 THEN 'wash_rule' END) AS sig
  FROM r WHERE rz > 1 OR rv > 1 OR rw > 1),
o AS (SELECT *, coalesce(pos - lag(pos) OVER q - 1 > 10 OR session_id <> lag(session_id) OVER q, TRUE) AS opens
  FROM f WINDOW q AS (PARTITION BY ticker ORDER BY event_time_ms, arrival))
SELECT ticker, tick_id, {s6('risk', 'risk_score')}, CASE WHEN rz > 1 OR rv > 1 THEN 'price_shock' ELSE 'wash_trade' END AS anomaly_type,
  sig AS signals, concat_ws('-', ticker, max(CASE WHEN opens THEN event_time_ms END) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival)) AS incident_id
FROM o"""


@query("surveillance", "P-4", "K-9", "W-6", sql=SURVEIL_SQL)
def surveillance(spark, folder, s: Slicing | None = None):
    rows = surveil(ticks(spark, folder), s or slices(spark, folder), **SURVEIL)
    return rows.select("ticker", "tick_id", r6("risk_score"), "anomaly_type", "signals", "incident_id")


@query("surveillance_narrow", "J-11", "K-9", "W-6", sql=SURVEIL_SQL)
def surveillance_narrow(spark, folder):
    """The same with slices of a sixth of the look-back."""
    return surveillance(spark, folder, Slicing(width_ms=HOUR))


@query("naive_flags", "K-15", sql=f"""
WITH {TICKS_SQL}, r AS (SELECT *, coalesce(abs(price / lag(price) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival) - 1), 0.0) AS ret FROM ticks)
SELECT ticker, arrival, ret > 0.0015 AS naive_shock, volume > 90 AND NOT ret > 0.0015 AS naive_wash FROM r""")
def naive_flags(spark, folder):
    t = tk.with_return(ticks(spark, folder), slices(spark, folder))
    return signals.naive_flags(t, 0.0015, 90.0).select("ticker", "arrival", "naive_shock", "naive_wash")


# --- bars and desk ----------------------------------------------------------

BAR = 4 * HOUR
BARS_SQL = f"""bars AS (
  SELECT ticker, event_time_ms // {BAR} * {BAR} AS bar_ms, arg_min(price, (event_time_ms, arrival)) AS "open", max(price) AS high,
         min(price) AS low, arg_max(price, (event_time_ms, arrival)) AS "close", sum(volume) AS volume
  FROM ticks GROUP BY 1, 2)"""


@query("ohlc_bars", "A-1", sql=f"""
WITH {TICKS_SQL}, {BARS_SQL.replace(str(BAR), '30000')}
SELECT ticker, bar_ms, {s6('"open"')}, {s6('high')}, {s6('low')}, {s6('"close"')}, {s6('volume')} FROM bars""")
def ohlc_bars(spark, folder):
    return bars.ohlc_bars(ticks(spark, folder)).select(
        "ticker", "bar_ms", r6("open"), r6("high"), r6("low"), r6("close"), r6("volume")
    )


@query("bar_statistics", "W-8", "W-9", sql=f"""
WITH {TICKS_SQL}, {BARS_SQL}, w AS (
  SELECT *, avg("close") OVER z m, CASE WHEN count(*) OVER z >= 2 THEN stddev_samp("close") OVER z END sd,
    sum((high + low + "close") / 3.0 * volume) OVER c / nullif(sum(volume) OVER c, 0) AS vw
  FROM bars WINDOW z AS (PARTITION BY ticker ORDER BY bar_ms ROWS 14 PRECEDING), c AS (PARTITION BY ticker ORDER BY bar_ms ROWS UNBOUNDED PRECEDING))
SELECT ticker, bar_ms, {s6('CASE WHEN sd >= 1e-4 THEN greatest(-6.0, least(6.0, ("close" - m) / sd)) ELSE 0 END', 'zscore')},
  {s6('vw', 'vwap')}, {s6('greatest(-10.0, least(10.0, ("close" - vw) / vw * 100))', 'vwap_divergence')} FROM w""")
def bar_statistics(spark, folder):
    b = bars.bar_vwap(bars.bar_zscore(bars.ohlc_bars(ticks(spark, folder), BAR)))
    return b.select("ticker", "bar_ms", r6("zscore"), r6("vwap"), r6("vwap_divergence"))


@query("price_change", "T-5", sql=f"""
WITH {TICKS_SQL}, {BARS_SQL}, p AS (SELECT ticker, arg_min("close", bar_ms) a, arg_max("close", bar_ms) b FROM bars GROUP BY ticker)
SELECT ticker, {s6('a', 'first_close')}, {s6('b', 'last_close')}, {s6('(b - a) / a * 100', 'pct_change')} FROM p""")
def price_change(spark, folder):
    return bars.price_change(bars.ohlc_bars(ticks(spark, folder), BAR)).select(
        "ticker", r6("first_close"), r6("last_close"), r6("pct_change")
    )


EPISODES_SQL = f"""
WITH {TICKS_SQL}, {BARS_SQL}, w AS (
  SELECT *, avg("close") OVER z m, CASE WHEN count(*) OVER z >= 2 THEN stddev_samp("close") OVER z END sd
  FROM bars WINDOW z AS (PARTITION BY ticker ORDER BY bar_ms ROWS 14 PRECEDING)),
s AS (SELECT *, CASE WHEN sd >= 1e-4 THEN greatest(-6.0, least(6.0, ("close" - m) / sd)) ELSE 0 END AS zscore FROM w),
e AS (SELECT *, abs(zscore) >= 2.0 AND NOT coalesce(lag(abs(zscore) >= 2.0) OVER (PARTITION BY ticker ORDER BY bar_ms), FALSE) AS starts FROM s)
SELECT ticker, bar_ms, {s6('zscore')}, CASE WHEN abs(zscore) >= 3.0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM e
WHERE starts AND (ticker, bar_ms) NOT IN (SELECT (ticker, event_time_ms // {BAR} * {BAR}) FROM ticks WHERE label <> 'normal')"""


@query("z_episodes", "J-6", "W-11", sql=EPISODES_SQL)
def z_episodes(spark, folder):
    t = ticks(spark, folder)
    b = bars.bar_zscore(bars.ohlc_bars(t, BAR))
    known = t.filter(F.col("label") != "normal")
    return bars.z_episodes(b, known, 2.0, 3.0, BAR).select("ticker", "bar_ms", r6("zscore"), "severity")


SPARSE_BARS = "SELECT DISTINCT ticker, event_time_ms // 1800000 * 1800000 AS bar_ms FROM ticks"


@query("nearest_bar", "J-5", sql=f"""
WITH {TICKS_SQL}, b AS ({SPARSE_BARS}),
p AS (SELECT t.ticker, t.arrival, t.event_time_ms // 1000 * 1000 AS sec, b.bar_ms AS prev FROM ticks t ASOF LEFT JOIN b ON t.ticker = b.ticker AND t.event_time_ms >= b.bar_ms),
n AS (SELECT t.arrival, b.bar_ms AS nxt FROM ticks t ASOF LEFT JOIN b ON t.ticker = b.ticker AND t.event_time_ms <= b.bar_ms)
SELECT ticker, p.arrival, CASE WHEN nxt IS NULL OR sec - prev <= nxt - sec THEN coalesce(prev, nxt) ELSE nxt END AS bar_ms FROM p JOIN n USING (arrival)""")
def nearest_bar(spark, folder):
    t = ticks(spark, folder)
    third = F.floor(F.col("event_time_ms") / 1_800_000)
    sparse = t.select("ticker", (third * 1_800_000).alias("bar_ms")).distinct()
    return bars.nearest_bar(t.select("ticker", "event_time_ms", "arrival"), sparse, slices(spark, folder)).select("ticker", "arrival", "bar_ms")


@query("bar_markers", "A-21", sql=f"""
WITH {ANOMALIES_SQL}, k AS (
  SELECT *, event_time_ms // {BAR} * {BAR} AS bar_ms, coalesce(risk_score, 0) AS risk, coalesce(risk_score, 0) >= 2 OR abs(zscore) >= 4.5 AS crit
  FROM scored WHERE is_anomaly AND (abs(zscore) >= 3 OR coalesce(risk_score, 0) >= 1)),
g AS (SELECT ticker, bar_ms, count(*) AS anomalies, arg_max(zscore, (crit, risk, abs(zscore))) z, arg_max(risk, (crit, risk, abs(zscore))) rk,
  arg_max(anomaly_type, (crit, risk, abs(zscore))) ty, bool_or(crit) c FROM k GROUP BY ALL)
SELECT ticker, bar_ms, anomalies, {s6('z', 'peak_zscore')}, {s6('rk', 'peak_risk')}, CASE WHEN c THEN 'CRITICAL' ELSE 'WARNING' END AS level,
  CASE WHEN ty = 'wash_trade' THEN 'circle' WHEN z < 0 THEN 'arrowDown' ELSE 'arrowUp' END AS shape,
  CASE WHEN ty = 'wash_trade' OR z < 0 THEN 'aboveBar' ELSE 'belowBar' END AS "position" FROM g""")
def bar_markers(spark, folder):
    rows = desk.flagged(anomalies(spark, folder)).withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0)))
    marks = bars.bar_markers(rows.withColumn("bar_ms", bars.bar_start_ms(width_ms=BAR)))
    return marks.select("ticker", "bar_ms", "anomalies", r6("peak_zscore"), r6("peak_risk"), "level", "shape", "position")


@query("flagged_rows", "P-4", sql=f"WITH {ANOMALIES_SQL} SELECT tick_id, anomaly_type, signals, incident_id FROM scored WHERE is_anomaly")
def flagged_rows(spark, folder):
    return desk.flagged(anomalies(spark, folder)).select("tick_id", "anomaly_type", "signals", "incident_id")


@query("partition_scan", "S-8", sql=f"""
WITH {ANOMALIES_SQL} SELECT ticker, CAST(day AS VARCHAR) AS day, tick_id FROM scored WHERE ticker IN ('click', 'error')
AND event_time_ms BETWEEN {NOW_MS - 36 * HOUR} AND {NOW_SQL}""")
def partition_scan(spark, folder):
    start = datetime(2024, 1, 19, 0, 0, tzinfo=timezone.utc)
    rows = desk.scan_partitions(anomalies(spark, folder), ["click", "error"], start, NOW)
    return rows.select("ticker", F.col("day").cast("string").alias("day"), "tick_id")


# the window is about as long as the pauses of a ticker, so that some tickers fall back to older rows
BACK_MIN = 20
BACK_MS = BACK_MIN * 60_000
LOOKBACK_SQL = f"""
WITH {ANOMALIES_SQL}, p AS (SELECT * FROM scored WHERE event_time_ms <= {NOW_SQL}),
c AS (SELECT ticker, CASE WHEN max(event_time_ms) < {NOW_MS - BACK_MS} THEN max(event_time_ms) - {BACK_MS} ELSE {NOW_MS - BACK_MS} END AS cutoff FROM p GROUP BY ticker)"""


def stored_anomalies(spark, folder) -> DataFrame:
    """The anomaly rows as a table stored by ticker and day."""
    path = f"{checkpoint_folder(spark)}/stored/{uuid.uuid4().hex}"
    rows = anomalies(spark, folder)
    rows.hint("rebalance", "ticker", "day").write.partitionBy("ticker", "day").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("lookback_with_fallback", "P-5", sql=LOOKBACK_SQL + " SELECT p.ticker, tick_id FROM p JOIN c USING (ticker) WHERE event_time_ms >= cutoff")
def lookback_with_fallback(spark, folder):
    return desk.lookback(stored_anomalies(spark, folder), NOW, BACK_MIN).select("ticker", "tick_id")


@query("recent_anomalies", "T-1", "P-10", "P-12", sql=LOOKBACK_SQL + f""",
f AS (SELECT p.*, row_number() OVER (PARTITION BY p.ticker ORDER BY event_time_ms DESC, tick_id DESC) rn FROM p JOIN c USING (ticker) WHERE event_time_ms >= cutoff)
SELECT ticker, tick_id, {s6('zscore')}, {s6('coalesce(risk_score, greatest(abs(zscore) / 5.0, abs(vwap_divergence) / 0.01))', 'risk_score')}
FROM f WHERE rn <= 20 ORDER BY event_time_ms DESC, tick_id DESC LIMIT 20""")
def recent_anomalies(spark, folder):
    return desk.recent_anomalies(stored_anomalies(spark, folder), NOW, BACK_MIN, limit=20).select(
        "ticker", "tick_id", r6("zscore"), r6("risk_score")
    )


@query("latest_event", "T-2", sql=f"WITH {ANOMALIES_SQL} SELECT ticker, max(event_time_ms) AS latest_ms FROM scored GROUP BY ticker")
def latest_event(spark, folder):
    return desk.latest_event(stored_anomalies(spark, folder)).select("ticker", F.unix_millis("latest_event").alias("latest_ms"))


@query("distinct_partitions", "U-4", sql=f"WITH {ANOMALIES_SQL} SELECT DISTINCT ticker, CAST(day AS VARCHAR) AS day FROM scored")
def distinct_partitions(spark, folder):
    return anomalies(spark, folder).select("ticker", F.col("day").cast("string").alias("day")).distinct()


@query("largest_partitions", "A-23", sql=f'WITH {ANOMALIES_SQL} SELECT ticker, CAST(day AS VARCHAR) AS day, count(*) AS "rows" FROM scored GROUP BY ALL')
def largest_partitions(spark, folder):
    return quality.partition_sizes(anomalies(spark, folder)).withColumn("day", F.col("day").cast("string"))


SEVERITY_SQL = """CASE WHEN coalesce(risk_score, 0) >= 2 OR abs(zscore) >= 4.5 OR abs(vwap_divergence) >= 0.05 THEN 'CRITICAL'
  WHEN coalesce(risk_score, 0) >= 1 OR abs(zscore) >= 3 OR abs(vwap_divergence) >= 0.025 OR coalesce(anomaly_type = 'wash_trade', FALSE) THEN 'WARNING' ELSE 'INFO' END"""


@query("severity_tiers", "P-16", sql=f"WITH {ANOMALIES_SQL} SELECT tick_id, {SEVERITY_SQL} AS severity FROM scored")
def severity_tiers(spark, folder):
    level = fn.severity("zscore", "vwap_divergence", "anomaly_type", "risk_score")
    return anomalies(spark, folder).select("tick_id", level.alias("severity"))


@query("desk_filter", "P-6", sql=f"""
WITH {ANOMALIES_SQL} SELECT tick_id, {SEVERITY_SQL} AS severity FROM scored
WHERE anomaly_type = 'price_shock' AND {SEVERITY_SQL} = 'CRITICAL' AND abs(zscore) >= 0.5 AND risk_score >= 1.5""")
def desk_filter(spark, folder):
    rows = desk.desk_filter(anomalies(spark, folder), "price_shock", "CRITICAL", 0.5, 1.5)
    return rows.select("tick_id", "severity")


@query("desk_kpis", "A-3", sql=f"""
WITH {ANOMALIES_SQL}, a AS (SELECT *, {SEVERITY_SQL} AS severity FROM scored WHERE is_anomaly)
SELECT count(*) AS total_flags, count_if(severity = 'CRITICAL')::BIGINT AS critical_flags, count_if(severity = 'WARNING')::BIGINT AS warning_flags,
  count_if(anomaly_type = 'price_shock')::BIGINT AS price_shocks, count_if(anomaly_type = 'wash_trade')::BIGINT AS wash_trades,
  {s6('max(abs(zscore))', 'peak_zscore')}, {s6('max(risk_score)', 'peak_risk')} FROM a""")
def desk_kpis(spark, folder):
    k = desk.kpis(desk.desk_filter(desk.flagged(anomalies(spark, folder))))
    return k.withColumns({c: F.round(c, 6) + 0.0 for c in ("peak_zscore", "peak_risk")})


# monitored tickers: every event type, plus the market segments as tickers without events
METRICS_SQL = f"""
WITH {ANOMALIES_SQL}, {TICKS_SQL}, {BARS_SQL}, m AS (SELECT DISTINCT event_type AS ticker FROM events UNION SELECT DISTINCT c_mktsegment FROM customer),
a AS (SELECT ticker, count(*) n, count_if(anomaly_type = 'price_shock')::BIGINT ps, count_if(anomaly_type = 'wash_trade')::BIGINT wt,
  max(abs(zscore)) mz, max(risk_score) mr, count(DISTINCT incident_id) ic, max(event_time_ms) le FROM scored WHERE is_anomaly GROUP BY ticker),
p AS (SELECT ticker, arg_min("close", bar_ms) f, arg_max("close", bar_ms) l FROM bars GROUP BY ticker),
o AS (SELECT ticker, coalesce(n, 0) AS anomaly_count, coalesce(ps, 0) AS price_shocks, coalesce(wt, 0) AS wash_trades,
  coalesce(mz, 0) AS max_zscore, coalesce(mr, 0) AS max_risk_score, coalesce(ic, 0) AS incident_count, le AS latest_ms,
  coalesce(l, 0) AS latest_price, coalesce((l - f) / f * 100, 0) AS pct_change
  FROM m LEFT JOIN a USING (ticker) LEFT JOIN p USING (ticker))
SELECT ticker, anomaly_count, price_shocks, wash_trades, {s6('max_zscore')}, {s6('max_risk_score')}, incident_count, latest_ms,
  {s6('latest_price')}, {s6('pct_change')},
  CASE WHEN max_risk_score >= 2 OR max_zscore >= 4.5 THEN 'CRITICAL' WHEN max_risk_score >= 1 OR max_zscore >= 3 OR wash_trades > 0 THEN 'WARNING' ELSE 'NORMAL' END AS status
FROM o"""


@query("ticker_metrics", "A-2", "J-9", "P-17", sql=METRICS_SQL)
def ticker_metrics(spark, folder):
    monitored = (
        spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_type").alias("ticker"))
        .union(spark.read.parquet(f"{folder}/customer.parquet").select("c_mktsegment")).distinct()
    )
    b = bars.ohlc_bars(ticks(spark, folder), BAR)
    m = desk.with_asset_status(desk.ticker_metrics(desk.flagged(anomalies(spark, folder)), b, monitored))
    return m.select(
        "ticker", "anomaly_count", "price_shocks", "wash_trades", r6("max_zscore"), r6("max_risk_score"), "incident_count",
        F.unix_millis("latest_event_time").alias("latest_ms"), r6("latest_price"), r6("pct_change"), "status",
    )


@query("lookback_metrics", "A-2", "P-5", sql=LOOKBACK_SQL + f""", {TICKS_SQL}, {BARS_SQL},
m AS (SELECT DISTINCT event_type AS ticker FROM events),
l AS (SELECT p.* FROM p JOIN c USING (ticker) WHERE event_time_ms >= cutoff),
a AS (SELECT ticker, count(*) AS n, max(abs(zscore)) AS mz, max(event_time_ms) AS le FROM l GROUP BY ticker),
b AS (SELECT ticker, arg_max("close", bar_ms) AS last FROM bars WHERE bar_ms BETWEEN {NOW_MS - BACK_MS} AND {NOW_SQL} GROUP BY ticker)
SELECT ticker, coalesce(n, 0) AS anomaly_count, {s6('coalesce(mz, 0)', 'max_zscore')}, le AS latest_ms, {s6('coalesce(last, 0)', 'latest_price')}
FROM m LEFT JOIN a USING (ticker) LEFT JOIN b USING (ticker)""")
def lookback_metrics(spark, folder):
    b = bars.ohlc_bars(ticks(spark, folder), BAR).withColumn("bar_time", F.timestamp_millis("bar_ms"))
    tickers = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_type").alias("ticker")).distinct()
    m = desk.lookback_metrics(stored_anomalies(spark, folder), b, NOW, BACK_MIN, tickers)
    return m.select(
        "ticker", "anomaly_count", r6("max_zscore"), F.unix_millis("latest_event_time").alias("latest_ms"), r6("latest_price")
    )


@query("csv_round_trip", "S-4", sql=f"WITH {TICKS_SQL} SELECT ticker, event_time_ms, {s6('price')}, {s6('volume')}, label FROM ticks")
def csv_round_trip(spark, folder):
    path = f"{checkpoint_folder(spark)}/stored/{uuid.uuid4().hex}"
    t = ticks(spark, folder)
    names = [c for c in TICK_CSV.fieldNames() if c in t.columns]
    missing = {f.name: F.lit(None).cast(f.dataType) for f in TICK_CSV.fields if f.name not in t.columns}
    files.write_csv(t.select(*names).withColumns(missing).select(*TICK_CSV.fieldNames()), path)
    return files.read_ticks_csv(spark, path).select("ticker", "event_time_ms", r6("price"), r6("volume"), "label")


@query("scored_lines", "S-7", sql=f"""
WITH {ANOMALIES_SQL} SELECT ticker, event_time_ms, {s6('price')}, {s6('zscore')}, is_anomaly, anomaly_type, {s6('risk_score')}, tick_id FROM scored""")
def scored_lines(spark, folder):
    path = f"{checkpoint_folder(spark)}/stored/{uuid.uuid4().hex}"
    rows = anomalies(spark, folder).withColumn("timestamp", F.col("event_time")).select(*SCORED_COLUMNS)
    lines = rows.select(F.to_json(F.struct(*SCORED_COLUMNS)).alias("value"))
    lines.unionByName(lines.select(F.concat(F.lit("# "), "value").alias("value"))).write.text(path)
    return files.read_scored_jsonl(spark, path).select(
        "ticker", "event_time_ms", r6("price"), r6("zscore"), "is_anomaly", "anomaly_type", r6("risk_score"), "tick_id"
    )


@query("written_latency", "ST-12", sql=f"WITH {ANOMALIES_SQL} SELECT ticker, count(*) AS ticks, count(*) AS with_latency FROM scored GROUP BY ticker")
def written_latency(spark, folder):
    rows = sinks.with_written_at(anomalies(spark, folder))
    since = (F.unix_micros("written_at") - F.unix_micros("event_time")) / 1000.0
    return rows.groupBy("ticker").agg(
        F.count("*").alias("ticks"), F.count_if((F.col("latency_ms") > 0) & (F.abs(F.col("latency_ms") - since) < 1)).alias("with_latency")
    )


# every 17th message is cut off, every 19th lacks its price
@query("rejected_records", "S-3", sql=f"""
WITH {TICKS_SQL}, r AS (SELECT arrival % 4 AS "partition", CASE WHEN arrival % 17 = 0 THEN 'unreadable' WHEN arrival % 19 = 0 THEN 'incomplete' END AS reason FROM ticks)
SELECT "partition"::INTEGER AS "partition", reason, count(*) AS records FROM r WHERE reason IS NOT NULL GROUP BY ALL""")
def rejected_records(spark, folder):
    t = ticks(spark, folder).withColumn("price", F.when(F.col("arrival") % 19 != 0, F.col("price")))
    text = F.to_json(F.struct("ticker", "event_time_ms", "price", "volume"))
    raw = t.select(
        (F.col("arrival") % 4).cast("int").alias("partition"), F.col("arrival").alias("offset"),
        F.when(F.col("arrival") % 17 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value"),
    )
    return sinks.rejected_counts(log.split_records(raw)[1])


@query("audit_view", "P-13", sql=f"""
WITH {ANOMALIES_SQL}, a AS (SELECT *, {SEVERITY_SQL} AS severity FROM scored)
SELECT coalesce(incident_id, 'INC-' || md5(concat_ws('|', ticker, event_time_ms))) AS case_id,
  strftime(make_timestamp(event_time_ms * 1000), '%Y-%m-%d %H:%M:%S UTC') AS time_utc, ticker,
  CASE severity WHEN 'CRITICAL' THEN 'ESCALATED TO COMPLIANCE' WHEN 'WARNING' THEN 'UNDER REVIEW' ELSE 'AUDIT LOGGED' END AS desk_status,
  CASE anomaly_type WHEN 'price_shock' THEN 'SEC Rule 10b-5 (Excessive Volatility)' WHEN 'wash_trade' THEN 'FINRA Rule 6140 (Wash Sale / Self-Trade)'
    ELSE 'FINRA Surveillance Flag' END AS regulatory_rule, coalesce(signals, 'legacy') AS signals, {s6('price', 'price')},
  {s6('zscore', 'zscore')}, {s6('risk_score', 'risk_score')}, format('{{:,}}', volume::BIGINT) AS volume_text FROM a""")
def audit_view(spark, folder):
    # two-digit texts follow each engine's own rounding: the numbers are compared instead
    return desk.audit_view(anomalies(spark, folder), keep=("price", "zscore", "risk_score")).select(
        "case_id", "time_utc", "ticker", "desk_status", "regulatory_rule", "signals",
        r6("price"), r6("zscore"), r6("risk_score"), "volume_text",
    )


@query("alert_text", "P-11", "P-18", sql=f"""
WITH {ANOMALIES_SQL}, a AS (SELECT *, {SEVERITY_SQL} AS severity FROM scored)
SELECT tick_id, CASE WHEN anomaly_type = 'price_shock' THEN '[' || severity || '] ' || ticker || ' price ' || CASE WHEN zscore > 0 THEN 'spike' ELSE 'drop' END
  WHEN anomaly_type = 'wash_trade' THEN '[' || severity || '] ' || ticker || ' suspected wash trade'
  ELSE '[' || severity || '] ' || ticker || ' anomalous behavior detected' END AS opening,
  coalesce(', signals: ' || signals, '') AS listed FROM a""")
def alert_text(spark, folder):
    level = fn.severity("zscore", "vwap_divergence", "anomaly_type", "risk_score")
    message = fn.alert_message(
        "ticker", level, "anomaly_type", "price", "zscore", "vwap_divergence", "risk_score", "signals", F.lit(1)
    )
    # numbers in the text follow each engine's own rounding; compare the words
    words = F.regexp_extract(message, r"^(.*?)(?: to \$| at \$| \(risk)", 1)
    return anomalies(spark, folder).select(
        "tick_id", words.alias("opening"), F.regexp_extract(message, r"(, signals: [a-z_,]*[a-z_])", 1).alias("listed")
    )


ALERTS_SQL = f"""
WITH {ANOMALIES_SQL}, e AS (SELECT *, coalesce(risk_score, 0) AS risk, {SEVERITY_SQL} AS lv FROM scored WHERE is_anomaly),
o AS (SELECT *, coalesce(event_time_ms - lag(event_time_ms) OVER w > {HOUR}, TRUE) AS opens FROM e WHERE incident_id IS NULL
  WINDOW w AS (PARTITION BY ticker, anomaly_type ORDER BY event_time_ms, tick_id)),
l AS (SELECT *, anomaly_type || '@' || max(CASE WHEN opens THEN event_time_ms END) OVER (PARTITION BY ticker, anomaly_type ORDER BY event_time_ms, tick_id) AS k FROM o),
u AS (SELECT * EXCLUDE (opens) FROM l UNION ALL SELECT *, incident_id FROM e WHERE incident_id IS NOT NULL),
g AS (SELECT ticker, k, CASE WHEN bool_or(lv = 'CRITICAL') THEN 'CRITICAL' ELSE arg_min(lv, (event_time_ms, tick_id)) END AS severity,
  arg_min(anomaly_type, (event_time_ms, tick_id)) AS anomaly_type, min(event_time_ms) AS start_ms, max(event_time_ms) AS end_ms,
  arg_max(price, (event_time_ms, tick_id)) AS lp, arg_max(zscore, (abs(zscore), -event_time_ms)) AS pz, sum(volume) AS tv, count(*) AS tick_count,
  max(risk) AS pr, coalesce(arg_max(coalesce(signals, ''), (risk, -event_time_ms)), '') AS signals, any_value(incident_id) AS incident_id FROM u GROUP BY ALL)
SELECT md5(concat_ws('|', ticker, coalesce(incident_id, anomaly_type), start_ms)) AS alert_id, ticker, severity, anomaly_type, start_ms, end_ms,
  {s6('lp', 'last_price')}, {s6('pz', 'peak_zscore')}, {s6('tv', 'total_volume')}, tick_count, {s6('pr', 'peak_risk_score')}, signals, incident_id FROM g"""


@query("alert_rollup", "A-22", sql=ALERTS_SQL)
def alert_rollup(spark, folder):
    cfg = alerts.AlertConfig(burst_window_ms=HOUR)
    a = alerts.alerts_batch(desk.flagged(anomalies(spark, folder)), cfg, slices(spark, folder))
    return a.select(
        "alert_id", "ticker", "severity", "anomaly_type", F.unix_millis("start_time").alias("start_ms"),
        F.unix_millis("end_time").alias("end_ms"), r6("last_price"), r6("peak_zscore"), r6("total_volume"), "tick_count",
        r6("peak_risk_score"), "signals", "incident_id",
    )


@query("recent_alerts", "T-4", sql=ALERTS_SQL.replace("SELECT md5", ", z AS (SELECT md5") + ") SELECT alert_id, ticker, end_ms FROM z ORDER BY end_ms DESC, alert_id DESC LIMIT 50")
def recent_alerts(spark, folder):
    cfg = alerts.AlertConfig(burst_window_ms=HOUR)
    a = alerts.alerts_batch(desk.flagged(anomalies(spark, folder)), cfg, slices(spark, folder))
    return desk.recent_alerts(a, 50, "end_time").select("alert_id", "ticker", F.unix_millis("end_time").alias("end_ms"))


# --- comparing tables -------------------------------------------------------

# a changed copy of the ticks: rows missing, added, repeated and altered
OTHER_SQL = f"""{TICKS_SQL}, other AS (
  SELECT ticker, event_time_ms, arrival AS version, CASE WHEN arrival % 70 = 0 THEN price + 0.001 WHEN arrival % 71 = 0 THEN price + 1e-12 ELSE price END AS price,
         CASE WHEN arrival % 90 = 0 THEN NULL ELSE volume END AS volume, CASE WHEN arrival % 80 = 0 THEN 'changed' ELSE label END AS label
  FROM ticks WHERE arrival % 50 <> 0
  UNION ALL SELECT ticker, event_time_ms, -1 - arrival, price + 5, volume, label FROM ticks WHERE arrival % 110 = 0 AND arrival % 50 <> 0
  UNION ALL SELECT ticker, event_time_ms + 1, arrival, price, volume, label FROM ticks WHERE arrival % 130 = 0)"""


def _other(t: DataFrame) -> DataFrame:
    a = F.col("arrival")
    main = t.filter(a % 50 != 0).select(
        "ticker", "event_time_ms", a.alias("version"),
        F.when(a % 70 == 0, F.col("price") + 0.001).when(a % 71 == 0, F.col("price") + 1e-12).otherwise(F.col("price")).alias("price"),
        F.when(a % 90 != 0, F.col("volume")).alias("volume"),
        F.when(a % 80 == 0, "changed").otherwise(F.col("label")).alias("label"),
    )
    repeated = t.filter((a % 110 == 0) & (a % 50 != 0)).select(
        "ticker", "event_time_ms", (-1 - a).alias("version"), (F.col("price") + 5).alias("price"), "volume", "label"
    )
    added = t.filter(a % 130 == 0).select(
        "ticker", (F.col("event_time_ms") + 1).alias("event_time_ms"), a.alias("version"), "price", "volume", "label"
    )
    return main.unionByName(repeated).unionByName(added)


@query("frame_diff", "J-1", "U-1", sql=f"""
WITH {OTHER_SQL}, last AS (SELECT * FROM other QUALIFY row_number() OVER (PARTITION BY ticker, event_time_ms ORDER BY version DESC) = 1),
j AS (SELECT a.ticker IS NOT NULL AS l, b.ticker IS NOT NULL AS r, a.price pa, b.price pb, a.volume va, b.volume vb, a.label la, b.label lb
  FROM ticks a FULL JOIN last b ON a.ticker = b.ticker AND a.event_time_ms = b.event_time_ms)
SELECT 'matched' AS "check", count_if(l AND r)::BIGINT AS n FROM j UNION ALL SELECT 'left_only', count_if(l AND NOT r)::BIGINT FROM j
UNION ALL SELECT 'right_only', count_if(r AND NOT l)::BIGINT FROM j
UNION ALL SELECT 'field:price', count_if(l AND r AND NOT (coalesce(abs(pa - pb) <= 1e-9 * greatest(1, abs(pb)), FALSE) OR (pa IS NULL AND pb IS NULL)))::BIGINT FROM j
UNION ALL SELECT 'field:volume', count_if(l AND r AND NOT (coalesce(abs(va - vb) <= 1e-9 * greatest(1, abs(vb)), FALSE) OR (va IS NULL AND vb IS NULL)))::BIGINT FROM j
UNION ALL SELECT 'field:label', count_if(l AND r AND la IS DISTINCT FROM lb)::BIGINT FROM j
UNION ALL SELECT 'field:version', count_if(l AND r)::BIGINT FROM j
UNION ALL SELECT 'right_duplicates', CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) c FROM other GROUP BY ticker, event_time_ms HAVING count(*) > 1)""")
def frame_diff(spark, folder):
    t = ticks(spark, folder)
    summary, _ = diff.diff_frames(
        t.drop("arrival"), _other(t), ["ticker", "event_time_ms"], ["price", "volume"], ["label", "version"], right_order=["version"]
    )
    return summary


@query("frame_diff_examples", "J-1", "T-6", sql=f"""
WITH {OTHER_SQL}, last AS (SELECT * FROM other QUALIFY row_number() OVER (PARTITION BY ticker, event_time_ms ORDER BY version DESC) = 1)
SELECT 'label' AS field, a.ticker, a.event_time_ms, a.label AS left_value, b.label AS right_value FROM ticks a JOIN last b
ON a.ticker = b.ticker AND a.event_time_ms = b.event_time_ms WHERE a.label IS DISTINCT FROM b.label
QUALIFY row_number() OVER (ORDER BY a.ticker, a.event_time_ms) <= 10""")
def frame_diff_examples(spark, folder):
    t = ticks(spark, folder)
    _, examples = diff.diff_frames(t, _other(t), ["ticker", "event_time_ms"], [], ["label"], right_order=["version"])
    return examples


@query("keep_last", "U-3", sql=f"""
WITH {OTHER_SQL} SELECT ticker, event_time_ms, version FROM other QUALIFY row_number() OVER (PARTITION BY ticker, event_time_ms ORDER BY version DESC) = 1""")
def keep_last(spark, folder):
    return diff.keep_last(_other(ticks(spark, folder)), ["ticker", "event_time_ms"], ["version"]).select(
        "ticker", "event_time_ms", "version"
    )


@query("completeness", "J-7", "A-10", sql=f"""
WITH {OTHER_SQL}, a AS (SELECT DISTINCT ticker, event_time_ms FROM ticks), b AS (SELECT DISTINCT ticker, event_time_ms FROM other)
SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS missing, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS unexpected,
  (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS present""")
def completeness(spark, folder):
    t = ticks(spark, folder)
    return diff.completeness(t, _other(t), ["ticker", "event_time_ms"])


@query("missing_keys", "U-2", sql=f"WITH {OTHER_SQL} SELECT ticker, event_time_ms FROM ticks EXCEPT SELECT ticker, event_time_ms FROM other")
def missing_keys(spark, folder):
    t = ticks(spark, folder)
    return diff.missing_keys(t, _other(t), ["ticker", "event_time_ms"])


# --- log and latency --------------------------------------------------------


@query("log_message_count", "S-6", sql=f"WITH {LOG_SQL} SELECT count(*) AS messages FROM log")
def log_message_count(spark, folder):
    return quality.topic_message_count(log_records(spark, folder))


@query("log_order_report", "A-20", "W-10", sql=f"""
WITH {LOG_SQL}, v AS (SELECT *, coalesce(event_time_ms < lag(event_time_ms) OVER (PARTITION BY "partition" ORDER BY "offset"), FALSE) AS bad FROM log)
SELECT "partition", count(*) AS messages, max(event_time_ms) AS newest_ms, count_if(bad)::BIGINT AS violations, count(DISTINCT key) AS keys FROM v GROUP BY "partition" """)
def log_order_report(spark, folder):
    return quality.order_report(log_records(spark, folder))


@query("log_partition_consistency", "A-19", sql=f"""
WITH {LOG_SQL} SELECT key, count(DISTINCT "partition") AS partitions FROM log GROUP BY key HAVING count(DISTINCT "partition") > 1""")
def log_partition_consistency(spark, folder):
    return quality.partition_consistency(log_records(spark, folder))


LATENCY_SQL = f"""{TICKS_SQL}, lat AS (SELECT *, volume * 37.5 + (price - 100) * 1000 AS latency_ms FROM ticks)"""
STATS_SQL = """count(*) AS n, round(min(latency_ms), 1) + 0.0 AS "min", round(quantile_cont(latency_ms, 0.5), 1) + 0.0 AS p50, round(quantile_cont(latency_ms, 0.95), 1) + 0.0 AS p95,
  round(quantile_cont(latency_ms, 0.99), 1) + 0.0 AS p99, round(max(latency_ms), 1) + 0.0 AS "max", round(avg(latency_ms), 1) + 0.0 AS mean"""


def _latency(spark, folder):
    return ticks(spark, folder).withColumn("latency_ms", F.col("volume") * 37.5 + (F.col("price") - 100) * 1000)


@query("latency_stats", "A-11", "ST-12", sql=f"WITH {LATENCY_SQL} SELECT ticker, {STATS_SQL} FROM lat GROUP BY ticker")
def latency_stats(spark, folder):
    return quality.latency_stats(_latency(spark, folder), "latency_ms", ["ticker"])


@query("latency_stats_overall", "A-11", sql=f"WITH {LATENCY_SQL} SELECT {STATS_SQL} FROM lat")
def latency_stats_overall(spark, folder):
    return quality.latency_stats(_latency(spark, folder), "latency_ms")


@query("latency_by_phase", "A-12", sql=f"""
WITH {LATENCY_SQL}, p AS (SELECT *, CASE WHEN event_time_ms < {NOW_MS} THEN 'before' WHEN event_time_ms < {NOW_MS + 48 * HOUR} THEN 'during' ELSE 'after' END AS phase FROM lat)
SELECT phase, count(*) AS ticks, round(quantile_cont(latency_ms, 0.5), 1) + 0.0 AS p50, round(quantile_cont(latency_ms, 0.95), 1) + 0.0 AS p95,
  round(quantile_cont(latency_ms, 0.99), 1) + 0.0 AS p99, round(max(latency_ms), 1) + 0.0 AS "max" FROM p GROUP BY phase""")
def latency_by_phase(spark, folder):
    return quality.latency_by_phase(_latency(spark, folder), "latency_ms", "event_time_ms", NOW_MS, NOW_MS + 48 * HOUR)


@query("throughput", "A-13", sql=f"""
WITH {TICKS_SQL} SELECT count(*) AS "rows", {s6('(max(event_time_ms) - min(event_time_ms)) / 1000.0', 'span_s')},
  round(count(*) / ((max(event_time_ms) - min(event_time_ms)) / 1000.0), 1) + 0.0 AS rows_per_s FROM ticks""")
def throughput(spark, folder):
    return quality.throughput(ticks(spark, folder), "event_time_ms").select("rows", r6("span_s"), "rows_per_s")


@query("price_percentiles", "A-11", "A-17", sql=f"""
WITH {TICKS_SQL} SELECT ticker, count(*) AS n, {s6('quantile_cont(price, 0.01)', 'p01')}, {s6('quantile_cont(price, 0.3)', 'p30')}, {s6('quantile_cont(price, 0.999)', 'p999')}
FROM ticks GROUP BY ticker""")
def price_percentiles(spark, folder):
    p = exact_percentiles(ticks(spark, folder), "price", {"p01": 0.01, "p30": 0.3, "p999": 0.999}, ["ticker"])
    return p.select("ticker", "n", r6("p01"), r6("p30"), r6("p999"))


# --- evaluation -------------------------------------------------------------

SPAN_SQL = f"""{indexed_sql(GAP_MS)},
spans AS (SELECT i.ticker, i.pos AS start_pos, least(i.pos + CASE i.label WHEN 'price_shock' THEN 5 ELSE 9 END, l.last + 1) AS end_pos, i.label AS kind, i.event_time_ms AS start_ms
  FROM idx i JOIN (SELECT ticker, session_id, max(pos) AS last FROM idx GROUP BY ALL) l USING (ticker, session_id) WHERE i.label <> 'normal'),
inside AS (SELECT *, unnest(generate_series(start_pos, end_pos - 1)) AS pos FROM spans)"""
# flags: a fixed rule on volume and price, so that the scoring itself is compared
FLAGS_SQL = """flags AS (
  SELECT ticker, event_time_ms, pos, session_id, tick_id, CASE WHEN price > 100.12 THEN 'price_shock' ELSE 'wash_trade' END AS anomaly_type,
         concat_ws('-', ticker, event_time_ms // 14400000 * 14400000) AS incident_id
  FROM idx WHERE price > 100.12 OR volume > 95)"""


def _indexed(spark, folder):
    # read several times by every query below, so it is written once
    return cut_lineage(tk.indexed(ticks(spark, folder), GAP_MS, slices(spark, folder)))


def _scored(idx: DataFrame) -> DataFrame:
    shock, wash = F.col("price") > 100.12, F.col("volume") > 95
    return idx.withColumns(
        {
            "is_anomaly": shock | wash,
            "anomaly_type": F.when(shock, "price_shock").when(wash, "wash_trade"),
            "incident_id": F.when(
                shock | wash, F.concat_ws("-", "ticker", F.floor(F.col("event_time_ms") / 14_400_000) * 14_400_000)
            ),
        }
    )


@query("event_spans", "D-3", sql=f"WITH {SPAN_SQL} SELECT ticker, start_pos, end_pos, kind, start_ms FROM spans")
def event_spans(spark, folder):
    return evaluate.original_spans(tk.indexed(ticks(spark, folder), GAP_MS, slices(spark, folder)))


COVER_SQL = f"""{indexed_sql(GAP_MS)}, {FLAGS_SQL},
ev AS (SELECT ticker, pos AS start_pos, label AS kind, unnest(generate_series(pos, pos + CASE label WHEN 'price_shock' THEN 4 ELSE 8 END)) AS p FROM idx WHERE label <> 'normal'),
cov AS (SELECT ticker, p AS pos, max(start_pos) AS event_pos, arg_max(kind, start_pos) AS event_kind FROM ev GROUP BY ALL)"""


@query("covered_ticks", "J-3", sql=f"WITH {COVER_SQL} SELECT ticker, pos, event_pos, event_kind FROM cov")
def covered_ticks(spark, folder):
    return evaluate.cover_events(evaluate.labelled_events(tk.with_pos(ticks(spark, folder), slices(spark, folder))))


@query("located_flags", "J-2", sql=f"""
WITH {indexed_sql(GAP_MS)}, {FLAGS_SQL}, moved AS (SELECT ticker, event_time_ms + CASE WHEN pos % 20 = 0 THEN 1 ELSE 0 END AS event_time_ms, tick_id FROM flags)
SELECT m.ticker, m.tick_id, i.pos, i.label FROM moved m LEFT JOIN idx i ON m.ticker = i.ticker AND m.event_time_ms = i.event_time_ms""")
def located_flags(spark, folder):
    idx = _indexed(spark, folder)
    moved = F.col("event_time_ms") + F.when(F.col("pos") % 20 == 0, 1).otherwise(0)
    flags = _scored(idx).filter("is_anomaly").select("ticker", moved.alias("event_time_ms"), "tick_id")
    return evaluate.locate_flags(idx, flags).select("ticker", "tick_id", "pos", "label")


@query("label_scores", "A-5", "A-6", "J-2", "J-3", "U-5", sql=f"""
WITH {COVER_SQL}, j AS (SELECT f.*, i.label, c.event_pos, coalesce(c.event_kind, 'normal') AS ek FROM flags f JOIN idx i USING (ticker, pos) LEFT JOIN cov c USING (ticker, pos)),
k AS (SELECT unnest(['any', 'price_shock', 'wash_trade']) AS kind),
x AS (SELECT k.kind, j.*, CASE WHEN k.kind = 'any' THEN label <> 'normal' ELSE label = k.kind END AS ht, CASE WHEN k.kind = 'any' THEN ek <> 'normal' ELSE ek = k.kind END AS he
  FROM k JOIN j ON k.kind = 'any' OR j.anomaly_type = k.kind),
g AS (SELECT kind, count(*) AS flags, count_if(ht) AS tt, count_if(he) AS et, count(DISTINCT CASE WHEN he THEN (ticker, event_pos) END) AS ef,
  count(DISTINCT incident_id) AS inc, count(DISTINCT CASE WHEN he THEN incident_id END) AS ti FROM x GROUP BY kind),
e AS (SELECT k.kind, count(*) AS events FROM k JOIN idx ON label <> 'normal' AND (k.kind = 'any' OR label = k.kind) GROUP BY k.kind),
r AS (SELECT kind, flags, events, ef, inc, ti, round(tt / flags, 4) tp, round(tt / events, 4) tr, round(et / flags, 4) ep, round(ef / events, 4) er, round(ti / inc, 4) ip FROM g JOIN e USING (kind))
SELECT kind, flags, events, ef AS events_found, inc AS incidents, ti AS true_incidents, tp AS tick_precision, tr AS tick_recall,
  CASE WHEN tp <> 0 AND tr <> 0 THEN round(2 * tp * tr / (tp + tr), 4) END AS tick_f1, ep AS event_precision, er AS event_recall,
  CASE WHEN ep <> 0 AND er <> 0 THEN round(2 * ep * er / (ep + er), 4) END AS event_f1, ip AS incident_precision FROM r""")
def label_scores(spark, folder):
    idx = _indexed(spark, folder)
    flags = _scored(idx).filter("is_anomaly").select("ticker", "pos", "event_time_ms", "anomaly_type", "incident_id")
    return evaluate.score_against_labels(idx, flags)


@query("tick_metrics", "A-4", "A-5", sql=f"""
WITH {TICKS_SQL}, f AS (SELECT *, price > 100.12 AS s, volume > 95 AND NOT price > 100.12 AS w FROM ticks),
c AS (SELECT 'price_shock' AS kind, count_if(s AND label = 'price_shock') AS tp, count_if(s) AS nf, count_if(label = 'price_shock') AS np FROM f
  UNION ALL SELECT 'wash_trade', count_if(w AND label = 'wash_trade'), count_if(w), count_if(label = 'wash_trade') FROM f
  UNION ALL SELECT 'any', count_if((s OR w) AND label <> 'normal'), count_if(s OR w), count_if(label <> 'normal') FROM f),
p AS (SELECT kind, nf::BIGINT AS flagged, coalesce(tp / nullif(nf, 0), 0) p, coalesce(tp / nullif(np, 0), 0) r FROM c)
SELECT kind, flagged, {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')} FROM p""")
def tick_metrics(spark, folder):
    shock = F.col("price") > 100.12
    rows = ticks(spark, folder).withColumn("s", shock).withColumn("w", (F.col("volume") > 95) & ~shock)
    m = evaluate.tick_metrics(rows, "s", "w")
    return m.select("kind", "flagged", r6("precision"), r6("recall"), r6("f1"))


@query("event_metrics", "A-7", "J-4", sql=f"""
WITH {SPAN_SQL}, {FLAGS_SQL}, cv AS (SELECT ticker, pos, list(DISTINCT kind) AS kinds FROM inside GROUP BY ALL),
k AS (SELECT DISTINCT kind FROM spans),
x AS (SELECT k.kind, coalesce(list_contains(kinds, k.kind), FALSE) AS own, kinds IS NULL AS free FROM flags f JOIN k ON f.anomaly_type = k.kind LEFT JOIN cv USING (ticker, pos)),
g AS (SELECT kind, count_if(own) AS tp, count_if(own OR free) AS nf FROM x GROUP BY kind),
d AS (SELECT i.kind, count(DISTINCT (i.ticker, start_pos)) AS det FROM inside i JOIN flags f ON i.ticker = f.ticker AND i.pos = f.pos AND i.kind = f.anomaly_type GROUP BY i.kind),
e AS (SELECT kind, count(*) AS events FROM spans GROUP BY kind),
p AS (SELECT kind, events, coalesce(det, 0) AS det, coalesce(tp / nullif(nf, 0), 0) AS p, coalesce(det, 0) / events AS r FROM e LEFT JOIN g USING (kind) LEFT JOIN d USING (kind))
SELECT kind, events, det AS detected, {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')} FROM p""")
def event_metrics(spark, folder):
    idx = _indexed(spark, folder)
    m = evaluate.event_metrics(evaluate.flag_families(_scored(idx)), evaluate.original_spans(idx))
    return m.select("kind", "events", "detected", r6("precision"), r6("recall"), r6("f1"))


INCIDENTS_SQL = f"""{SPAN_SQL}, {FLAGS_SQL},
h AS (SELECT ticker, coalesce(sum(CASE WHEN gap_ms <= {GAP_MS} THEN gap_ms END), 0) / 3600000.0 AS hours FROM idx GROUP BY ticker),
hit AS (SELECT incident_id, any_value(f.ticker) AS ticker, bool_or(i.pos IS NOT NULL) AS ok FROM flags f LEFT JOIN (SELECT DISTINCT ticker, pos FROM inside) i ON f.ticker = i.ticker AND f.pos = i.pos GROUP BY incident_id)"""


@query("incident_metrics", "A-8", sql=f"""
WITH {INCIDENTS_SQL}
SELECT {s6('(SELECT count(*) FROM flags) / (SELECT count(*) FROM idx)', 'flag_rate')}, (SELECT count(*) FROM hit) AS incidents,
  {s6('(SELECT avg(CAST(ok AS DOUBLE)) FROM hit)', '"precision"')},
  {s6('(SELECT count(DISTINCT (i.ticker, i.start_pos)) FROM inside i JOIN flags f ON i.ticker = f.ticker AND i.pos = f.pos) / (SELECT count(*) FROM spans)', 'event_recall')},
  {s6('(SELECT count(*) FROM hit) / (SELECT sum(hours) FROM h)', 'total_per_hour')}""")
def incident_metrics(spark, folder):
    idx = _indexed(spark, folder)
    hours = evaluate.trading_hours(ticks(spark, folder), GAP_MS, slices(spark, folder))
    overall, _ = evaluate.incident_metrics(_scored(idx), evaluate.original_spans(idx), hours)
    return overall.select(r6("flag_rate"), "incidents", r6("precision"), r6("event_recall"), r6("total_per_hour"))


@query("incidents_per_ticker", "A-8", "A-9", "J-9", sql=f"""
WITH {INCIDENTS_SQL} SELECT h.ticker, {s6('hours')}, coalesce(n, 0) AS incidents, {s6('coalesce(n, 0) / hours', 'alerts_per_hour')}
FROM h LEFT JOIN (SELECT ticker, count(*) AS n FROM hit GROUP BY ticker) USING (ticker)""")
def incidents_per_ticker(spark, folder):
    idx = _indexed(spark, folder)
    hours = evaluate.trading_hours(ticks(spark, folder), GAP_MS, slices(spark, folder))
    _, per = evaluate.incident_metrics(_scored(idx), evaluate.original_spans(idx), hours)
    return per.select("ticker", r6("hours"), "incidents", r6("alerts_per_hour"))


@query("restricted_events", "D-4", sql=f"""
WITH {SPAN_SQL}, c AS (SELECT quantile_cont(CAST(event_time_ms AS DOUBLE), 0.7) AS cutoff FROM ticks)
SELECT ticker, start_pos, kind FROM spans, c WHERE start_ms > cutoff""")
def restricted_events(spark, folder):
    idx = _indexed(spark, folder)
    test = tk.period_mask(idx).filter(F.col("period") == "test")
    _, spans = evaluate.restrict(evaluate.flag_families(_scored(idx)), evaluate.original_spans(idx), test)
    return spans.select("ticker", "start_pos", "kind")


@query("session_sigma", "A-18", sql=f"""
WITH {indexed_sql(GAP_MS)} SELECT ticker, session_id, {s6('greatest(coalesce(stddev_samp(price_diff), 1e-4), 1e-4)', 'sigma')},
  {s6('greatest(coalesce(stddev_pop(price_diff), 1e-4), 1e-4)', 'sigma_pop')} FROM idx GROUP BY ALL""")
def session_sigma(spark, folder):
    idx = _indexed(spark, folder)
    sample = quality.session_sigma(idx)
    population = quality.session_sigma(idx, population=True).withColumnRenamed("sigma", "sigma_pop")
    return sample.join(population, ["ticker", "session_id"]).select("ticker", "session_id", r6("sigma"), r6("sigma_pop"))


@query("random_baseline", "A-16", sql=f"""
WITH {TICKS_SQL}, c AS (SELECT avg(CAST(label <> 'normal' AS DOUBLE)) AS p, avg(CAST(volume > 95 AS DOUBLE)) AS r,
  count_if(volume > 95 AND label <> 'normal') / count_if(volume > 95) AS own FROM ticks)
SELECT {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6('2 * p * r / (p + r)', 'f1')}, {s6('own / p', 'lift')} FROM c""")
def random_baseline(spark, folder):
    hit, flag = F.col("label") != "normal", F.col("volume") > 95
    c = ticks(spark, folder).agg(
        F.avg(hit.cast("double")).alias("prevalence"), F.avg(flag.cast("double")).alias("flag_rate"),
        fn.rate(F.count_if(hit & flag), F.count_if(flag)).alias("own"),
    )
    out = c.withColumns(fn.random_baseline("flag_rate", "prevalence"))
    return out.select(r6("precision"), r6("recall"), r6("f1"), r6(F.try_divide("own", "prevalence"), "lift"))


# --- tuning -----------------------------------------------------------------

Z_SQL = f"""{TICKS_SQL}, cut AS (SELECT quantile_cont(CAST(event_time_ms AS DOUBLE), 0.7) AS cutoff FROM ticks),
w AS (SELECT *, count(*) OVER p n, avg(price) OVER p m, stddev_pop(price) OVER p sd FROM ticks WINDOW p AS {PREVIOUS_20}),
z AS (SELECT ticker, arrival, label = 'price_shock' AS y, CASE WHEN event_time_ms <= cutoff THEN 'train' ELSE 'test' END AS period,
  coalesce(CASE WHEN n >= 10 THEN CASE WHEN sd > 1e-9 THEN abs(price - m) / sd ELSE 0 END END, -1) AS s FROM w, cut)"""
GRID_SQL = "grid AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS grid_pos, unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5]) AS threshold)"
GRID = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5)
PRF_SQL = "coalesce(tp / nullif(nf, 0), 0) AS p, coalesce(tp / nullif(np, 0), 0) AS r"


def _z_scores(spark, folder, *columns):
    t = ticks(spark, folder)
    t = tk.period_mask(t) if "period" in columns else t
    z = signals.rolling_z(t, 20, 10, slices(spark, folder))
    return z.select(*columns, (F.col("label") == "price_shock").alias("y"), F.abs("zscore").alias("s"))


@query("threshold_sweep", "J-8", "A-4", sql=f"""
WITH {Z_SQL}, {GRID_SQL}, c AS (SELECT grid_pos, threshold, count_if(y AND s > threshold) tp, count_if(s > threshold) nf, count_if(y) np FROM grid, z GROUP BY ALL),
q AS (SELECT *, {PRF_SQL} FROM c)
SELECT CAST(grid_pos AS INTEGER) AS grid_pos, CAST(threshold AS DOUBLE) AS threshold, tp::BIGINT AS tp, nf::BIGINT AS n_flag, np::BIGINT AS n_pos, {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')} FROM q""")
def threshold_sweep(spark, folder):
    rows = tuning.with_prf(tuning.sweep(_z_scores(spark, folder), "s", "y", GRID))
    return rows.select("grid_pos", "threshold", "tp", "n_flag", "n_pos", r6("precision"), r6("recall"), r6("f1"))


@query("best_threshold", "A-14", sql=f"""
WITH {Z_SQL}, {GRID_SQL}, c AS (SELECT period, grid_pos, threshold, count_if(y AND s > threshold) tp, count_if(s > threshold) nf, count_if(y) np FROM grid, z GROUP BY ALL),
q AS (SELECT *, {PRF_SQL} FROM c), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM q)
SELECT period, CAST(arg_max(threshold, (f1, -grid_pos)) AS DOUBLE) AS threshold, {s6('max(f1)', 'f1')} FROM f GROUP BY period""")
def best_threshold(spark, folder):
    rows = tuning.with_prf(tuning.sweep(_z_scores(spark, folder, "period"), "s", "y", GRID, ["period"]))
    return tuning.best(rows, by=["period"]).select("period", "threshold", r6("f1"))


@query("pr_curve", "A-25", sql=f"""
WITH {Z_SQL}, grid AS (SELECT unnest(generate_series(0, 12)) AS grid_pos), g2 AS (SELECT grid_pos, 2.0 + grid_pos * 0.5 AS threshold FROM grid),
c AS (SELECT period, grid_pos, threshold, count_if(y AND s > threshold) tp, count_if(s > threshold) nf, count_if(y) np FROM g2, z GROUP BY ALL), q AS (SELECT *, {PRF_SQL} FROM c)
SELECT period, CAST(threshold AS DOUBLE) AS threshold, {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')} FROM q""")
def pr_curve(spark, folder):
    rows = tuning.pr_curve(_z_scores(spark, folder, "period"), "s", "y")
    return rows.select("period", "threshold", r6("precision"), r6("recall"), r6("f1"))


@query("leave_one_ticker_out_z", "A-24", sql=f"""
WITH {Z_SQL}, {GRID_SQL}, c AS (SELECT ticker, grid_pos, threshold, count_if(y AND s > threshold) tp, count_if(s > threshold) nf, count_if(y) np FROM grid, z GROUP BY ALL),
t AS (SELECT grid_pos, sum(tp) a, sum(nf) b, sum(np) d FROM c GROUP BY grid_pos),
o AS (SELECT ticker, grid_pos, threshold, a - tp AS tp, b - nf AS nf, d - np AS np FROM c JOIN t USING (grid_pos)),
of AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM (SELECT *, {PRF_SQL} FROM o)),
cf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM (SELECT *, {PRF_SQL} FROM c)),
tuned AS (SELECT ticker, arg_max(threshold, (f1, -grid_pos)) AS threshold FROM of GROUP BY ticker),
own AS (SELECT ticker, arg_max(threshold, (f1, -grid_pos)) AS threshold, max(f1) AS f1 FROM cf GROUP BY ticker)
SELECT tuned.ticker, CAST(tuned.threshold AS DOUBLE) AS tuned_threshold, {s6('cf.f1', 'held_out_f1')}, CAST(own.threshold AS DOUBLE) AS own_threshold, {s6('own.f1', 'own_f1')}
FROM tuned JOIN cf ON cf.ticker = tuned.ticker AND cf.threshold = tuned.threshold JOIN own ON own.ticker = tuned.ticker""")
def leave_one_ticker_out_z(spark, folder):
    counts = tuning.sweep(_z_scores(spark, folder, "ticker"), "s", "y", GRID, ["ticker"])
    out = tuning.leave_one_out(counts)
    return out.select("ticker", "tuned_threshold", r6("held_out_f1"), "own_threshold", r6("own_f1"))


@query("naive_tuning", "A-17", sql=f"""
WITH {TICKS_SQL}, r AS (SELECT *, coalesce(abs(price / lag(price) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival) - 1), 0.0) AS ret FROM ticks),
q AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS grid_pos, unnest(quantile_cont(ret, [0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999])) AS tr,
  unnest(quantile_cont(volume, [0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999])) AS tv FROM r),
c AS (SELECT 'price_shock' AS kind, grid_pos, tr AS threshold, count_if(ret > tr AND label = 'price_shock') tp, count_if(ret > tr) nf, count_if(label = 'price_shock') np FROM q, r GROUP BY ALL
  UNION ALL SELECT 'wash_trade', grid_pos, tv, count_if(volume > tv AND label = 'wash_trade'), count_if(volume > tv), count_if(label = 'wash_trade') FROM q, r GROUP BY ALL),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM (SELECT *, {PRF_SQL} FROM c))
SELECT kind, {s6('arg_max(threshold, (f1, -grid_pos))', 'threshold')}, {s6('max(f1)', 'f1')} FROM f GROUP BY kind""")
def naive_tuning(spark, folder):
    rows = tuning.tune_naive(tk.with_return(ticks(spark, folder), slices(spark, folder)))
    return rows.select("kind", r6("threshold"), r6("f1"))


@query("guarded_choice", "A-15", sql=f"""
WITH {TICKS_SQL}, g AS (SELECT unnest([0, 1, 2, 3]) AS grid_pos, unnest([100.05, 100.08, 100.12, 100.2]) AS a, unnest([99.0, 97.0, 95.0, 60.0]) AS b),
c AS (SELECT grid_pos, 'price_shock' AS kind, count_if(price > a AND label = 'price_shock') tp, count_if(price > a) nf, count_if(label = 'price_shock') np FROM g, ticks GROUP BY ALL
 UNION ALL SELECT grid_pos, 'wash_trade', count_if(volume > b AND label = 'wash_trade'), count_if(volume > b), count_if(label = 'wash_trade') FROM g, ticks GROUP BY ALL),
f AS (SELECT grid_pos, kind, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM (SELECT *, {PRF_SQL} FROM c)),
ok AS (SELECT f.grid_pos FROM f JOIN f base ON base.grid_pos = 2 AND base.kind = f.kind GROUP BY f.grid_pos HAVING bool_and(f.kind = 'price_shock' OR f.f1 >= base.f1 - 0.005))
SELECT CAST(arg_max(f.grid_pos, (f1, -f.grid_pos)) AS INTEGER) AS grid_pos, {s6('max(f1)', 'f1')} FROM f JOIN ok USING (grid_pos) WHERE kind = 'price_shock'""")
def guarded_choice(spark, folder):
    t = ticks(spark, folder)
    a, b = (100.05, 100.08, 100.12, 100.2), (60.0, 95.0, 97.0, 99.0)
    price = tuning.with_prf(tuning.sweep(t, "price", F.col("label") == "price_shock", a))
    volume = tuning.with_prf(tuning.sweep(t, "volume", F.col("label") == "wash_trade", b))
    rows = price.withColumn("kind", F.lit("price_shock")).unionByName(
        volume.withColumn("kind", F.lit("wash_trade")).withColumn("grid_pos", 3 - F.col("grid_pos"))
    )
    base = rows.filter(F.col("grid_pos") == 2)
    return tuning.best_guarded(rows, base).select("grid_pos", r6("f1"))

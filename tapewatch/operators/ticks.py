"""Tick tables: time columns, sessions, ids, positions, periods, replay times.

A tick table has at least ``ticker, event_time_ms, price, volume`` and an
``arrival`` column that orders ticks of the same millisecond.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.quantiles import exact_percentiles
from tapewatch.operators.slices import (
    SLICE,
    Slicing,
    drop_halo,
    ranked,
    running_sum,
    with_carry,
    with_previous_rows,
)

TICKS = Slicing()


def event_time(ms: str | Column = "event_time_ms") -> Column:
    return F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms)


def utc_day(time: str | Column = "event_time") -> Column:
    """UTC date of a timestamp (the session time zone is UTC)."""
    return F.to_date(F.col(time) if isinstance(time, str) else time)


def detector_input(ticks: DataFrame) -> DataFrame:
    """What a detector may see: the ground truth is dropped."""
    return ticks.drop("label").withColumn("event_time", event_time())


def slice_days(ticks: DataFrame, days: Iterable[str | date]) -> DataFrame:
    """Ticks of the given UTC days. Asking for a day without ticks is an
    error; the check returns at most one row per requested day."""
    wanted = sorted({str(d) for d in days})
    day = utc_day(event_time())
    kept = ticks.filter(day.isin([date.fromisoformat(d) for d in wanted]))
    found = {str(r[0]) for r in kept.select(day.alias("day")).distinct().collect()}
    missing = [d for d in wanted if d not in found]
    if missing:
        raise ValueError(f"no ticks on {missing}")
    return kept


def days_covered(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per UTC day that each time range touches."""
    return ranges.withColumn("day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))


def with_previous(ticks: DataFrame, s: Slicing = TICKS, **columns: str) -> DataFrame:
    """Adds, per ``new=old`` pair, the old column of the previous tick.
    The result keeps the ``slice_id`` column."""
    w = s.window()
    halo = with_previous_rows(ticks, 1, s, list(columns.values()))
    return drop_halo(halo.select("*", *[F.lag(old).over(w).alias(new) for new, old in columns.items()]))


def with_gap(ticks: DataFrame, s: Slicing = TICKS, cap_ms: int = 60_000) -> DataFrame:
    """Time since the previous tick of the ticker, raw and capped."""
    out = with_previous(ticks, s, _prev_ms=s.time)
    gap = F.col(s.time) - F.col("_prev_ms")
    return out.select(
        "*", gap.alias("gap_ms"), F.when(gap.isNotNull(), F.least(gap, F.lit(cap_ms))).alias("capped_gap_ms")
    ).drop("_prev_ms", "slice_id")


def with_session(ticks: DataFrame, gap_ms: int, s: Slicing = TICKS) -> DataFrame:
    """``session_id`` counts, per ticker, the gaps longer than ``gap_ms`` so far."""
    prev = with_previous(ticks, s, _prev_ms=s.time)
    opens = F.coalesce(F.col(s.time) - F.col("_prev_ms") > gap_ms, F.lit(False)).cast("long")
    return running_sum(prev.withColumn("_opens", opens), s, session_id="_opens").drop(
        "_opens", "_prev_ms", "slice_id"
    )


def with_tick_id(ticks: DataFrame, s: Slicing = TICKS) -> DataFrame:
    """``ms_seq`` counts earlier ticks of the ticker in the same millisecond;
    ``tick_id`` is ticker-ms-seq. Equal times share a slice, so the windows
    need no halo."""
    base = s.assign(ticks)
    seq = F.row_number().over(s.window()) - F.rank().over(s.window(s.time))
    return base.withColumn("ms_seq", seq.cast("long")).withColumn(
        "tick_id", F.concat_ws("-", F.col("ticker"), F.col(s.time), F.col("ms_seq"))
    ).drop("slice_id")


def with_pos(ticks: DataFrame, s: Slicing = TICKS, name: str = "pos") -> DataFrame:
    """0-based position of each tick in its ticker."""
    return ranked(s.assign(ticks), s, name).drop("slice_id")


def with_return(ticks: DataFrame, s: Slicing = TICKS) -> DataFrame:
    """Absolute tick-to-tick return, 0 for the first tick."""
    out = with_previous(ticks, s, _prev_price="price")
    return out.withColumn(
        "abs_return", F.coalesce(F.abs(F.col("price") / F.col("_prev_price") - 1), F.lit(0.0))
    ).drop("_prev_price", "slice_id")


def _opens(session_gap_ms: int) -> Column:
    return F.coalesce(F.col("gap_ms") > session_gap_ms, F.lit(False))


def number_ticks(sliced: DataFrame, ticks: DataFrame, session_gap_ms: int, s: Slicing = TICKS) -> DataFrame:
    """pos, session_id, ms_seq and tick_id for sliced ticks that carry
    ``gap_ms``. The slice totals come from a pass over the time column of the
    plain ``ticks``, not from the wide frame."""
    narrow = with_previous(ticks.select(*dict.fromkeys([*s.keys, *s.order])), s, _prev_ms=s.time)
    narrow = narrow.withColumn("gap_ms", F.col(s.time) - F.col("_prev_ms")).withColumn(
        "_opens", _opens(session_gap_ms).cast("long")
    )
    base = sliced.withColumn("_opens", _opens(session_gap_ms).cast("long"))
    carried = with_carry(
        base, s, {"_n": F.count("*"), "_s": F.sum("_opens")}, {"_n": F.sum, "_s": F.sum}, source=narrow
    )
    w = s.window()
    row = F.row_number().over(w)
    running = F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = carried.select(
        "*",
        (F.coalesce(F.col("_n"), F.lit(0)) + row - 1).alias("pos"),
        (F.coalesce(F.col("_s"), F.lit(0)) + running).alias("session_id"),
        (row - F.rank().over(s.window(s.time))).cast("long").alias("ms_seq"),
    )
    return numbered.withColumn(
        "tick_id", F.concat_ws("-", F.col("ticker"), F.col(s.time), F.col("ms_seq"))
    ).drop("_opens", "_n", "_s", SLICE)


def with_step(halo: DataFrame, session_gap_ms: int, s: Slicing = TICKS) -> DataFrame:
    """``gap_ms`` and ``price_diff`` (null across sessions) to the previous
    tick; the input still has its halo rows."""
    w = s.window()
    gap = F.col(s.time) - F.lag(s.time).over(w)
    diff = F.col("price") - F.lag("price").over(w)
    return halo.select("*", gap.alias("gap_ms"), diff.alias("price_diff")).withColumn(
        "price_diff", F.when(~_opens(session_gap_ms), F.col("price_diff"))
    )


def indexed(ticks: DataFrame, session_gap_ms: int, s: Slicing = TICKS) -> DataFrame:
    """pos, session_id, gap_ms, price_diff, ms_seq and tick_id in one pass over
    the timeline (each separate call would repeat the shuffle)."""
    halo = with_previous_rows(ticks, 1, s, ["price"])
    return number_ticks(drop_halo(with_step(halo, session_gap_ms, s)), ticks, session_gap_ms, s)


def with_side(ticks: DataFrame, scope: str = "ticker", s: Slicing = TICKS) -> DataFrame:
    """buy when the price did not fall since the previous tick, else sell; the
    first tick is a buy. ``scope="global"`` compares with the previous tick of
    any ticker, still without a single-partition window."""
    if scope not in ("ticker", "global"):
        raise ValueError("scope is 'ticker' or 'global'")
    timeline = s if scope == "ticker" else s.by(keys=())
    out = with_previous(ticks, timeline, _prev_price="price")
    diff = F.coalesce(F.col("price") - F.col("_prev_price"), F.lit(0.0))
    return out.withColumn("side", F.when(diff >= 0, "buy").otherwise("sell")).drop("_prev_price", "slice_id")


def replay_schedule(
    ticks: DataFrame,
    speed: float = 50.0,
    max_gap_s: float | None = 2.0,
    scope: str = "global",
    live_start_ms: int | None = None,
    s: Slicing = TICKS,
) -> DataFrame:
    """``target_s``: seconds after the start at which a replay sends the tick,
    with every pause capped at ``max_gap_s`` real seconds. With
    ``live_start_ms`` also ``live_ms``, the restamped event time."""
    timeline = s if scope == "ticker" else s.by(keys=())
    prev = with_previous(ticks, timeline, _prev_ms=s.time)
    gap = F.coalesce(F.col(s.time) - F.col("_prev_ms"), F.lit(0))
    step = gap if max_gap_s is None else F.least(gap.cast("double"), F.lit(max_gap_s * 1000.0 * speed))
    timed = running_sum(prev.withColumn("_step", step), timeline, _elapsed="_step")
    target = F.col("_elapsed") / 1000.0 / speed
    out = timed.withColumn("target_s", target)
    if live_start_ms is not None:
        out = out.withColumn("live_ms", (F.lit(live_start_ms) + target * 1000.0).cast("long"))
    return out.drop("_prev_ms", "_step", "_elapsed", "slice_id")


def split_time(ticks: DataFrame, fraction: float = 0.7) -> DataFrame:
    """One row: the time below which ``fraction`` of the ticks lie."""
    return exact_percentiles(ticks, "event_time_ms", {"cutoff_ms": fraction})


def late_mask(ticks: DataFrame, arrival: str = "arrival", per_slice: int = 1_000_000, s: Slicing = TICKS) -> DataFrame:
    """Adds ``is_late``: whether a tick is older than the newest of its ticker
    that arrived before, as the stream drops it. Equal times are not late, and
    ticks with one ``arrival`` (a micro-batch) are not late to each other. The
    running maximum is folded over slices of ``per_slice`` arrivals."""
    line = s.by(width_ms=per_slice, time=arrival, tie=())
    newest = F.max(s.time)
    sliced = with_carry(line.assign(ticks), line, {"_before": newest}, {"_before": F.max})
    inside = newest.over(line.window().rangeBetween(Window.unboundedPreceding, -1))
    late = F.col(s.time) < F.greatest("_before", inside)
    return sliced.withColumn("is_late", F.coalesce(late, F.lit(False))).drop("_before", "slice_id")


def drop_late(ticks: DataFrame, arrival: str = "arrival", per_slice: int = 1_000_000, s: Slicing = TICKS) -> DataFrame:
    """The ticks that a stream would score (``late_mask``)."""
    return late_mask(ticks, arrival, per_slice, s).filter(~F.col("is_late")).drop("is_late")


def period_mask(ticks: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Adds ``period``: train up to the cutoff (included), test after it."""
    cutoff = split_time(ticks, fraction).select("cutoff_ms").scalar()
    return ticks.withColumn("period", F.when(F.col("event_time_ms") <= cutoff, "train").otherwise("test"))

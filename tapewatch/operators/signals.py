"""Detector signals that are plain window expressions, risk and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.slices import (
    GREATEST,
    LEAST,
    SLICE,
    SUM,
    Slicing,
    drop_halo,
    trailing_ranges,
    with_carry,
    with_previous_rows,
    within_span,
)
from tapewatch.operators.ticks import TICKS
from tapewatch.params import PRICE_SIGNALS, SIGNALS, VOLUME_SIGNALS

EPS = 1e-9


def _rolling_z_columns(w, min_n: int) -> Column:
    n, mean, std = F.count("price").over(w), F.avg("price").over(w), F.stddev_pop("price").over(w)
    return F.when(n >= min_n, F.when(std > EPS, (F.col("price") - mean) / std).otherwise(0.0))


def _rolling_vwap_column(w) -> Column:
    return F.sum(F.col("price") * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0))


def rolling_z(ticks: DataFrame, n: int = 20, min_n: int = 10, s: Slicing = TICKS) -> DataFrame:
    """z-score against the previous n ticks (this one excluded, population
    standard deviation), null below ``min_n`` ticks, 0 for a flat window."""
    halo = with_previous_rows(ticks, n, s, ["price"])
    w = s.window().rowsBetween(-n, -1)
    return drop_halo(halo.withColumn("zscore", _rolling_z_columns(w, min_n))).drop(SLICE)


def _divergence(vwap: Column) -> Column:
    return F.when(vwap > EPS, F.abs(F.col("price") - vwap) / vwap)


def rolling_vwap(ticks: DataFrame, n: int = 20, min_n: int = 1, s: Slicing = TICKS) -> DataFrame:
    """VWAP of the previous n ticks and the price's relative distance to it."""
    halo = with_previous_rows(ticks, n, s, ["price", "volume"])
    w = s.window().rowsBetween(-n, -1)
    halo = halo.withColumn("vwap", F.when(F.count("price").over(w) >= min_n, _rolling_vwap_column(w)))
    return drop_halo(halo.withColumn("vwap_divergence", _divergence(F.col("vwap")))).drop(SLICE)


def baseline_columns(halo: DataFrame, n: int, min_n: int, s: Slicing) -> DataFrame:
    """z-score and VWAP divergence over rows that still have their halo."""
    w = s.window().rowsBetween(-n, -1)
    halo = halo.select(
        "*",
        _rolling_z_columns(w, min_n).alias("zscore"),
        F.when(F.count("price").over(w) >= min_n, _rolling_vwap_column(w)).alias("vwap"),
    )
    return halo.withColumn("vwap_divergence", _divergence(F.col("vwap")))


def rolling_baseline(ticks: DataFrame, n: int = 20, min_n: int = 10, s: Slicing = TICKS) -> DataFrame:
    """``rolling_z`` and ``rolling_vwap`` in one pass."""
    halo = with_previous_rows(ticks, n, s, ["price", "volume"])
    return drop_halo(baseline_columns(halo, n, min_n, s)).drop(SLICE)


def trailing_time_stats(
    ticks: DataFrame, span_ms: int = 120_000, eps: float = 1e-4, clip: float = 6.0, s: Slicing = TICKS
) -> DataFrame:
    """Mean and sample deviation over ``[t - span, t)`` and the clipped z-score
    against them; plus the divergence from the ticker's VWAP so far."""
    s = within_span(s, span_ms)
    own = _trailing_moments(ticks, span_ms, s).withColumn("_pv", F.col("price") * F.col("volume"))
    carried = with_carry(own, s, {"_bpv": F.sum("_pv"), "_bv": F.sum("volume")}, {"_bpv": F.sum, "_bv": F.sum})
    w_run = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum_pv = F.coalesce(F.col("_bpv"), F.lit(0.0)) + F.sum("_pv").over(w_run)
    cum_v = F.coalesce(F.col("_bv"), F.lit(0.0)) + F.sum("volume").over(w_run)
    out = carried.withColumn("vwap", F.coalesce(cum_pv / F.nullif(cum_v, F.lit(0.0)), F.col("price")))
    z = (F.col("price") - F.col("trail_mean")) / F.col("trail_std")
    return out.select(
        "*",
        F.when(F.col("trail_std") >= eps, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
        .otherwise(0.0)
        .alias("zscore"),
        F.coalesce(F.abs(F.col("price") - F.col("vwap")) / F.nullif(F.col("vwap"), F.lit(0.0)), F.lit(0.0)).alias(
            "vwap_divergence"
        ),
    ).drop("_pv", "_bpv", "_bv", SLICE)


def _trailing_moments(ticks: DataFrame, span_ms: int, s: Slicing) -> DataFrame:
    """Sliced ticks with ``trail_mean`` and ``trail_std``. Sums are of prices less the timeline's mean, so that squares
    stay small."""
    centre = ticks.groupBy(*s.keys).agg(F.avg("price").alias("_centre"))
    off = F.col("price") - F.col("_centre")
    sums = {"_n": (SUM, F.lit(1).cast("long")), "_d": (SUM, off), "_dd": (SUM, off * off)}
    rows = trailing_ranges(ticks.join(centre, list(s.keys)), span_ms, sums, s)
    n, d, dd = F.col("_n"), F.col("_d"), F.col("_dd")
    deviation = F.sqrt(F.greatest((dd - d * d / n) / (n - 1), F.lit(0.0)))
    return rows.select(
        *[c for c in rows.columns if c not in (*sums, "_centre")],
        F.when(n > 0, F.col("_centre") + d / n).alias("trail_mean"), F.when(n > 1, deviation).alias("trail_std"),
    )


def _with_wash_rule(halo: DataFrame, price_range: float, volume_ratio: float, min_prior: int) -> DataFrame:
    low, high = F.col("prior_low"), F.col("prior_high")
    flat = F.coalesce((low > 0) & ((high - low) / low < price_range), F.lit(False))
    rule = F.col("flat_market") & (F.col("prior_ticks") >= max(min_prior, 1)) & (F.col("prior_volume") > 0)
    ratio = F.when(rule, F.col("volume") / (volume_ratio * F.col("prior_volume"))).otherwise(0.0)
    return halo.withColumn("flat_market", flat).withColumn("wash_ratio", ratio)


def wash_lookback(
    ticks: DataFrame,
    lookback_ms: int = 120_000,
    price_range: float = 0.0015,
    volume_ratio: float = 0.7,
    min_prior: int = 4,
    s: Slicing = TICKS,
) -> DataFrame:
    """Fixed-lookback wash rule over ``[t - lookback, t)``: the market is flat
    when its price range stays below ``price_range``; the ratio compares this
    tick's volume with the rule's share of the trailing volume."""
    prior = {
        "prior_low": (LEAST, F.col("price")),
        "prior_high": (GREATEST, F.col("price")),
        "prior_volume": (SUM, F.col("volume")),
        "prior_ticks": (SUM, F.col("price").isNotNull().cast("long")),
    }
    rows = trailing_ranges(ticks, lookback_ms, prior, s).drop(SLICE)
    return _with_wash_rule(rows.na.fill({"prior_ticks": 0}), price_range, volume_ratio, min_prior)


def adaptive_cutoff(ticks: DataFrame, lookback: Column | str, s: Slicing = TICKS) -> DataFrame:
    """``cutoff_ms``: running maximum of time minus lookback. A lookback that
    grows again never brings back ticks that had already left the history."""
    look = F.col(lookback) if isinstance(lookback, str) else lookback
    base = s.assign(ticks).withColumn("_edge", F.col(s.time) - look)
    carried = with_carry(base, s, {"_before": F.max("_edge")}, {"_before": F.max})
    inside = F.max("_edge").over(s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return carried.withColumn("cutoff_ms", F.greatest(F.col("_before"), inside)).drop("_before", "_edge", SLICE)


def risk_columns(scores: dict[str, Column], threshold: float = 1.0) -> dict[str, Column]:
    """Risk, flag, type and fired-signal list from signal ratios (each signal
    divided by its own alarm level; null counts as 0)."""
    ratios = {name: F.coalesce(scores[name], F.lit(0.0)) for name in SIGNALS if name in scores}
    values = list(ratios.values())
    risk = F.greatest(*values) if len(values) > 1 else values[0]
    fired = F.filter(
        F.array(*[F.when(r > threshold, F.lit(name)) for name, r in ratios.items()]), lambda x: x.isNotNull()
    )

    def any_of(names) -> Column:
        hit = F.lit(False)
        for name in names:
            if name in ratios:
                hit = hit | (ratios[name] > threshold)
        return hit

    price, volume = any_of(PRICE_SIGNALS), any_of(VOLUME_SIGNALS)
    return {
        "risk_score": risk,
        "is_anomaly": price | volume,
        "anomaly_type": F.when(price, "price_shock").when(volume, "wash_trade"),
        "signals": F.nullif(F.concat_ws(",", fired), F.lit("")),
    }


def with_risk(df: DataFrame, scores: dict[str, Column], threshold: float = 1.0) -> DataFrame:
    return df.withColumns(risk_columns(scores, threshold))


def with_incident(
    ticks: DataFrame,
    gap_ticks: int = 10,
    flag: str = "is_anomaly",
    session: str | None = "session_id",
    s: Slicing = TICKS,
) -> DataFrame:
    """Flagged ticks with ``incident_id``: flags at most ``gap_ticks``
    unflagged ticks apart, in one session, share the id of the first.
    Needs ``pos`` on the input; unflagged ticks are left out."""
    flags = ticks.filter(F.col(flag))
    cols = ["pos"] + ([session] if session else [])
    halo = with_previous_rows(flags, 1, s, cols)
    w = s.window()
    opens = F.coalesce(F.col("pos") - F.lag("pos").over(w) - 1 > gap_ticks, F.lit(True))
    if session:
        opens = opens | F.coalesce(F.col(session) != F.lag(session).over(w), F.lit(True))
    marked = drop_halo(halo.withColumn("_opens", opens))
    return group_start(marked, "_opens", s).withColumn(
        "incident_id", F.concat_ws("-", F.col("ticker"), F.col("_start_ms"))
    ).drop("_start_ms", SLICE)


def group_start(marked: DataFrame, opens: str, s: Slicing) -> DataFrame:
    """``_start_ms``: time of the latest row with ``opens`` set, carried over
    slices (input already sliced)."""
    start = F.when(F.col(opens), F.col(s.time))
    base = marked.withColumn("_at", start)
    carried = with_carry(base, s, {"_before": F.max("_at")}, {"_before": F.max})
    inside = F.last("_at", ignorenulls=True).over(s.window().rowsBetween(Window.unboundedPreceding, 0))
    return carried.withColumn("_start_ms", F.coalesce(inside, F.col("_before"))).drop("_before", "_at", opens)


def label_incidents(labelled: DataFrame, gap_ms: int = 10_000, s: Slicing = TICKS) -> DataFrame:
    """Incidents of labelled rows: a gap over ``gap_ms`` or a change of type
    starts a new one."""
    halo = with_previous_rows(labelled, 1, s, ["anomaly_type"])
    w = s.window()
    opens = F.coalesce(
        (F.col(s.time) - F.lag(s.time).over(w) > gap_ms)
        | (F.col("anomaly_type") != F.lag("anomaly_type").over(w)),
        F.lit(True),
    )
    marked = drop_halo(halo.withColumn("_opens", opens))
    return group_start(marked, "_opens", s).withColumn(
        "incident_id", F.concat_ws("-", F.col("ticker"), F.col("_start_ms"))
    ).drop("_start_ms", SLICE)


def naive_flags(ticks: DataFrame, return_threshold: float | Column, volume_threshold: float | Column, s: Slicing = TICKS) -> DataFrame:
    """Fixed-threshold baseline: a large return is a shock, otherwise a large
    volume is a wash trade. Needs ``abs_return`` (``with_return``)."""
    shock = F.col("abs_return") > return_threshold
    return ticks.withColumn("naive_shock", shock).withColumn(
        "naive_wash", (F.col("volume") > volume_threshold) & ~shock
    )


def enrich_labelled(ticks: DataFrame, span_ms: int = 120_000, gap_ms: int = 10_000, s: Slicing = TICKS) -> DataFrame:
    """Labelled history as anomaly rows, without running the detector: z and
    VWAP divergence from the trailing window, risk floored at 1.01, ids from
    the labels."""
    scored = trailing_time_stats(ticks, span_ms, s=s).filter(F.col("label") != "normal")
    rows = scored.select(
        "*",
        F.col("label").alias("anomaly_type"),
        F.lit(0.0).alias("ewma_divergence"),
        F.lit(0.0).alias("cusum_price"),
        F.lit(0.0).alias("cusum_volume"),
        F.greatest(F.abs("zscore") / 5.0, F.abs("vwap_divergence") / 0.01, F.lit(1.01)).alias("risk_score"),
        F.when(F.col("label") == "wash_trade", "wash_rule").otherwise("zscore").alias("signals"),
        F.concat_ws("-", F.col("ticker"), F.col(s.time), F.lit("0")).alias("tick_id"),
    ).drop("trail_mean", "trail_std", "vwap")
    return label_incidents(rows, gap_ms, s)

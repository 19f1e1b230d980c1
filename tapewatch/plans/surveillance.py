"""The surveillance query made of plain column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.signals import baseline_columns, wash_lookback, with_incident, with_risk
from tapewatch.operators.slices import Slicing, drop_halo, with_context
from tapewatch.operators.ticks import TICKS, number_ticks, with_step
from tapewatch.session import cut_lineage


def native_scores(
    ticks: DataFrame,
    z_threshold: float = 8.0,
    vwap_threshold: float = 0.01,
    lookback_ms: int = 120_000,
    price_range: float = 0.0015,
    volume_ratio: float = 0.7,
    session_gap_ms: int = 1_800_000,
    s: Slicing = TICKS,
) -> DataFrame:
    """Every tick with position, session, unclipped z-score, VWAP divergence,
    fixed-lookback wash rule, risk, flag, type and fired signals. The look-back
    is put together first; all other windows share one shuffle of the ticks by
    (ticker, slice)."""
    known = wash_lookback(ticks, lookback_ms, price_range, volume_ratio, 4, s)
    halo = with_context(known, s, rows=20, cols=["price", "volume"], source=ticks)
    washed = drop_halo(baseline_columns(with_step(halo, session_gap_ms, s), 20, 10, s))
    scored = number_ticks(washed, ticks, session_gap_ms, s)
    return with_risk(
        scored,
        {
            "zscore": F.abs("zscore") / z_threshold,
            "vwap": F.col("vwap_divergence") / vwap_threshold,
            "wash_rule": F.col("wash_ratio"),
        },
    )


def surveil(ticks: DataFrame, s: Slicing = TICKS, **settings) -> DataFrame:
    """Flagged ticks with their incident. The flags are written to the
    checkpoint folder once, because the incident step reads them repeatedly."""
    scored = native_scores(ticks, s=s, **settings)
    flags = cut_lineage(scored.filter("is_anomaly"))
    return with_incident(flags, s=s)

"""OHLC bars, bar statistics, chart markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.slices import SLICE, Slicing, with_carry

BAR_MS = 30_000


def bar_start_ms(ms: str | Column = "event_time_ms", width_ms: int = BAR_MS) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.floor(ms / F.lit(width_ms)) * width_ms


def ohlc_bars(ticks: DataFrame, width_ms: int = BAR_MS, tie: str = "arrival") -> DataFrame:
    """Left-closed, epoch-aligned bars per ticker; bars without ticks do not
    appear. A plain aggregation: ticks are pre-aggregated before the shuffle."""
    order = F.struct("event_time_ms", tie)
    return (
        ticks.groupBy("ticker", bar_start_ms(width_ms=width_ms).alias("bar_ms"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumn("bar_start", F.timestamp_millis("bar_ms"))
    )


# Windows over bars partition by ticker: bars per ticker are bounded by elapsed
# time (2,880 a day at 30 s), not by the number of ticks.
def _bars_of_ticker():
    return Window.partitionBy("ticker").orderBy("bar_ms")


def bar_zscore(bars: DataFrame, n: int = 15, min_n: int = 2, eps: float = 1e-4, clip: float = 6.0) -> DataFrame:
    """z-score of the close against the last n bars (this one included, sample
    deviation), 0 when the deviation is below eps, clipped."""
    w = _bars_of_ticker().rowsBetween(-(n - 1), 0)
    std = F.when(F.count("close").over(w) >= min_n, F.stddev_samp("close").over(w))
    z = (F.col("close") - F.avg("close").over(w)) / std
    clipped = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return bars.withColumn("zscore", F.when(std >= eps, clipped).otherwise(0.0))


def bar_vwap(bars: DataFrame, clip: float = 10.0) -> DataFrame:
    """VWAP of the typical price since the first bar (the close while no volume
    has traded) and the close's divergence from it in percent, clipped."""
    w = _bars_of_ticker().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    vwap = F.sum(typical * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0))
    out = bars.withColumn("vwap", F.coalesce(vwap, F.col("close")))
    divergence = (F.col("close") - F.col("vwap")) / F.nullif(F.col("vwap"), F.lit(0.0)) * 100
    return out.withColumn(
        "vwap_divergence",
        F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), divergence)), F.lit(0.0)),
    )


def price_change(bars: DataFrame) -> DataFrame:
    """Per ticker: first and last close and the change in percent."""
    per = bars.groupBy("ticker").agg(
        F.min_by("close", "bar_ms").alias("first_close"), F.max_by("close", "bar_ms").alias("last_close")
    )
    change = (F.col("last_close") - F.col("first_close")) / F.col("first_close") * 100
    return per.withColumn("pct_change", F.when(F.col("first_close") > 0, change).otherwise(0.0))


def without_anomaly(bars: DataFrame, anomalies: DataFrame, width_ms: int = BAR_MS) -> DataFrame:
    """Bars in whose bucket no anomaly is stored."""
    taken = anomalies.select("ticker", bar_start_ms(width_ms=width_ms).alias("bar_ms"))
    return bars.join(taken, ["ticker", "bar_ms"], "left_anti")


def episode_starts(bars: DataFrame, threshold: float = 3.0) -> DataFrame:
    """First bar of every run of bars with |zscore| at or above the threshold."""
    w = _bars_of_ticker()
    beyond = F.abs("zscore") >= threshold
    before = F.coalesce(F.lag(beyond).over(w), F.lit(False))
    return bars.withColumn("_starts", beyond & ~before).filter("_starts").drop("_starts")


def z_episodes(
    bars: DataFrame, anomalies: DataFrame, threshold: float = 3.0, critical: float = 4.5, width_ms: int = BAR_MS
) -> DataFrame:
    """Episode starts that no stored anomaly already marks, with their level."""
    fresh = without_anomaly(episode_starts(bars, threshold), anomalies, width_ms)
    return fresh.withColumn("severity", F.when(F.abs("zscore") >= critical, "CRITICAL").otherwise("WARNING"))


def nearest_bar(anomalies: DataFrame, bars: DataFrame, s: Slicing = Slicing()) -> DataFrame:
    """Each anomaly with the bar start closest to it in whole seconds, the
    earlier bar on a tie. Both sides are merged per (ticker, slice); the bar
    just before and just after a slice is carried in, so no side is broadcast
    and no pair is enumerated. Tickers without bars drop out."""
    names = anomalies.columns
    rows = anomalies.select(F.struct(*names).alias("_row"), "ticker", F.col(s.time).alias("_t")).withColumn(
        "_bar", F.lit(None).cast("long")
    )
    marks = bars.select("ticker", F.col("bar_ms").alias("_t"), F.col("bar_ms").alias("_bar"))
    line = s.by(time="_t", tie=())
    both = line.assign(rows.unionByName(marks, allowMissingColumns=True))
    carried = with_carry(both, line, {"_prev": F.max("_bar")}, {"_prev": F.max})
    later = Window.partitionBy(*line.keys).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(*line.slice_keys).agg(F.min("_bar").alias("_first"))
    carried = carried.join(
        firsts.select(*line.slice_keys, F.min("_first").over(later).alias("_next")), line.slice_keys, "left"
    )
    w = line.window()
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # "from here on" as a backward running minimum: a following frame is quadratic
    after = Window.partitionBy(*line.slice_keys).orderBy(F.desc("_t")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = carried.select(
        "_row",
        "_t",
        F.coalesce(F.max("_bar").over(upto), F.col("_prev")).alias("_prev"),
        F.coalesce(F.min("_bar").over(after), F.col("_next")).alias("_next"),
    ).filter(F.col("_row").isNotNull())
    second = F.floor(F.col("_t") / 1000) * 1000
    back, ahead = F.abs(second - F.col("_prev")), F.abs(F.col("_next") - second)
    pick = F.when(back <= ahead, F.col("_prev")).otherwise(F.coalesce(F.col("_next"), F.col("_prev")))
    return found.select("_row.*", F.coalesce(pick, F.col("_next")).alias("bar_ms")).filter(
        F.col("bar_ms").isNotNull()
    )


def bar_markers(snapped: DataFrame, critical_z: float = 4.5, critical_risk: float = 2.0) -> DataFrame:
    """One marker per bar from anomalies with ``bar_ms``: how many there are and
    the most severe one. Anomalies below both warning levels are left out."""
    z, risk = F.abs("zscore"), F.col("risk_score")
    kept = snapped.filter((z >= 3.0) | (risk >= 1.0)).withColumn(
        "_crit", (risk >= critical_risk) | (z >= critical_z)
    )
    peak = F.max_by(
        F.struct("zscore", "risk_score", "anomaly_type", "_crit"), F.struct("_crit", "risk_score", F.abs("zscore"))
    )
    per_bar = kept.groupBy("ticker", "bar_ms").agg(F.count("*").alias("anomalies"), peak.alias("peak"))
    suffix = F.when(F.col("anomalies") > 1, F.format_string(" [x%d]", "anomalies")).otherwise("")
    wash = F.contains(F.lower(F.coalesce("peak.anomaly_type", F.lit(""))), F.lit("wash"))
    down = F.col("peak.zscore") < 0
    move = F.format_string("(%+.1fσ)", "peak.zscore")
    return per_bar.select(
        "ticker",
        "bar_ms",
        "anomalies",
        F.col("peak.zscore").alias("peak_zscore"),
        F.col("peak.risk_score").alias("peak_risk"),
        F.when(F.col("peak._crit"), "CRITICAL").otherwise("WARNING").alias("level"),
        F.when(wash, "circle").when(down, "arrowDown").otherwise("arrowUp").alias("shape"),
        F.when(wash | down, "aboveBar").otherwise("belowBar").alias("position"),
        F.when(wash, F.concat(F.lit("WASH SALE"), suffix))
        .when(down, F.concat(F.lit("DROP "), move, suffix))
        .otherwise(F.concat(F.lit("SPIKE "), move, suffix))
        .alias("text"),
    )

"""Staged tuning of the price signals, and the check of one setting.

Stage one sweeps the price CUSUM, stage two z and EWMA thresholds at the CUSUM
of stage one. A setting is scored per event on the original ticks and on one
copy per variant. The best price-shock F1 wins among settings at which no other
kind loses more than ``ALLOWED_LOSS`` against the defaults. All settings of a
stage are scored in one read of all datasets, and only flagged ticks leave the
scorer; what is compared is one row per setting and kind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators import evaluate
from tapewatch.operators.detect import detect_batch
from tapewatch.operators.inject import EXISTING_VARIANTS, HELDOUT_VARIANTS, SESSION_GAP_MS, Variant, inject_variant, variant_base
from tapewatch.operators.slices import Slicing
from tapewatch.operators.ticks import TICKS, split_time
from tapewatch.operators.tuning import CUSUM_GRID, EWMA_STAGE, Z_STAGE, best_guarded
from tapewatch.params import DetectorParams
from tapewatch.session import cut_lineage

DEFAULTS = "defaults"
ORIGINAL = "original"
TARGET = "price_shock"


@dataclass
class Datasets:
    """The ticks and the event spans of all datasets, as one table each, and the
    kinds that are scored on each dataset. A ticker is named
    ``<dataset>|<ticker>``, so that whatever runs per ticker runs once for all;
    ``dataset`` and ``period`` stand beside it."""

    ticks: DataFrame
    spans: DataFrame
    kinds: dict[str, tuple[str, ...]]


def datasets(
    ticks: DataFrame, variants: Sequence[Variant], seed: int = 7, gap_ms: int = SESSION_GAP_MS, s: Slicing = TICKS
) -> Datasets:
    """The original ticks and one copy per variant. A variant changes prices and
    volumes alone, so positions, sessions, labels and the cutoff are those of
    the original ticks."""
    columns = ["ticker", "start_pos", "end_pos", "kind"]
    base = variant_base(ticks, s, gap_ms)
    plain = base[0]
    labelled = evaluate.original_spans(plain).select(*columns)
    parts = {ORIGINAL: (plain, labelled)}
    for i, v in enumerate(variants):
        data, spans = inject_variant(ticks, v, seed + i, s, gap_ms, base)
        parts[v.kind] = (data, labelled.unionByName(spans.select(*columns)))
    cutoff = split_time(plain).select("cutoff_ms").scalar()
    period = F.when(F.col("event_time_ms") <= cutoff, "train").otherwise("test")

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.withColumns({"ticker": F.concat(F.lit(f"{name}|"), "ticker"), "dataset": F.lit(name)})

    kept = list(dict.fromkeys(["ticker", *s.order, "event_time_ms", "price", "volume", "pos"]))
    rows = reduce(DataFrame.unionByName, [named(d.select(*kept), n) for n, (d, _) in parts.items()])
    events = reduce(DataFrame.unionByName, [e.withColumn("dataset", F.lit(n)) for n, (_, e) in parts.items()])
    starts = plain.select("ticker", F.col("pos").alias("start_pos"), period.alias("period"))
    events = events.join(starts, ["ticker", "start_pos"]).withColumn("ticker", F.concat_ws("|", "dataset", "ticker"))
    kinds = {ORIGINAL: tuple(evaluate.TYPES)} | {v.kind: (v.kind,) for v in variants}
    return Datasets(cut_lineage(rows.withColumn("period", period)), cut_lineage(events), kinds)


def score_settings(
    data: Datasets, settings: Mapping[str, DetectorParams], period: str = "all", s: Slicing = TICKS
) -> DataFrame:
    """(setting, kind, events, detected, precision, recall, f1) of every setting
    on the ticks of one period."""
    return score_periods(data, settings, [period], s).drop("period")


def score_periods(data: Datasets, settings: Mapping[str, DetectorParams], periods: Sequence[str], s: Slicing = TICKS) -> DataFrame:
    """The scores of every period. The detector runs once, and so does the
    matching of flags and events: each period and dataset has tickers of its own
    there, and the plan is no larger for more of them."""
    flags = detect_batch(data.ticks, settings, s, carry=["dataset", "pos", "period"], flags_only=True)
    flags = flags.select("param_id", "dataset", "ticker", "pos", "period", F.col("anomaly_type").alias("family"))

    def reported(df: DataFrame) -> DataFrame:
        asked = F.filter(F.array(*[F.lit(p) for p in periods]), lambda p: (p == "all") | (p == F.col("period")))
        return df.withColumn("period", F.explode(asked)).withColumn("ticker", F.concat_ws("|", "period", "ticker"))

    metrics = evaluate.event_metrics(
        reported(cut_lineage(flags)), reported(data.spans), by={"param_id": list(settings)}, within=["period", "dataset"]
    )
    shown = reduce(Column.__or__, [(F.col("dataset") == n) & F.col("kind").isin(*kinds) for n, kinds in data.kinds.items()])
    metrics = metrics.filter(shown).withColumnRenamed("param_id", "setting")
    return cut_lineage(metrics.select("setting", "kind", "events", "detected", "precision", "recall", "f1", "period"))


def _choose(scores: DataFrame, names: Sequence[str], base: DataFrame) -> str:
    """The setting with the best guarded F1 of the target; the first named wins a tie."""
    places = scores.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "setting string, grid_pos int")
    rows = scores.join(places, "setting").select("grid_pos", "kind", "f1", "setting")
    return best_guarded(rows, base.select("kind", "f1"), TARGET).first()["setting"]


def tune_price(
    ticks: DataFrame,
    defaults: DetectorParams = DetectorParams(),
    cusum_grid: Sequence[tuple[float, float]] = CUSUM_GRID,
    z_grid: Sequence[float] = Z_STAGE,
    ewma_grid: Sequence[float] = EWMA_STAGE,
    variants: Sequence[Variant] = EXISTING_VARIANTS,
    period: str = "train",
    gap_ms: int = SESSION_GAP_MS,
    s: Slicing = TICKS,
) -> tuple[DetectorParams, DataFrame]:
    """The tuned parameters and the table of both stages: stage, setting, kind,
    events, detected, precision, recall, f1 and whether the stage chose it."""
    data = datasets(ticks, variants, gap_ms=gap_ms, s=s)
    first = {f"k={k:g}, h={h:g}": defaults.with_(cusum_k=k, cusum_h=h) for k, h in cusum_grid}
    scores_one = score_settings(data, first | {DEFAULTS: defaults}, period, s)
    base = scores_one.filter(F.col("setting") == DEFAULTS)
    one = _choose(scores_one, [*first, DEFAULTS], base)
    kept = (first | {DEFAULTS: defaults})[one]
    second = {
        f"{one}, z={z:g}, ewma={e:g}": kept.with_(z_threshold=z, ewma_threshold=e) for z in z_grid for e in ewma_grid
    }
    scores_two = score_settings(data, second, period, s)
    before = scores_one.filter(F.col("setting") == one)
    two = _choose(scores_two.unionByName(before), [*second, one], base)
    scores_one = scores_one.filter(F.col("setting") != DEFAULTS)
    table = (
        base.withColumn("stage", F.lit(0)).withColumn("chosen", F.lit(False))
        .unionByName(scores_one.withColumn("stage", F.lit(1)).withColumn("chosen", F.col("setting") == one))
        .unionByName(scores_two.withColumn("stage", F.lit(2)).withColumn("chosen", F.col("setting") == two))
    )
    return (second | {one: kept})[two], table


def check_price(
    ticks: DataFrame,
    tuned: DetectorParams,
    defaults: DetectorParams = DetectorParams(),
    heldout: bool = True,
    gap_ms: int = SESSION_GAP_MS,
    s: Slicing = TICKS,
) -> DataFrame:
    """Defaults and tuned parameters on the train, test and all ticks, with the
    held-out variants that were never tuned on."""
    data = datasets(ticks, [*EXISTING_VARIANTS, *(HELDOUT_VARIANTS if heldout else ())], gap_ms=gap_ms, s=s)
    return score_periods(data, {DEFAULTS: defaults, "tuned": tuned}, ("train", "test", "all"), s)

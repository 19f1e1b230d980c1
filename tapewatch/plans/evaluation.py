"""The evaluation report: the split report over single ticks, and datasets
scored per event kind and per incident."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.columns import random_baseline
from tapewatch.operators import cube as cb
from tapewatch.operators import evaluate
from tapewatch.operators.detect import detect_batch
from tapewatch.operators.inject import EXISTING_VARIANTS, SESSION_GAP_MS, Variant, inject_variant
from tapewatch.operators.signals import naive_flags
from tapewatch.operators.slices import Slicing
from tapewatch.operators.ticks import TICKS, indexed, period_mask, split_time, with_return
from tapewatch.operators.tuning import PR_Z_GRID, tune_naive
from tapewatch.params import DetectorParams
from tapewatch.session import cut_lineage

REPORT = ("dataset", "source", "kind", "events", "detected", "precision", "recall", "f1", "alerts_per_hour", "flag_rate")
SPLIT = ("section", "name", "source", "kind", "flagged", "precision", "recall", "f1", "lift")


def _shaped(rows: DataFrame, columns: Sequence[str], text: Sequence[str]) -> DataFrame:
    """The columns of a report, null where rows have none."""
    kinds = {c: "string" if c in text else "double" for c in columns}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def datasets(
    ticks: DataFrame, variants: Sequence[Variant], seed: int, session_gap_ms: int, s: Slicing
) -> tuple[DataFrame, DataFrame]:
    """``(ticks, spans)`` of the original and one copy per variant, as one table
    each. A ticker is named ``<dataset>|<ticker>``, so that whatever runs per
    ticker runs once for all datasets; ``dataset`` has the name alone."""
    columns = ["ticker", "start_pos", "end_pos", "kind"]
    plain = cut_lineage(indexed(ticks, session_gap_ms, s))
    parts = [("original", plain, evaluate.original_spans(plain).select(*columns))]
    for i, v in enumerate(variants):
        data, spans = inject_variant(ticks, v, seed + i, s, session_gap_ms)
        data = cut_lineage(data)
        parts.append((v.kind, data, evaluate.original_spans(data).select(*columns).unionByName(spans.select(*columns))))

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("ticker", F.concat_ws("|", F.lit(name), "ticker")).withColumn("dataset", F.lit(name))

    kept = list(dict.fromkeys(["ticker", *s.order, "price", "volume", "pos"]))
    rows = reduce(DataFrame.unionByName, [named(d.select(*kept), n) for n, d, _ in parts])
    spans = reduce(DataFrame.unionByName, [named(e, n) for n, _, e in parts])
    return rows, cut_lineage(spans)


def evaluation_report(
    ticks: DataFrame,
    params: DetectorParams = DetectorParams(),
    variants: Sequence[Variant] = EXISTING_VARIANTS,
    seed: int = 7,
    naive: bool = True,
    period: str = "all",
    session_gap_ms: int = SESSION_GAP_MS,
    s: Slicing = TICKS,
) -> DataFrame:
    """One row per dataset, source and kind.

    Datasets are the original ticks and one copy per variant. Sources: the
    detector and the naive thresholds (tuned on the training period) per event
    kind, and the detector's incidents; for the latter ``events`` counts
    incidents, ``recall`` is the share of events caught, and ``alerts_per_hour``
    and ``flag_rate`` are filled in. Every step runs once over all datasets."""
    if period not in ("all", "train", "test"):
        raise ValueError("period is all, train or test")
    rows, spans = datasets(ticks, variants, seed, session_gap_ms, s)
    cutoff = split_time(ticks).select("cutoff_ms").first()["cutoff_ms"]
    early = F.col("event_time_ms") <= cutoff
    rows = with_return(rows, s).withColumn("period", F.when(early, "train").otherwise("test"))
    if naive:
        train = with_return(ticks, s).filter(early)
        limits = {r["kind"]: r["threshold"] for r in tune_naive(train).select("kind", "threshold").collect()}  # two rows
        rows = naive_flags(rows, limits["price_shock"], limits["wash_trade"])
        family = F.when(F.col("naive_shock"), "price_shock").when(F.col("naive_wash"), "wash_trade")
    else:
        family = F.lit(None).cast("string")
    rows = rows.withColumn("naive", family)
    scored = detect_batch(rows, params, s, carry=["dataset", "pos", "period", "naive"])
    scored = scored.withColumn("event_time_ms", F.unix_millis("timestamp"))
    inside = F.lit(period == "all") | (F.col("period") == period)
    kept = ["dataset", "ticker", "event_time_ms", "tick_id", "pos", "is_anomaly", "anomaly_type", "incident_id", "naive"]
    placed = cut_lineage(scored.filter(inside).select(*kept))
    starts = placed.select("ticker", F.col("pos").alias("start_pos"))
    spans = cut_lineage(spans.join(starts, ["ticker", "start_pos"], "left_semi"))
    hours = evaluate.trading_hours(placed, session_gap_ms, s.by(tie=("tick_id",)))
    hours = cut_lineage(hours.withColumn("dataset", F.regexp_extract("ticker", r"^([^|]*)\|", 1)))
    flags = {"detector": "anomaly_type"} | ({"naive": "naive"} if naive else {})
    out = []
    for source, column in flags.items():
        own = placed.filter(F.col(column).isNotNull()).select("dataset", "ticker", "pos", F.col(column).alias("family"))
        out.append(evaluate.event_metrics(own, spans, within=["dataset"]).withColumn("source", F.lit(source)))
    events = reduce(DataFrame.unionByName, out)
    reported = F.when(F.col("dataset") == "original", F.col("kind").isin(*evaluate.TYPES)).otherwise(F.col("kind") == F.col("dataset"))
    overall, _ = evaluate.incident_metrics(placed, spans, hours, within=["dataset"])
    incidents = overall.withColumnsRenamed({"incidents": "events", "event_recall": "recall", "total_per_hour": "alerts_per_hour"})
    incidents = incidents.withColumns({"source": F.lit("incidents"), "kind": F.lit("any")})
    text = ("dataset", "source", "kind")
    return _shaped(events.filter(reported), REPORT, text).unionByName(_shaped(incidents, REPORT, text))


def split_report(
    ticks: DataFrame,
    grid: cb.Grid = cb.Grid(),
    production: DetectorParams = DetectorParams(),
    pr_grid: Sequence[float] = PR_Z_GRID,
    s: Slicing = TICKS,
) -> DataFrame:
    """The z-score and wash components over single ticks, one row per section,
    name, source and kind.

    ``split``: the setting tuned on the training period, on both periods
    (source ``tuned``), and on the test period the production setting, the
    naive thresholds and random flags at the tuned rate; ``lift`` is the tuned
    precision over the prevalence. ``leave_one_out``: F1 of the setting tuned
    on all other tickers (``tuned``) and of the ticker's own best (``own``).
    ``pr_curve``: price_shock over z at the tuned window, per period.

    All of it is read from one cube of exceedance counts."""
    tick_rows = cut_lineage(period_mask(with_return(ticks, s)))
    window = (production.window_size, production.min_samples)
    wash = (production.wash_volume_ratio, production.wash_price_range)
    whole = replace(
        grid,
        windows=tuple(dict.fromkeys([*grid.windows, window])),
        z=tuple(sorted({*grid.z, *pr_grid, production.z_threshold})),
        wash=tuple(dict.fromkeys([*grid.wash, wash])),
    )
    candidate = (
        (F.col("window") < len(grid.windows)) & (F.col("wash") < len(grid.wash))
        & F.col("z_pos").isin([whole.z.index(z) for z in grid.z])
    )
    cube = cb.exceedance_cube(tick_rows, whole, production, ["label", "period"], s)
    counts = cut_lineage(cb.setting_counts(cube, whole, ["period"]))
    tuned = cb.tune(counts.filter(candidate & (F.col("period") == "train"))).select(*cb.SETTING)
    tuned = tuned.first()  # one row
    places = {
        "tuned": tuple(tuned),
        "production": (whole.windows.index(window), whole.wash.index(wash), whole.z.index(production.z_threshold), 0),
    }

    def at(source: str, period: str) -> DataFrame:
        own = counts.filter(F.col("period") == period)
        for c, v in zip(cb.SETTING, places[source]):
            own = own.filter(F.col(c) == v)
        setting = own.select(*cb.SETTING).limit(1)
        return cb.at_settings(own, setting).withColumns({"name": F.lit(period), "source": F.lit(source)})

    test = cut_lineage(at("tuned", "test"))
    prevalence = F.try_divide("n_pos", "n_ticks")
    random = test.select("kind", "name", F.lit("random").alias("source"), *[
        c.alias(n) for n, c in random_baseline(F.col("n_flag") / F.col("n_ticks"), F.col("n_pos") / F.col("n_ticks")).items()
    ])
    chosen = {r["kind"]: r["threshold"] for r in tune_naive(tick_rows.filter("period = 'train'")).select("kind", "threshold").collect()}
    flagged = naive_flags(tick_rows.filter("period = 'test'"), chosen["price_shock"], chosen["wash_trade"])
    naive = evaluate.tick_metrics(flagged, "naive_shock", "naive_wash").withColumns({"name": F.lit("test"), "source": F.lit("naive")})
    text = ("section", "name", "source", "kind")
    split = [
        at("tuned", "train").withColumnRenamed("n_flag", "flagged"),
        test.withColumnRenamed("n_flag", "flagged").withColumn("lift", F.try_divide("precision", prevalence)),
        at("production", "test").withColumnRenamed("n_flag", "flagged"),
        naive,
        random,
    ]
    out = [_shaped(rows.withColumn("section", F.lit("split")), SPLIT, text) for rows in split]
    loo = cb.leave_one_out(cb.setting_counts(cube, whole, ["ticker"]).filter(candidate), whole)
    cells = [
        F.struct(F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.col(c).alias("f1"))
        for source, kind, c in (
            ("tuned", "price_shock", "shock_f1"), ("tuned", "wash_trade", "wash_f1"), ("tuned", "any", "any_f1"),
            ("own", "price_shock", "own_shock_f1"), ("own", "wash_trade", "own_wash_f1"),
        )
    ]
    loo = loo.select(F.lit("leave_one_out").alias("section"), F.col("ticker").alias("name"), F.explode(F.array(*cells)).alias("c"))
    out.append(_shaped(loo.select("section", "name", "c.*"), SPLIT, text))
    curve = counts.filter((F.col("window") == tuned["window"]) & F.col("z_pos").isin([whole.z.index(z) for z in pr_grid]))
    curve = cb.threshold_surface(curve, whole, ["period"]).withColumns(
        {"section": F.lit("pr_curve"), "name": F.col("z").cast("string"), "source": F.col("period"), "kind": F.lit("price_shock"), "flagged": F.col("n_flag")}
    )
    out.append(_shaped(curve, SPLIT, text))
    return reduce(DataFrame.unionByName, out)

"""Scoring flags against labels at tick, event and incident level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.columns import f1, f1_4, prf_columns, rate, rate4
from tapewatch.operators.slices import Slicing
from tapewatch.operators.ticks import TICKS, with_gap

# Ticks an event of each kind lasts from its labelled tick, and
# the family each kind of event belongs to.
EVENT_WINDOW = {"price_shock": 5, "wash_trade": 9}
FAMILY = {
    "price_shock": "price_shock",
    "wash_trade": "wash_trade",
    "shock_ramp": "price_shock",
    "wash_split": "wash_trade",
    "shock_ramp_long": "price_shock",
    "wash_split_fine": "wash_trade",
}
TYPES = ("price_shock", "wash_trade")


def _by_kind(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for kind, value in values.items():
        out = F.when(column == kind, F.lit(value)).otherwise(out)
    return out


def labelled_events(ticks: DataFrame, windows: dict[str, int] = EVENT_WINDOW) -> DataFrame:
    """``ticker, start_pos, end_pos, kind`` (end excluded) of every labelled
    tick; ticks need ``pos`` and ``label``."""
    return ticks.filter(F.col("label") != "normal").select(
        "ticker",
        F.col("pos").alias("start_pos"),
        (F.col("pos") + _by_kind(F.col("label"), windows)).alias("end_pos"),
        F.col("label").alias("kind"),
    )


def original_spans(ticks: DataFrame, windows: dict[str, int] = EVENT_WINDOW) -> DataFrame:
    """Labelled events cut at the end of their session (needs ``session_id``)."""
    last = ticks.groupBy("ticker", "session_id").agg(F.max("pos").alias("_last"))
    starts = ticks.filter(F.col("label") != "normal").select(
        "ticker", "session_id", "pos", "label", "event_time_ms"
    )
    end = F.least(F.col("pos") + _by_kind(F.col("label"), windows), F.col("_last") + 1)
    return starts.join(last, ["ticker", "session_id"]).select(
        "ticker",
        F.col("pos").alias("start_pos"),
        end.alias("end_pos"),
        F.col("label").alias("kind"),
        F.col("event_time_ms").alias("start_ms"),
    )


def span_positions(spans: DataFrame) -> DataFrame:
    """One row per position inside each span. Spans last a few dozen ticks at
    most, and the join key (ticker, pos) that follows is as fine as a tick.

    Spark takes the positions, and what is grouped from them, for as few bytes
    as the spans. The hint, which holds for the next join, keeps them from being
    broadcast through the driver by that guess."""
    return spans.withColumn("pos", F.explode(F.sequence("start_pos", F.col("end_pos") - 1))).hint("merge")


def cover_events(spans: DataFrame) -> DataFrame:
    """Per covered position the event that covers it; the later one wins."""
    return span_positions(spans).groupBy("ticker", "pos").agg(
        F.max("start_pos").alias("event_pos"), F.max_by("kind", "start_pos").alias("event_kind")
    )


def locate_flags(ticks: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags with position and label of their tick; both null when no tick has
    the flag's (ticker, event_time_ms). Flags that name their tick by ``pos``
    meet that tick alone, and not others of the same millisecond."""
    if "pos" in flags.columns:
        known = ticks.select("ticker", F.col("pos").alias("_pos"), "label")
        named = flags.withColumnRenamed("pos", "_pos").join(known.withColumn("_known", F.col("_pos")), ["ticker", "_pos"], "left")
        return named.withColumnRenamed("_known", "pos").drop("_pos")
    return flags.join(
        ticks.select("ticker", "event_time_ms", "pos", "label"), ["ticker", "event_time_ms"], "left"
    )


def unmatched_flags(located: DataFrame) -> DataFrame:
    return located.agg(F.count_if(F.col("pos").isNull()).alias("flags_without_matching_tick"))


def score_against_labels(ticks: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per kind (any, price_shock, wash_trade) with tick, event and
    incident scores. Ratios have 4 digits and are null without a denominator.
    A flag inside another kind's event counts as wrong."""
    spans = labelled_events(ticks)
    located = locate_flags(ticks, flags).filter(F.col("pos").isNotNull())
    flagged = located.join(cover_events(spans), ["ticker", "pos"], "left")
    kinds = F.filter(F.array(F.lit("any"), F.col("anomaly_type")), lambda k: k.isin("any", *TYPES))
    rows = flagged.withColumn("kind", F.explode(kinds))
    any_kind = F.col("kind") == "any"
    label, event = F.coalesce("label", F.lit("normal")), F.coalesce("event_kind", F.lit("normal"))
    hit_tick = F.when(any_kind, label != "normal").otherwise(label == F.col("kind"))
    hit_event = F.when(any_kind, event != "normal").otherwise(event == F.col("kind"))
    scored = rows.groupBy("kind").agg(
        F.count("*").alias("flags"),
        F.count_if(hit_tick).alias("tick_tp"),
        F.count_if(hit_event).alias("event_tp"),
        F.count_distinct(F.when(hit_event, F.struct("ticker", "event_pos"))).alias("events_found"),
        F.count_distinct("incident_id").alias("incidents"),
        F.count_distinct(F.when(hit_event, F.col("incident_id"))).alias("true_incidents"),
    )
    events = (
        spans.withColumn("kind", F.explode(F.array(F.lit("any"), F.col("kind"))))
        .groupBy("kind")
        .agg(F.count("*").alias("events"))
    )
    out = events.join(scored, "kind", "full_outer").fillna(0).filter(F.col("kind").isin("any", *TYPES))
    tick_p, tick_r = rate4("tick_tp", "flags"), rate4("tick_tp", "events")
    event_p, event_r = rate4("event_tp", "flags"), rate4("events_found", "events")
    return out.select(
        "kind", "flags", "events", "events_found", "incidents", "true_incidents",
        tick_p.alias("tick_precision"), tick_r.alias("tick_recall"), f1_4(tick_p, tick_r).alias("tick_f1"),
        event_p.alias("event_precision"), event_r.alias("event_recall"), f1_4(event_p, event_r).alias("event_f1"),
        rate4("true_incidents", "incidents").alias("incident_precision"),
    )


def tick_metrics(rows: DataFrame, shock: str, wash: str, label: str = "label") -> DataFrame:
    """Precision, recall and F1 per type from two flag columns and a label."""
    s, w, y = F.col(shock), F.col(wash), F.col(label)
    cases = {
        "price_shock": (s, y == "price_shock"),
        "wash_trade": (w, y == "wash_trade"),
        "any": (s | w, y != "normal"),
    }
    counts = rows.agg(
        *[
            e.alias(f"{k}_{n}")
            for k, (flag, pos) in cases.items()
            for n, e in (("tp", F.count_if(flag & pos)), ("flag", F.count_if(flag)), ("pos", F.count_if(pos)))
        ]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"), F.col(f"{k}_tp").alias("tp"),
                F.col(f"{k}_flag").alias("n_flag"), F.col(f"{k}_pos").alias("n_pos"),
            )
            for k in cases
        ]
    )
    flat = counts.select(F.explode(lines).alias("x")).select("x.*")
    return flat.select("kind", *[c.alias(n) for n, c in prf_columns("tp", "n_flag", "n_pos").items()])


def flag_families(scored: DataFrame) -> DataFrame:
    """Flagged positions with the family of their flag."""
    return scored.filter(F.col("anomaly_type").isNotNull()).select(
        "ticker", "pos", F.col("anomaly_type").alias("family")
    )


def _kinds_of(family: Column) -> Column:
    out = F.array().cast("array<string>")
    for name in TYPES:
        kinds = [k for k, f in FAMILY.items() if f == name]
        out = F.when(family == name, F.array(*[F.lit(k) for k in kinds])).otherwise(out)
    return out


def caught_events(flags: DataFrame, spans: DataFrame, by: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """Spans with a flag of their own family anywhere inside."""
    inside = span_positions(spans).withColumn("family", _by_kind(F.col("kind"), FAMILY))
    if not by:
        hit = inside.join(flags, ["ticker", "pos", "family"], "left_semi")
    else:
        hit = inside.join(flags.select(*by, "ticker", "pos", "family"), ["ticker", "pos", "family"])
    return hit.select(*by, *within, "ticker", "start_pos", "kind").distinct()


def event_metrics(
    flags: DataFrame, spans: DataFrame, by: Mapping[str, Sequence[str]] | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """Per kind present in the spans: events, detected, precision, recall, F1.
    Flags inside another kind's span count neither for nor against a kind.
    ``flags`` are ``ticker, pos, family``; ``spans`` are event spans. ``by``
    names one column of the flags, such as a parameter set, and its values:
    each is scored on its own. ``within`` names columns of flags and spans,
    such as a dataset, that a ticker has one value of: each is a report of its
    own."""
    keys, groups = list(by or {}), list(within)
    cover = span_positions(spans).groupBy("ticker", "pos").agg(F.collect_set("kind").alias("kinds"))
    rows = flags.join(cover, ["ticker", "pos"], "left").withColumn("kind", F.explode(_kinds_of(F.col("family"))))
    covered = F.col("kinds").isNotNull()
    own = F.coalesce(F.expr("array_contains(kinds, kind)"), F.lit(False))
    counts = rows.groupBy(*keys, *groups, "kind").agg(
        F.count_if(own).alias("tp"), F.count_if(own | ~covered).alias("counted")
    )
    events = spans.groupBy(*groups, "kind").agg(F.count("*").alias("events"))
    for key, values in (by or {}).items():
        events = events.withColumn(key, F.explode(F.array(*[F.lit(v) for v in values])))
    on = [*keys, *groups, "kind"]
    detected = caught_events(flags, spans, keys, groups).groupBy(*on).agg(F.count("*").alias("detected"))
    out = events.join(counts, on, "left").join(detected, on, "left").fillna(0, ["tp", "counted", "detected"])
    p, r = rate("tp", "counted"), rate("detected", "events")
    return out.select(*keys, *groups, "kind", "events", "detected", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def trading_hours(ticks: DataFrame, gap_ms: int = 600_000, s: Slicing = TICKS) -> DataFrame:
    """Hours covered by sessions per ticker: the sum of all pauses inside a
    session, which needs no session ids."""
    gaps = with_gap(ticks.select(*dict.fromkeys(["ticker", *s.order])), s)
    return gaps.groupBy("ticker").agg(
        (F.coalesce(F.sum(F.when(F.col("gap_ms") <= gap_ms, F.col("gap_ms"))), F.lit(0)) / 3_600_000.0).alias("hours")
    )


def incident_rows(scored: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per incident: its ticker and whether any of its flags lies in
    any event span."""
    cover = span_positions(spans).select("ticker", "pos").distinct().withColumn("_hit", F.lit(True))
    flags = scored.filter(F.col("incident_id").isNotNull()).select("ticker", "pos", "incident_id")
    hits = flags.join(cover, ["ticker", "pos"], "left")
    return (
        hits.groupBy("incident_id")
        .agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("correct"))
        .withColumn("ticker", F.regexp_extract("incident_id", r"^(.*)-[^-]*$", 1))
    )


def incident_metrics(
    scored: DataFrame, spans: DataFrame, hours: DataFrame, within: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(overall, per_ticker)``: flag rate, incidents, incident precision,
    share of events caught and alerts per trading hour; the per-ticker frame
    lists every ticker of ``hours``. ``within`` names columns of all three
    frames that a ticker has one value of: each value has a row of its own."""
    groups = list(within) or ["_k"]
    if not within:
        scored, spans, hours = (df.withColumn("_k", F.lit(1)) for df in (scored, spans, hours))
    incidents = incident_rows(scored, spans)
    flags = scored.filter(F.col("incident_id").isNotNull()).select("ticker", "pos")
    caught = span_positions(spans).join(flags, ["ticker", "pos"], "left_semi")
    caught = caught.select(*groups, "ticker", "start_pos", "kind").distinct()
    group_of = hours.select(*groups, "ticker")
    parts = (
        scored.groupBy(*groups).agg(F.avg(F.col("is_anomaly").cast("double")).alias("flag_rate"))
        .join(
            incidents.join(group_of, "ticker").groupBy(*groups).agg(F.count("*").alias("incidents"), F.count_if("correct").alias("_ok")),
            groups, "left",
        )
        .join(spans.groupBy(*groups).agg(F.count("*").alias("_events")), groups, "left")
        .join(caught.groupBy(*groups).agg(F.count("*").alias("_caught")), groups, "left")
        .join(hours.groupBy(*groups).agg(F.sum("hours").alias("_hours")), groups, "left")
        .fillna(0, ["incidents", "_ok", "_events", "_caught"])
    )
    overall = parts.select(
        *within,
        "flag_rate",
        "incidents",
        rate("_ok", "incidents").alias("precision"),
        rate("_caught", "_events").alias("event_recall"),
        F.try_divide("incidents", "_hours").alias("total_per_hour"),
    )
    per_ticker = hours.join(incidents.groupBy("ticker").agg(F.count("*").alias("incidents")), "ticker", "left").fillna(
        0, subset=["incidents"]
    )
    return overall, per_ticker.drop("_k").withColumn("alerts_per_hour", F.try_divide("incidents", "hours"))


def restrict(flags: DataFrame, spans: DataFrame, ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags and spans limited to the ticks of one period (``ticker, pos``): a
    span counts when its first tick lies in the period."""
    keys = ticks.select("ticker", "pos")
    starts = keys.withColumnRenamed("pos", "start_pos")
    return flags.join(keys, ["ticker", "pos"], "left_semi"), spans.join(starts, ["ticker", "start_pos"], "left_semi")


def prevalence(ticks: DataFrame, by: str | None = None) -> DataFrame:
    """Ticks, tickers, days and the share of every label."""
    y = F.col("label")
    groups = [by] if by else []
    return ticks.groupBy(*groups).agg(
        F.count("*").alias("ticks"),
        F.count_distinct("ticker").alias("tickers"),
        F.count_distinct(F.to_date(F.timestamp_millis("event_time_ms"))).alias("days"),
        F.avg((y == "price_shock").cast("double")).alias("price_shock"),
        F.avg((y == "wash_trade").cast("double")).alias("wash_trade"),
        F.avg((y != "normal").cast("double")).alias("any"),
    )

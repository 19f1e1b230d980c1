"""Labelled-data preparation: anomalies written into a tick table.

All randomness is a hash of (seed, ticker, position), so the outcome does not
depend on partitioning, retries or row order in files. Events are chosen on
the few candidate rows only and joined back on (ticker, pos).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.operators.quality import session_sigma
from tapewatch.operators.quantiles import smallest_k
from tapewatch.operators.slices import Slicing, drop_halo, with_previous_rows
from tapewatch.operators.ticks import TICKS, indexed
from tapewatch.session import cut_lineage

# Fixed values of the injector.
SESSION_GAP_MS = 600_000
SHOCK_TICKS = 5
WASH_TICKS = (4, 9)
SHOCK_SIGMAS = (4.0, 8.0)
WASH_VOLUME = (6.0, 15.0)
JITTER_SIGMAS = 0.1
LEAST_SESSION = 20
CLEARANCE = 40

SPREAD = 1 << 13  # positions whose candidates are in one row
SLOTS = 1 << 12  # places of a stretch that one task spells out


@dataclass(frozen=True)
class Variant:
    """A harder kind of event: a shock built up over ``length`` ticks, or a
    wash trade split into small prints over ``length`` ticks."""

    kind: str
    family: str
    length: tuple[int, int]
    volume: tuple[float, float] | None = None


# The development and the held-out variants.
EXISTING_VARIANTS = (
    Variant("shock_ramp", "price_shock", (8, 20)),
    Variant("wash_split", "wash_trade", (15, 30), (1.5, 3.0)),
)
HELDOUT_VARIANTS = (
    Variant("shock_ramp_long", "price_shock", (25, 40)),
    Variant("wash_split_fine", "wash_trade", (15, 30), (1.2, 2.0)),
)


def _digits(seed: int, salt: str, keys: tuple[str, ...], n: int) -> Column:
    """The first n hexadecimal digits of a hash of seed, salt and keys, as a number."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(salt), *[F.col(k) for k in keys]))
    return F.conv(F.substring(digest, 1, n), 16, 10).cast("long")


def uniform(seed: int, salt: str, *keys: str) -> Column:
    """A number in [0, 1) that depends only on seed, salt and keys: 52 bits of
    an md5, which any database can draw again."""
    return _digits(seed, salt, keys, 13) / F.lit(float(1 << 52))


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(low) + u * F.lit(high - low)


def whole(u: Column, low: int, high: int) -> Column:
    """Integer in [low, high]."""
    return (F.lit(low) + F.floor(u * F.lit(high - low + 1))).cast("int")


def normal(seed: int, salt: str, *keys: str) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - uniform(seed, salt + "/r", *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, salt + "/a", *keys))


def _sessions(ticks: DataFrame, population: bool) -> DataFrame:
    ends = ticks.groupBy("ticker", "session_id").agg(
        F.count("*").alias("_ticks"), F.min("pos").alias("_first"), F.max("pos").alias("_last")
    )
    return ends.join(session_sigma(ticks, population), ["ticker", "session_id"])


def _fold(longest: int):
    """From where the choice stands at the end of each block, for every place
    where it may stand at its start, to where it really stands at its start."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        carry, before, out = 0, None, []
        for block, ends in zip(blocks["_block"], blocks["_ends"]):
            carry = carry if before == block - 1 else 0
            out.append(carry)
            carry, before = int(ends[carry]), block
        return pd.DataFrame({"ticker": blocks["ticker"], "_block": blocks["_block"], "_carry": out})

    return run


def _spread_out(candidates: DataFrame, longest: int) -> DataFrame:
    """Keeps candidates in order, skipping any that starts inside the previous
    kept one; none is longer than ``longest`` ticks.

    Positions are cut into blocks. An event reaches at most ``longest - 1``
    ticks into the next block, so a block is a function of that many starts; the
    functions are folded along a ticker (one row per block), and then every
    block chooses on its own. No row holds more than a block, however dense the
    candidates are."""
    fields = [c for c in candidates.columns if c not in ("ticker", "pos")]
    start = F.col("_block") * F.lit(SPREAD)

    def free_after(first: Column) -> Column:
        return F.aggregate(
            "_all", first.cast("long"), lambda free, x: F.when(x["pos"] >= free, x["pos"] + x["length"]).otherwise(free)
        )

    packed = (
        candidates.withColumn("_block", F.floor(F.col("pos") / F.lit(SPREAD)))
        .groupBy("ticker", "_block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_all"))
    )
    ends = [F.greatest(free_after(start + c) - start - SPREAD, F.lit(0)).cast("int") for c in range(longest)]
    packed = cut_lineage(packed.withColumn("_ends", F.array(*ends)))
    carried = packed.select("ticker", "_block", "_ends").groupBy("ticker").applyInPandas(
        _fold(longest), "ticker string, _block long, _carry int"
    )
    first = F.struct((start + F.col("_carry")).cast("long").alias("free"), F.slice("_all", 1, 0).alias("kept"))
    chosen = F.aggregate(
        "_all",
        first,
        lambda acc, x: F.when(
            x["pos"] >= acc["free"],
            F.struct(
                (x["pos"] + x["length"]).cast("long").alias("free"),
                F.concat(acc["kept"], F.array(x)).alias("kept"),
            ),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    kept = packed.join(carried, ["ticker", "_block"]).select("ticker", F.explode(chosen).alias("e"))
    return kept.select("ticker", "e.*")


def _written_in(base: DataFrame, touched: DataFrame) -> DataFrame:
    """Ticks with what changes them. Spark takes the spelled out ticks of the
    events for as few bytes as the events: the hint keeps them from being
    broadcast, through the driver, by that guess."""
    return base.join(touched.hint("merge"), ["ticker", "pos"], "left")


def inject_anomalies(
    ticks: DataFrame, rate: float = 0.008, seed: int = 42, s: Slicing = TICKS, session_gap_ms: int = SESSION_GAP_MS
) -> DataFrame:
    """Ticks with price shocks and wash bursts written in, the first tick of
    each labelled. Needs bid and ask; sessions below 20 ticks stay untouched.

    ``rate`` is the chance that a tick starts an event, up to 1: of colliding
    candidates the first that is free counts."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be in (0, 1]")
    base = cut_lineage(indexed(ticks.drop("label"), session_gap_ms, s))
    sessions = _sessions(base, population=True)
    key = ("ticker", "pos")
    left = F.col("_last") - F.col("pos") + 1
    shock = uniform(seed, "kind", *key) < 0.5
    length = F.when(shock, F.lit(SHOCK_TICKS)).otherwise(whole(uniform(seed, "length", *key), *WASH_TICKS))
    candidates = (
        base.filter(uniform(seed, "start", *key) < rate)
        .join(sessions.filter(F.col("_ticks") >= LEAST_SESSION), ["ticker", "session_id"])
        .select(
            "ticker", "pos", "session_id", *s.order,
            F.when(shock, "price_shock").otherwise("wash_trade").alias("kind"),
            F.least(length, left).cast("int").alias("length"),
            F.col("price").alias("anchor"),
            "sigma",
            (
                F.when(uniform(seed, "side", *key) > 0.5, 1.0).otherwise(-1.0)
                * between(uniform(seed, "size", *key), *SHOCK_SIGMAS)
                * F.col("sigma")
            ).alias("size"),
        )
    )
    events = _spread_out(candidates, max(SHOCK_TICKS, WASH_TICKS[1]))
    touched = events.select(
        "ticker", F.col("pos").alias("start_pos"), "kind", "length", "anchor", "sigma", "size"
    ).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
    touched = touched.withColumn("pos", F.col("start_pos") + F.col("step"))
    rows = _written_in(base, touched)
    shift = F.col("size") * (1 - F.col("step") / F.col("length"))
    flat = F.col("anchor") + normal(seed, "jitter", *key) * F.col("sigma") * JITTER_SIGMAS
    half = (F.col("ask") - F.col("bid")) / 2
    is_shock, is_wash = F.col("kind") == "price_shock", F.col("kind") == "wash_trade"
    out = rows.withColumns(
        {
            "_price": F.when(is_shock, F.col("price") + shift).when(is_wash, flat).otherwise(F.col("price")),
            "volume": F.when(is_wash, F.col("volume") * between(uniform(seed, "volume", *key), *WASH_VOLUME)).otherwise(
                F.col("volume")
            ),
            "label": F.when(F.col("step") == 0, F.col("kind")).otherwise("normal"),
        }
    )
    return out.withColumns(
        {
            "bid": F.when(is_shock, F.col("bid") + shift).when(is_wash, F.col("_price") - half).otherwise(F.col("bid")),
            "ask": F.when(is_shock, F.col("ask") + shift).when(is_wash, F.col("_price") + half).otherwise(F.col("ask")),
            "price": F.col("_price"),
        }
    ).select(*[c for c in ticks.columns if c != "label"], "label", "pos", "session_id")


def _free_stretches(base: DataFrame, sessions: DataFrame) -> DataFrame:
    """Runs of positions inside one session, ``CLEARANCE`` ticks away from every
    label: ``ticker, a, b`` (b excluded)."""
    near, none = F.lit(CLEARANCE), F.lit(0)
    marks = (
        base.filter(F.col("label") != "normal").select("ticker", "pos", F.lit(2).alias("_rank"), near.alias("_off"), near.alias("_lead"))
        .unionByName(
            sessions.select("ticker", F.col("_first").alias("pos"), F.lit(1).alias("_rank"), none.alias("_off"), none.alias("_lead"))
        )
        .unionByName(
            sessions.select("ticker", (F.col("_last") + 1).alias("pos"), F.lit(0).alias("_rank"), none.alias("_off"), none.alias("_lead"))
        )
    )
    line = Slicing(width_ms=1 << 20, time="pos", tie=("_rank",))
    halo = with_previous_rows(marks, 1, line, ["_off"])
    w = line.window()
    start = F.lag("pos").over(w) + F.lag("_off").over(w)
    stretches = drop_halo(halo.withColumn("a", start)).withColumn("b", F.col("pos") - F.col("_lead"))
    return stretches.filter(F.col("b") > F.col("a")).select("ticker", "a", "b")


def _slots(stretches: DataFrame, slots: Column) -> DataFrame:
    """A row for each of ``slots`` numbers from 0 (column ``_slot``). A long
    stretch is dealt out in parts before it is spelled out."""
    parts = stretches.withColumn("_slots", slots.cast("long")).filter("_slots > 0")
    parts = parts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / SLOTS))))
    parts = parts.repartition("ticker", "a", "_part")
    first = F.col("_part") * SLOTS
    return parts.withColumn("_slot", F.explode(F.sequence(first, F.least(first + SLOTS, F.col("_slots")) - 1)))


def variant_base(ticks: DataFrame, s: Slicing = TICKS, session_gap_ms: int = SESSION_GAP_MS) -> tuple[DataFrame, DataFrame]:
    """``(indexed ticks, sessions)``, which are the same for all variants."""
    base = cut_lineage(indexed(ticks, session_gap_ms, s))
    return base, cut_lineage(_sessions(base, population=False))


def inject_variant(
    ticks: DataFrame, variant: Variant, seed: int = 7, s: Slicing = TICKS, session_gap_ms: int = SESSION_GAP_MS,
    base: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(ticks, spans)``: labelled ticks with as many events of the variant per
    ticker as it has original events of the family, as far as there is room.

    Free stretches between labels are filled with slots that fit the longest
    event plus the clearance to the next; of all slots of a ticker, those with
    the smallest hash are used. ``base`` is ``variant_base`` of the same ticks,
    for several variants of them."""
    base, sessions = base or variant_base(ticks, s, session_gap_ms)
    key = ("ticker", "pos")
    tail = SHOCK_TICKS if variant.family == "price_shock" else 0
    longest = variant.length[1] + tail
    step = longest + CLEARANCE
    targets = base.filter(F.col("label") == variant.family).groupBy("ticker").agg(F.count("*").alias("_target"))
    room = F.col("b") - F.col("a")
    slots = F.floor((room + CLEARANCE) / step)
    spare = room - (slots * step - CLEARANCE)
    shift = F.floor(uniform(seed, variant.kind + "/shift", "ticker", "a") * (spare + 1))
    places = (
        _slots(_free_stretches(base, sessions), slots)
        .select("ticker", (F.col("a") + shift + F.col("_slot") * step).alias("pos"))
        .join(targets, "ticker")
        .withColumn("_priority", _digits(seed, variant.kind, key, 15))
    )
    picked = smallest_k(places, "_priority", "_target", ["ticker"]).withColumn(
        "_ramp", whole(uniform(seed, variant.kind + "/length", *key), *variant.length)
    ).withColumn("length", F.col("_ramp") + tail)
    chosen = picked.join(
        base.select("ticker", "pos", "session_id", F.col("price").alias("anchor")), ["ticker", "pos"]
    ).join(sessions.select("ticker", "session_id", "sigma"), ["ticker", "session_id"])
    side = F.when(uniform(seed, variant.kind + "/side", *key) > 0.5, 1.0).otherwise(-1.0)
    events = cut_lineage(
        chosen.select(
            "ticker", "pos", "length", "_ramp", "anchor", "sigma",
            (side * between(uniform(seed, variant.kind + "/size", *key), *SHOCK_SIGMAS) * F.col("sigma")).alias("size"),
        )
    )
    spans = events.select(
        "ticker", F.col("pos").alias("start_pos"), (F.col("pos") + F.col("length")).alias("end_pos"),
        F.lit(variant.kind).alias("kind"),
    )
    touched = (
        events.withColumn("step", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))))
        .withColumn("pos", F.col("pos") + F.col("step"))
    )
    rows = _written_in(base, touched)
    hit = F.col("step").isNotNull()
    if variant.family == "price_shock":
        climb = (F.col("step") + 1) / F.col("_ramp")
        decay = 1 - (F.col("step") - F.col("_ramp") + 1) / F.lit(float(SHOCK_TICKS))
        share = F.when(F.col("step") < F.col("_ramp"), climb).otherwise(decay)
        changed = {"price": F.when(hit, F.col("price") + F.col("size") * share).otherwise(F.col("price"))}
    else:
        jitter = normal(seed, variant.kind + "/jitter", *key) * F.col("sigma") * JITTER_SIGMAS
        multiple = between(uniform(seed, variant.kind + "/volume", *key), *variant.volume)
        changed = {
            "price": F.when(hit, F.col("anchor") + jitter).otherwise(F.col("price")),
            "volume": F.when(hit, F.col("volume") * multiple).otherwise(F.col("volume")),
        }
    kept = [*ticks.columns, "pos", "session_id", "tick_id"]
    return rows.withColumns(changed).select(*dict.fromkeys(kept)), spans

"""Batch detector: the recursive kernel over time slices of each ticker.

A ticker's timeline is cut into slices of about equally many ticks, which run
in parallel. Each slice first replays some ticks before it to rebuild the
carried state, then scores its own ticks. The rebuilt state is afterwards
compared, bit by bit, with the state the previous slice really ended with;
slices where they differ are scored again from the true state, until none is
left. The result is therefore the one of a single sequential pass, however the
timeline is cut, and a ticker with a third of all rows is spread over as many
tasks as it has slices.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from tapewatch.operators.kernel import score_block, scored_frame
from tapewatch.operators.slices import HALO, SLICE, Slicing
from tapewatch.operators.ticks import TICKS
from tapewatch.params import DetectorParams
from tapewatch.schemas import SCORED
from tapewatch.session import cut_lineage

# on the one bookkeeping row of a slice, null on all others
BOOK = [
    StructField("first_ms", LongType()),
    StructField("last_ms", LongType()),
    StructField("reset_ms", LongType()),
    StructField("start_state", StringType()),
    StructField("end_state", StringType()),
]
INPUT = ["ticker", "event_time_ms", "price", "volume"]


def _dump(state: dict | None) -> str:
    return json.dumps(state, sort_keys=True) if state and state["last_ts"] is not None else ""


PANDAS_TYPES = {
    StringType(): "object",
    LongType(): "Int64",
    BooleanType(): "boolean",
    DoubleType(): "float64",
    TimestampType(): "datetime64[ns]",
}


def unit_schema(fields: Sequence[StructField]) -> StructType:
    """The rows of a slice: its parameter set, its number, ``fields`` (with
    ``ticker`` among them) and the bookkeeping. All are null on some rows."""
    own = [StructField(f.name, f.dataType) for f in fields]
    return StructType([StructField("param_id", StringType()), StructField(SLICE, LongType()), *own, *BOOK])


def typed(frame: pd.DataFrame, schema: StructType) -> pd.DataFrame:
    known = {f.name: PANDAS_TYPES[f.dataType] for f in schema.fields if f.dataType in PANDAS_TYPES}
    return frame.reindex(columns=schema.fieldNames()).astype(known)


def book_row(ticker: str, ms, reset_ms: int, start: str, end: str) -> pd.DataFrame:
    """The bookkeeping of a slice. Of the state it starts from only the digest
    is kept: nothing starts there again."""
    digest = hashlib.sha256(start.encode()).hexdigest()
    return pd.DataFrame(
        {"ticker": [ticker], "first_ms": [int(ms[0])], "last_ms": [int(ms[-1])], "reset_ms": [int(reset_ms)],
         "start_state": [digest], "end_state": [end]}
    )


def split_unit(pdf: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """The slice's own ticks in order, and those that it replays, if any."""
    pdf = pdf.sort_values(order, kind="stable")
    if HALO not in pdf:
        return pdf, None
    halo = pdf[pdf[HALO]]
    return pdf[~pdf[HALO]], halo if len(halo) else None


def _score_unit(
    pdf: pd.DataFrame, order: list[str], params: Mapping[str, DetectorParams], starts: dict, carried: list[str], schema: StructType,
    flags_only: bool = False,
) -> Iterator[pd.DataFrame]:
    own, burn = split_unit(pdf, order)
    if own.empty:  # the slice only sees ticks of an earlier one
        return
    ticker, slice_id = own["ticker"].iat[0], int(own[SLICE].iat[0])
    arrays = [own[c].to_numpy() for c in INPUT[1:]]
    for name, p in params.items():
        state = json.loads(starts[name]) if starts.get(name) else None
        if burn is not None:
            _, _, state = score_block(ticker, *[burn[c].to_numpy() for c in INPUT[1:]], p, state)
        start = _dump(state)
        kept, columns, state = score_block(ticker, *arrays, p, state)
        rows = scored_frame(ticker, *(a[kept] for a in arrays), columns)
        for c in carried:
            rows[c] = own[c].to_numpy()[kept]
        if flags_only:
            rows = rows[rows["is_anomaly"].to_numpy()]
        book = book_row(ticker, arrays[0], p.gap_reset_ms, start, _dump(state))
        for part in (rows, book):
            yield typed(part.assign(param_id=name, **{SLICE: slice_id}), schema)


BROADCAST_ROWS = 200_000
SLICE_ROWS = 50_000  # ticks a task scores at a time: what it holds does not grow with a ticker


def slice_plan(ticks: DataFrame, target_rows: int, burn_ticks: int, reach_ms: int = 0) -> DataFrame:
    """Per ticker: where its slices start, how wide they are and how far back
    the replay reaches. A slow ticker gets wide slices, a hot one narrow ones.

    ``reach_ms`` is the look-back of the scorer. No slice is narrower, so that
    all that the states remember of the past is no more than the ticks
    themselves and a slice settles in a round or two however dense they are;
    and a replay sees the look-back of its first tick."""
    per = ticks.groupBy("ticker").agg(
        F.count("*").alias("_n"), F.min("event_time_ms").alias("_first"), F.max("event_time_ms").alias("_last")
    )
    slices = F.greatest(F.lit(1), F.floor(F.col("_n") / target_rows))
    if reach_ms:
        slices = F.greatest(F.lit(1), F.least(slices, F.floor((F.col("_last") - F.col("_first")) / reach_ms)))
    width = F.floor((F.col("_last") - F.col("_first")) / slices) + 1
    share = F.lit(burn_ticks) / (F.col("_n") / slices)
    burn = F.ceil(width * share) + (reach_ms if burn_ticks else 0)
    return per.select(
        "ticker", "_first", width.alias("_width"), burn.cast("long").alias("_burn"), (slices - 1).alias("_final"),
        F.ceil(F.col("_n") / slices).alias("_rows"),
    )


def _with_slices(ticks: DataFrame, plan: DataFrame, halo: bool) -> DataFrame:
    """Ticks with their slice and, as halo rows, those a later slice replays."""
    joined = ticks.join(plan, "ticker")
    since = F.col("event_time_ms") - F.col("_first")
    own = F.floor(since / F.col("_width"))
    if not halo:
        return joined.withColumn(SLICE, own).select(*ticks.columns, SLICE)
    last = F.least(F.floor((since + F.col("_burn")) / F.col("_width")), F.col("_final"))
    spread = joined.withColumn("_own", own).withColumn(SLICE, F.explode(F.sequence(F.col("_own"), last)))
    return spread.withColumn(HALO, F.col(SLICE) != F.col("_own")).select(*ticks.columns, SLICE, HALO)


def score_slices(
    ticks: DataFrame, score: Callable[[pd.DataFrame, dict], Iterable[pd.DataFrame]], schema: StructType, target_rows: int,
    burn_ticks: int, reach_ms: int = 0,
) -> DataFrame:
    """The rows that ``score`` gives for every slice of ``ticks``, as one pass
    over each ticker would.

    ``score(slice, starts)`` gives frames of ``schema`` (``unit_schema``), which
    leave the task one by one, a bookkeeping row for each parameter set among
    them. ``starts`` is empty at
    first; slices whose start differs from where their predecessor ended are
    scored again, for the sets named in ``starts``. Each round replays twice as
    many slices before such a one, from the state at the end of the last that
    is not replayed, as long as they are no more ticks than a usual slice."""
    plan = cut_lineage(slice_plan(ticks, target_rows, burn_ticks, reach_ms))  # one row per ticker
    size = plan.agg(F.count("*").alias("tickers"), F.max("_final").alias("final"), F.max("_rows").alias("rows")).first()
    if size["tickers"] <= BROADCAST_ROWS:
        plan = F.broadcast(plan)

    def first_pass(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from score(pd.concat(list(parts), ignore_index=True), {})

    def again(pdf: pd.DataFrame, fix: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(score(pdf, dict(zip(fix["param_id"], fix["start"])))), ignore_index=True)

    def rows_only(df: DataFrame) -> DataFrame:
        return df.filter(F.col("end_state").isNull()).drop(SLICE, *[f.name for f in BOOK])

    if not size["final"]:  # no ticker has a second slice: nothing to check
        return rows_only(_with_slices(ticks, plan, halo=False).groupBy("ticker", SLICE).applyInPandas(first_pass, schema))
    result = cut_lineage(_with_slices(ticks, plan, halo=True).groupBy("ticker", SLICE).applyInPandas(first_pass, schema))
    previous = Window.partitionBy("param_id", "ticker").orderBy(SLICE)
    unit = ["param_id", "ticker", SLICE]
    rounds = 0
    while True:
        rounds += 1
        back = max(1, min(2**rounds, SLICE_ROWS // max(size["rows"], 1)))
        states = result.filter(F.col("end_state").isNotNull())
        # only digests of the states are lined up per ticker
        books = states.select(
            *unit, "first_ms", "last_ms", "reset_ms",
            F.col("start_state").alias("start"), F.sha2("end_state", 256).alias("end"),
        ).select(
            *unit, "first_ms", "reset_ms", "start",
            F.lag("end").over(previous).alias("expected"),
            F.lag("last_ms").over(previous).alias("before_ms"),
            F.coalesce(F.lag(SLICE, back).over(previous), F.first(SLICE).over(previous)).alias("_from"),
        )
        differs = books.filter(
            F.col("expected").isNotNull()
            & (F.col("first_ms") - F.col("before_ms") <= F.col("reset_ms"))
            & (F.col("start") != F.col("expected"))
        ).select(*unit, "_from")
        ends = states.select("param_id", "ticker", F.col(SLICE).alias("_from"), F.col("end_state").alias("start"))
        # states hold a look-back of ticks and are never broadcast, whatever Spark takes them for
        if size["tickers"] * (size["final"] + 1) <= BROADCAST_ROWS:
            differs = F.broadcast(differs)
        else:
            ends = ends.hint("merge")
        wrong = cut_lineage(differs.join(ends, ["param_id", "ticker", "_from"]).select(*unit, "_from", "start"))
        if wrong.isEmpty():
            break
        todo = wrong.select("ticker", SLICE, "_from").distinct()
        todo = todo.select(
            "ticker", F.col(SLICE).alias("_unit"), F.explode(F.sequence(F.col("_from") + 1, F.col(SLICE))).alias("_own")
        )
        units = _with_slices(ticks, plan, halo=False).withColumnRenamed(SLICE, "_own").join(todo, ["ticker", "_own"])
        units = units.select(*ticks.columns, F.col("_unit").alias(SLICE), (F.col("_own") != F.col("_unit")).alias(HALO))
        redone = units.groupBy("ticker", SLICE).cogroup(wrong.groupBy("ticker", SLICE)).applyInPandas(again, schema)
        kept = result.join(wrong, unit, "left_anti").select(*schema.fieldNames())
        result = kept.unionByName(cut_lineage(redone))
        if rounds % 8 == 0:
            result = cut_lineage(result)
    return rows_only(result)


def detect_batch(
    ticks: DataFrame,
    params: DetectorParams | Mapping[str, DetectorParams] = DetectorParams(),
    s: Slicing = TICKS,
    target_rows: int = SLICE_ROWS,
    burn_ticks: int = 8_192,
    carry: Sequence[str] = (),
    flags_only: bool = False,
) -> DataFrame:
    """Scored ticks (``SCORED``, plus ``param_id`` when several parameter sets
    are given; all sets are scored in one read of the ticks).

    ``target_rows`` per slice and ``burn_ticks`` replayed before one affect
    only speed: the slower averages need some thousand ticks to forget their
    start. ``s`` names the columns that order ticks. Columns in ``carry``
    (labels, periods) come out beside the scores of their tick; the kernel is
    given time, price and volume and cannot read them. With ``flags_only`` the
    ticks that no signal flags stay in the scorer."""
    many = isinstance(params, Mapping)
    sets = dict(params) if many else {"": params}
    order, carried = list(s.order), list(carry)
    taken = set(carried) & {*SCORED.fieldNames(), "param_id", SLICE, HALO, *[f.name for f in BOOK]}
    if taken:
        raise ValueError(f"columns of the result cannot be carried: {sorted(taken)}")
    narrow = ticks.select(*dict.fromkeys([*INPUT, *order, *carried]))
    schema = unit_schema([*SCORED.fields, *[narrow.schema[c] for c in carried]])
    rows = score_slices(
        narrow, lambda pdf, starts: _score_unit(pdf, order, {k: sets[k] for k in starts or sets}, starts, carried, schema, flags_only),
        schema, target_rows, burn_ticks, max(p.wash_lookback_ms for p in sets.values()),
    )
    return rows if many else rows.drop("param_id")


def attach_labels(scored: DataFrame, ticks: DataFrame, *columns: str) -> DataFrame:
    """Scored rows with columns of the tick table, matched on the tick id
    (ticks from ``with_tick_id`` or ``indexed``)."""
    return scored.join(ticks.select("ticker", "tick_id", *columns), ["ticker", "tick_id"], "left")

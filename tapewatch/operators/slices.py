"""Window operators that survive a hot key.

A plain ``Window.partitionBy("ticker")`` puts all ticks of a ticker into one
task. Here a ticker's timeline is cut into time slices, windows run per
``(ticker, slice)``, and what a slice needs from its past arrives in one of
three ways:

* ``with_previous_rows``   the last n rows before the slice, as extra rows;
* ``with_previous_span``   the rows of the last L milliseconds, as extra rows
                           (``with_context`` gives both);
* ``with_carry``           one value folded over all earlier slices.

Extra rows are marked ``is_halo`` and dropped after the window (``drop_halo``).
The fold runs over one summary row per slice, so what a single task holds is
bounded by the number of slices of a ticker, never by its ticks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE = "slice_id"
HALO = "is_halo"
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Slicing:
    """How a timeline is cut. ``keys`` may be empty: one global timeline."""

    width_ms: int = HOUR_MS
    keys: tuple[str, ...] = ("ticker",)
    time: str = "event_time_ms"
    tie: tuple[str, ...] = ("arrival",)

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tie)

    @property
    def slice_keys(self) -> list[str]:
        return [*self.keys, SLICE]

    def by(self, **changes) -> "Slicing":
        return replace(self, **changes)

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SLICE, F.floor(F.col(self.time) / F.lit(self.width_ms)))

    def window(self, *order: str) -> WindowSpec:
        """Rows of one slice, in time order."""
        return Window.partitionBy(*self.slice_keys).orderBy(*(order or self.order))

    def over_slices(self) -> WindowSpec:
        """Summary rows of one timeline, in slice order."""
        return Window.partitionBy(*self.keys).orderBy(SLICE)


def plan_width(df: DataFrame, s: Slicing, target_rows: int = 1_000_000, least_ms: int = 1_000) -> int:
    """Slice width that gives the busiest key about ``target_rows`` per slice.
    One pass over the key and time columns; run it once per dataset."""
    per_key = df.groupBy(*s.keys).agg(
        F.count("*").alias("n"), (F.max(s.time) - F.min(s.time)).alias("span")
    )
    row = per_key.agg(F.max(F.col("n") / (F.col("span") + 1)).alias("rate")).first()
    rate = row["rate"] if row and row["rate"] else None
    return max(least_ms, int(target_rows / rate)) if rate else HOUR_MS


def _rows_before(df: DataFrame, n: int, s: Slicing, cols: Sequence[str]) -> DataFrame:
    """The last n rows before every slice, with the slice that sees them.

    Taken per slice first (per map task before the shuffle), then folded over
    slices, because a thin slice may hold fewer than n rows."""
    if n == 1 and set(cols) <= {s.time}:  # the newest time alone: a hash aggregation
        newest = s.assign(df).groupBy(*s.slice_keys).agg(F.max(s.time).alias("_tail"))
        before = newest.withColumn(s.time, F.lag("_tail").over(s.over_slices())).drop("_tail")
        return before.filter(F.col(s.time).isNotNull())
    kept = list(dict.fromkeys([*s.keys, *s.order, *cols]))
    row = F.struct(*[F.col(c) for c in (*s.order, *[c for c in kept if c not in s.order])]).alias("_row")
    narrow = s.assign(df).select(*s.slice_keys, row)
    if n == 1:
        tails = narrow.groupBy(*s.slice_keys).agg(F.max("_row").alias("_tail"))
        before = tails.withColumn("_row", F.lag("_tail").over(s.over_slices()))
        return before.filter(F.col("_row").isNotNull()).select(SLICE, "_row.*")
    newest = Window.partitionBy(*s.slice_keys).orderBy(*[F.desc(f"_row.{c}") for c in s.order])
    tails = (
        narrow.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
        .groupBy(*s.slice_keys)
        .agg(F.sort_array(F.collect_list("_row"), asc=False).alias("_tail"))
    )
    earlier = s.over_slices().rowsBetween(-n, -1)
    newest_first = F.flatten(F.reverse(F.collect_list("_tail").over(earlier)))
    before = tails.withColumn("_rows", F.slice(newest_first, 1, n))
    return before.select(SLICE, F.explode("_rows").alias("_row")).select(SLICE, "_row.*")


def with_context(
    df: DataFrame, s: Slicing, rows: int = 0, span_ms: int = 0, cols: Sequence[str] = (), source: DataFrame | None = None
) -> DataFrame:
    """df cut into slices, each preceded by what windows reaching back ``rows``
    rows or ``span_ms`` milliseconds may read, so that both kinds of window run
    over one shuffle. ``cols`` are the columns they read. ``source`` may give a
    cheaper frame with the same rows to take them from (the table df was
    derived from)."""
    spread = with_previous_span(df, span_ms, s) if span_ms else s.assign(df).withColumn(HALO, F.lit(False))
    if not rows:
        return spread
    halo = _rows_before(df if source is None else source, rows, s, cols)
    if span_ms:  # younger rows are there already
        halo = halo.filter(F.col(s.time) < F.col(SLICE) * s.width_ms - span_ms)
    return spread.unionByName(halo.withColumn(HALO, F.lit(True)), allowMissingColumns=True)


def with_previous_rows(
    df: DataFrame, n: int, s: Slicing, cols: Sequence[str], source: DataFrame | None = None
) -> DataFrame:
    """df cut into slices, each preceded by copies of the n rows before it."""
    return with_context(df, s, rows=n, cols=cols, source=source)


def with_previous_span(df: DataFrame, span_ms: int, s: Slicing) -> DataFrame:
    """df cut into slices, each preceded by copies of the rows at most
    ``span_ms`` older than its start. No extra pass: a row is simply sent to
    every slice that can still see it."""
    own = F.floor(F.col(s.time) / F.lit(s.width_ms))
    last = F.floor((F.col(s.time) + F.lit(span_ms)) / F.lit(s.width_ms))
    return (
        df.withColumn("_own", own)
        .withColumn(SLICE, F.explode(F.sequence(F.col("_own"), last)))
        .withColumn(HALO, F.col(SLICE) != F.col("_own"))
        .drop("_own")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO)


def with_carry(
    df: DataFrame,
    s: Slicing,
    partial: dict[str, Column],
    fold: dict[str, Callable[[Column], Column]],
    source: DataFrame | None = None,
) -> DataFrame:
    """Adds one column per entry: ``partial`` aggregates a slice, ``fold``
    aggregates those results over all earlier slices (null for the first).
    ``source`` may give a cheaper sliced frame to aggregate."""
    summary = (df if source is None else source).groupBy(*s.slice_keys).agg(*[c.alias(f"_{name}") for name, c in partial.items()])
    earlier = s.over_slices().rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *s.slice_keys, *[fold[name](F.col(f"_{name}")).over(earlier).alias(name) for name in partial]
    )
    return df.join(carried, s.slice_keys, "left")


def running_sum(df: DataFrame, s: Slicing, **sums: str | Column) -> DataFrame:
    """Running totals (current row included) over each whole timeline."""
    exprs = {name: F.col(e) if isinstance(e, str) else e for name, e in sums.items()}
    df = df.select("*", *[e.alias(f"_v_{name}") for name, e in exprs.items()])
    carried = with_carry(
        df,
        s,
        {f"_c_{name}": F.sum(f"_v_{name}") for name in exprs},
        {f"_c_{name}": F.sum for name in exprs},
    )
    w = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = carried
    for name in exprs:
        inside = F.sum(f"_v_{name}").over(w)
        before = F.col(f"_c_{name}")
        out = out.withColumn(name, F.coalesce(before + inside, before, inside))
    return out.drop(*[f"_v_{n}" for n in exprs], *[f"_c_{n}" for n in exprs])


def ranked(df: DataFrame, s: Slicing, name: str = "pos") -> DataFrame:
    """0-based position of every row in its timeline (df already sliced)."""
    carried = with_carry(df, s, {"_before": F.count("*")}, {"_before": F.sum})
    inside = F.row_number().over(s.window()) - 1
    return carried.withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + inside).drop("_before")


@dataclass(frozen=True)
class Part:
    """A number that can be put together from parts of a range: how to
    aggregate rows, how to aggregate aggregates, and how to put two together.
    Null stands for a range without rows."""

    rows: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    both: Callable[..., Column]


def _added(*parts: Column) -> Column:
    total = reduce(Column.__add__, [F.coalesce(p, F.lit(0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


SUM, LEAST, GREATEST = Part(F.sum, F.sum, _added), Part(F.min, F.min, F.least), Part(F.max, F.max, F.greatest)


def within_span(s: Slicing, span_ms: int) -> Slicing:
    """The cut with slices no wider than a look-back."""
    return s.by(width_ms=min(s.width_ms, span_ms))


def trailing_ranges(df: DataFrame, span_ms: int, wanted: dict[str, tuple[Part, Column]], s: Slicing) -> DataFrame:
    """Adds, for each entry, its aggregate over the rows of the timeline with a
    time in ``[t - span_ms, t)``, for slices of any width. Slices wider than
    the span are cut down to it (``SLICE`` of the result says how): every
    window below then starts or ends with its slice and takes a row once,
    where one that slides over dense ticks adds all of its rows up for each.

    A range is put together from three parts: the end of the slice that holds
    ``t - span_ms``, the summaries of whole slices in between, and the row's own
    slice before it. For the first part a row is sent to that slice once, as a
    question, and comes back with the answer; so a row is in two places at
    most, however many slices a range covers, and what a task holds is one
    slice. Of the slices in between only the first is not the same for all rows
    of a slice, so two summaries per slice are enough."""
    s = within_span(s, span_ms)
    width = F.lit(s.width_ms)
    values = {name: value for name, (_, value) in wanted.items()}
    since = F.col(s.time) - F.lit(span_ms)
    asked = df.withColumns({"_value": F.lit(False), "_own": F.floor(F.col(s.time) / width), SLICE: F.floor(since / width), "_at": since})
    told = df.select(
        *s.keys, F.floor(F.col(s.time) / width).alias(SLICE), F.col(s.time).alias("_at"), F.lit(True).alias("_value"),
        *[v.alias(f"_{name}") for name, v in values.items()],
    )
    both = asked.unionByName(told, allowMissingColumns=True)
    suffix = Window.partitionBy(*s.slice_keys).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = {f"_end_{name}": part.rows(F.col(f"_{name}")).over(suffix) for name, (part, _) in wanted.items()}
    answered = both.select("*", *[c.alias(n) for n, c in ends.items()]).filter(~F.col("_value"))
    answered = answered.withColumns({n: F.when(F.col(SLICE) < F.col("_own"), F.col(n)) for n in ends})
    answered = answered.select(*df.columns, F.col("_own").alias(SLICE), F.col(SLICE).alias("_first"), *ends)
    most = -(-span_ms // s.width_ms)  # the first slice is this many back, or one less
    joined = answered
    if most > 1:  # whole slices between: after the first of the range and before the own
        summary = told.groupBy(*s.slice_keys).agg(*[part.rows(F.col(f"_{name}")).alias(f"_{name}") for name, (part, _) in wanted.items()])
        spans = {}
        for k in (most, most - 1):
            between = s.over_slices().rangeBetween(-(k - 1), -1) if k > 1 else None
            for name, (part, _) in wanted.items():
                column = F.col(f"_{name}")
                spans[f"_mid{k}_{name}"] = part.merge(column).over(between) if between is not None else F.lit(None).cast("double")
        joined = answered.join(summary.select(*s.slice_keys, *[c.alias(n) for n, c in spans.items()]), s.slice_keys)
    inside = s.window(s.time).rangeBetween(Window.unboundedPreceding, -1)  # the slice begins after t - span_ms
    back = F.col(SLICE) - F.col("_first")
    out = {}
    for name, (part, value) in wanted.items():
        parts = [F.col(f"_end_{name}"), part.rows(value).over(inside)]
        if most > 1:
            mid = F.when(back == most, F.col(f"_mid{most}_{name}")).when(back == most - 1, F.col(f"_mid{most - 1}_{name}"))
            parts.insert(1, mid)
        out[name] = part.both(*parts)
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, SLICE, *[c.alias(n) for n, c in out.items()])

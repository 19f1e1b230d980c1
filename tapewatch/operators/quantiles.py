"""Exact percentiles without holding a group in one aggregation buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.slices import Slicing, ranked
from tapewatch.session import cut_lineage

GRID = 200
BUCKET = 1 << 15  # rows of a key that are ranked together


def exact_percentiles(df: DataFrame, value: str, wanted: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``n`` and exact percentiles with linear interpolation between closest
    ranks, per group of a short list of report groups.

    Every wanted rank starts with the bracket from the least to the greatest
    value. A round sketches what lies in each bracket, takes the sketched values
    next to the ranks as cuts, counts the rows of each cell between and at the
    cuts, and makes the cell that holds a rank its next bracket, until that is
    one value. A poor sketch costs another round, never a wrong result. Ranks
    with one bracket share its rows, so a row is read once however many ranks
    are wanted; what lies in no bracket any more (some 98 of 100 rows after one
    round) is not read again. What comes back from a round is some rows per
    group and rank, whatever the number of rows."""
    by = list(by)
    # groups may be null: they are joined by a hash of themselves
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    values = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    values = cut_lineage(values.withColumn("_g", group))
    totals = cut_lineage(
        values.groupBy("_g", *by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    values = values.select("_g", "_v")
    ranks = []
    for i, p in enumerate(wanted.values()):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in enumerate((F.floor(at), F.ceil(at))):
            ranks.append(F.struct(F.lit(2 * i + side).alias("_i"), rank.cast("long").alias("_rank")))
    state = totals.select("_g", F.explode(F.array(*ranks)).alias("_r"), "_low", "_high")
    state = cut_lineage(state.select("_g", "_r._i", "_r._rank", "_low", "_high"))
    while not (wide := state.filter("_low < _high")).isEmpty():
        narrowed = cut_lineage(_narrow(values, wide))
        state = cut_lineage(state.filter("_low >= _high").unionByName(narrowed))
        values = cut_lineage(_within(values, narrowed.filter("_low < _high")).select("_g", "_v"))
    known = state.groupBy("_g").agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_low"))).alias(f"_x{i}") for i in range(2 * len(wanted))]
    )
    out = totals.join(known, "_g")
    columns = []
    for i, (name, p) in enumerate(wanted.items()):
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return out.select(*by, "n", *columns)


BRACKET = ["_g", "_low", "_high"]


def _holds(bracket) -> Column:
    return F.col("_v").between(bracket["_low"], bracket["_high"])


def _within(values: DataFrame, brackets: DataFrame, *columns: str) -> DataFrame:
    """The values that lie in a bracket, once each, with the brackets of their
    group and further ``columns`` of these as ``_b``."""
    own = brackets.groupBy("_g").agg(F.collect_set(F.struct("_low", "_high", *columns)).alias("_b"))
    return values.join(own, "_g").filter(F.exists("_b", _holds))


def _narrow(values: DataFrame, wide: DataFrame) -> DataFrame:
    """The brackets of ``wide`` after one more round."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    each = _within(values, wide).select("_g", "_v", F.explode(F.filter("_b", _holds)).alias("_b")).select("_g", "_v", "_b.*")
    sketch = each.groupBy(*BRACKET).agg(F.percentile_approx("_v", grid, 10_000).alias("_s"), F.count("*").alias("_m"))
    at = F.round(F.col("_rank") / F.greatest(F.col("_m") - 1, F.lit(1)) * GRID).cast("int")
    near = F.array(*[F.get("_s", F.greatest(F.lit(0), F.least(F.lit(GRID), at + step))) for step in (-1, 0, 1)])
    sought = wide.join(sketch, BRACKET).withColumn("_near", near)
    cuts = sought.groupBy(*BRACKET).agg(F.array_distinct(F.flatten(F.collect_list("_near"))).alias("_cuts"))
    again = _within(values, cut_lineage(cuts), "_cuts")
    again = again.select("_g", "_v", F.explode(F.filter("_b", _holds)).alias("_b")).select("_g", "_v", "_b.*")
    # even cells lie between cuts, odd ones are a cut
    cell = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
    counted = again.withColumn("_cell", cell).groupBy(*BRACKET, "_cell").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    before = Window.partitionBy(*BRACKET).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # some cells
    counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    held = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    return wide.join(counted, BRACKET).filter(held).select(
        "_g", "_i", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_least").alias("_low"), F.col("_most").alias("_high")
    )


def smallest_k(df: DataFrame, priority: str, k: str, keys: Sequence[str], bits: int = 60) -> DataFrame:
    """Per key, the rows with the k smallest values of ``priority``, a uniform
    number of ``bits`` bits (k is a column). Its leading bits deal a key out
    over as many buckets as the largest key needs, which are ranked one by
    one."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    leading = min(bits, max(1, (largest // BUCKET).bit_length()))
    s = Slicing(keys=tuple(keys), time=priority, tie=())
    sliced = df.withColumn("slice_id", F.shiftrightunsigned(F.col(priority), bits - leading))
    return ranked(sliced, s, "_rank").filter(F.col("_rank") < F.col(k)).drop("_rank", "slice_id")

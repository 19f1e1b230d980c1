"""Threshold sweeps over scored rows.

A sweep never multiplies rows by grid points: a row is reduced to how many
thresholds its score exceeds, rows are counted per such level, and the counts
(a few rows) are expanded to grid points afterwards. Windows and wash settings
change the recursion itself; ``cube`` counts those inside the scorer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.columns import prf_columns
from tapewatch.operators.quantiles import exact_percentiles
from tapewatch.session import cut_lineage

# The grids of the evaluation.
PR_Z_GRID = (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0)
CUSUM_GRID = tuple((k, h) for k in (1.0, 1.5, 2.0, 2.5) for h in (1.5, 2.0, 2.5, 3.0, 4.0, 6.0))
Z_STAGE = (4.5, 5.0, 5.5, 6.0, 7.0)
EWMA_STAGE = (2.75, 3.0, 3.5, 4.0)
NAIVE_QUANTILES = (0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999)
ALLOWED_LOSS = 0.005


def threshold_array(thresholds: Sequence[float] | Column) -> Column:
    if isinstance(thresholds, Column):
        return thresholds
    return F.array(*[F.lit(float(t)) for t in thresholds])


def sweep(
    rows: DataFrame,
    score: str | Column,
    positive: str | Column,
    thresholds: Sequence[float] | Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """tp, flagged and positives of ``score > threshold`` for every threshold
    and group. ``thresholds`` are ascending."""
    score = F.col(score) if isinstance(score, str) else score
    positive = F.col(positive) if isinstance(positive, str) else positive
    grid = threshold_array(thresholds)
    levels = (
        rows.select(*by, grid.alias("_grid"), F.coalesce(score, F.lit(float("-inf"))).alias("_s"), positive.alias("_y"))
        .withColumn("_level", F.size(F.filter("_grid", lambda t: F.col("_s") > t)))
        .groupBy(*by, "_level")
        .agg(F.count("*").alias("_n"), F.count_if("_y").alias("_pos"), F.any_value("_grid").alias("_grid"))
    )
    points = levels.select(
        *by, "_level", "_n", "_pos", F.posexplode("_grid").alias("grid_pos", "threshold")
    )
    over = F.col("_level") > F.col("grid_pos")
    return points.groupBy(*by, "grid_pos", "threshold").agg(
        F.sum(F.when(over, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(over, F.col("_n")).otherwise(0)).alias("n_flag"),
        F.sum("_pos").alias("n_pos"),
    )


def with_prf(counts: DataFrame) -> DataFrame:
    scores = prf_columns("tp", "n_flag", "n_pos")
    return counts.withColumns({k: v for k, v in scores.items() if k != "flagged"})


def best(rows: DataFrame, metric: str = "f1", by: Sequence[str] = (), order: str = "grid_pos") -> DataFrame:
    """The row with the highest metric; the first in grid order wins a tie."""
    fields = [c for c in rows.columns if c not in by]
    top = F.max_by(F.struct(*fields), F.struct(F.col(metric), -F.col(order)))
    return rows.groupBy(*by).agg(top.alias("_best")).select(*by, "_best.*")


def guarded(rows: DataFrame, base: DataFrame, target: str, loss: float = ALLOWED_LOSS, grid: str = "grid_pos") -> DataFrame:
    """Grid points at which no kind but ``target`` loses more than ``loss`` F1
    against the base. Rows: grid position, kind, f1; base: kind, f1."""
    against = rows.join(base.select("kind", F.col("f1").alias("_base")), "kind")
    fine = (F.col("kind") == target) | (F.col("f1") >= F.col("_base") - loss)
    keep = against.groupBy(grid).agg(F.bool_and(fine).alias("_ok")).filter("_ok").select(grid)
    return rows.join(keep, grid, "left_semi")


def best_guarded(rows: DataFrame, base: DataFrame, target: str = "price_shock", loss: float = ALLOWED_LOSS) -> DataFrame:
    allowed = guarded(rows, base, target, loss).filter(F.col("kind") == target)
    return best(allowed)


def naive_candidates(ticks: DataFrame, feature: str, quantiles: Sequence[float] = NAIVE_QUANTILES) -> Column:
    """Quantiles of a feature as a sorted array, usable as sweep thresholds."""
    row = exact_percentiles(ticks, feature, {f"q{i}": q for i, q in enumerate(quantiles)})
    return row.select(F.array(*[F.col(f"q{i}") for i in range(len(quantiles))])).scalar()


def tune_naive(ticks: DataFrame, quantiles: Sequence[float] = NAIVE_QUANTILES) -> DataFrame:
    """Best fixed thresholds on |return| and volume (``abs_return``, ``volume``
    and ``label`` of the training ticks), one row per type."""
    ticks = cut_lineage(ticks.select("abs_return", "volume", "label"))
    out = None
    for kind, feature in (("price_shock", "abs_return"), ("wash_trade", "volume")):
        counts = sweep(ticks, feature, F.col("label") == kind, naive_candidates(ticks, feature, quantiles))
        row = best(with_prf(counts)).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def pr_curve(rows: DataFrame, score: str | Column, positive: str | Column, grid: Sequence[float] = PR_Z_GRID) -> DataFrame:
    """Precision, recall and F1 per threshold and ``period``."""
    return with_prf(sweep(rows, score, positive, grid, ["period"]))


def leave_one_out(counts: DataFrame, key: str = "ticker") -> DataFrame:
    """For every key: the grid point tuned on all other keys, its F1 on the
    held-out key, and the key's own best. ``counts`` hold tp, n_flag and n_pos
    per grid point and key; held-out totals are the totals minus the key's."""
    grid = ["grid_pos", "threshold"]
    counts = cut_lineage(counts)  # a few rows, read three times
    totals = counts.groupBy(*grid).agg(*[F.sum(c).alias(f"_{c}") for c in ("tp", "n_flag", "n_pos")])
    joined = counts.join(totals, grid)
    others = joined.select(key, *grid, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in ("tp", "n_flag", "n_pos")])
    tuned = best(with_prf(others), by=[key]).select(key, F.col("grid_pos"), F.col("threshold").alias("tuned_threshold"))
    own = with_prf(counts)
    held = tuned.join(own.select(key, "grid_pos", F.col("f1").alias("held_out_f1")), [key, "grid_pos"])
    top = best(own, by=[key]).select(key, F.col("threshold").alias("own_threshold"), F.col("f1").alias("own_f1"))
    return held.join(top, key).drop("grid_pos")


def detector_scores(scored: DataFrame) -> DataFrame:
    """kind, flagged, tp, fp, flag_rate, precision, recall and f1 of scored
    ticks against their ``label``: each kind by its own flags, ``any`` by all."""
    kinds = [
        F.struct(F.lit(k).alias("kind"), F.coalesce(F.col("anomaly_type") == k, F.lit(False)).alias("flag"), (F.col("label") == k).alias("y"))
        for k in ("price_shock", "wash_trade")
    ]
    kinds.append(F.struct(F.lit("any").alias("kind"), F.col("anomaly_type").isNotNull().alias("flag"), (F.col("label") != "normal").alias("y")))
    each = scored.groupBy("anomaly_type", "label").agg(F.count("*").alias("n")).select("n", F.explode(F.array(*kinds)).alias("k"))

    def total(condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0))

    counts = each.groupBy("k.kind").agg(
        total("k.flag AND k.y").alias("tp"), total("k.flag").alias("n_flag"), total("k.y").alias("n_pos"), F.sum("n").alias("_n")
    )
    return with_prf(counts).select(
        "kind", F.col("n_flag").alias("flagged"), "tp", (F.col("n_flag") - F.col("tp")).alias("fp"),
        (F.col("n_flag") / F.col("_n")).alias("flag_rate"), "precision", "recall", "f1",
    )

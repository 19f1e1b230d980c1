"""Exceedance counts of many thresholds, made inside the scorer.

A tick is reduced to how many thresholds of a grid its z-score and its VWAP
divergence exceed, for every window, and to whether each wash setting flags it.
A slice counts its ticks by these levels and by columns such as the label and
the period, and only the counts leave it: their number is bounded by the grid,
not by the ticks. Counts add up over slices and tickers, so the confusion
counts of any setting, on any period and with any ticker held out, are sums and
differences of cells.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from tapewatch.functions.columns import prf_columns
from tapewatch.operators.detect import INPUT, SLICE_ROWS, book_row, score_slices, split_unit, typed, unit_schema
from tapewatch.operators.kernel import _clipped_zscore, _vwap_divergence, trailing, wash_rule
from tapewatch.operators.slices import SLICE, Slicing
from tapewatch.operators.ticks import TICKS
from tapewatch.params import DetectorParams
from tapewatch.session import cut_lineage

# The grids of the evaluation and the calibration.
WINDOWS = ((10, 5), (15, 10), (20, 10), (25, 10), (30, 10), (50, 20), (100, 30))
Z_GRID = (3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0)
VWAP_THRESHOLD = 0.01
WASH_GRID = tuple((r, w) for r in (0.2, 0.3, 0.5) for w in (0.0005, 0.001, 0.002))
TYPES = ("price_shock", "wash_trade", "any")


@dataclass(frozen=True)
class Grid:
    """Thresholds are ascending; grid positions count from 0. A tick is a
    shock at (z_i, vwap_j) if it exceeds either, a wash trade if the wash
    setting flags it and it is no shock."""

    windows: tuple[tuple[int, int], ...] = WINDOWS
    z: tuple[float, ...] = Z_GRID
    vwap: tuple[float, ...] = (VWAP_THRESHOLD,)
    wash: tuple[tuple[float, float], ...] = WASH_GRID

    def __post_init__(self):
        if list(self.z) != sorted(self.z) or list(self.vwap) != sorted(self.vwap):
            raise ValueError("thresholds of a grid are ascending")
        if not (self.windows and self.z and self.vwap and self.wash):
            raise ValueError("a grid has at least one setting of every kind")

    def wash_params(self, i: int, base: DetectorParams) -> DetectorParams:
        ratio, price_range = self.wash[i]
        return base.with_(wash_volume_ratio=ratio, wash_price_range=price_range)


CELL = [
    StructField("window", LongType()),
    StructField("wash", LongType()),
    StructField("z_level", LongType()),
    StructField("vwap_level", LongType()),
    StructField("washed", BooleanType()),
    StructField("n", LongType()),
]


def cold(grid: Grid) -> dict:
    return {
        "last_ts": None,
        "clipped": [[] for _ in grid.windows],
        "price": [],
        "volume": [],
        "rate_dt_ms": 0.0,
        "rate_n": 0,
        "hist_ts": [],
        "hist_price": [],
        "hist_volume": [],
    }


def _levels(values: np.ndarray, thresholds: Sequence[float]) -> np.ndarray:
    """How many thresholds each value exceeds; none while warming up."""
    return np.where(np.isnan(values), 0, np.searchsorted(np.asarray(thresholds), values, "left"))


def _session_levels(ms, price, volume, st: dict, grid: Grid, base: DetectorParams):
    """(levels by window, wash flags by setting) of a stretch without a reset.
    Updates ``st`` in place."""
    before = trailing(ms, price, volume, st, base)
    washed = [wash_rule(volume, before, grid.wash_params(i, base))[1] > base.risk_threshold for i in range(len(grid.wash))]
    levels = []
    for i, (size, least) in enumerate(grid.windows):
        p = base.with_(window_size=size, min_samples=least)
        z, band = _clipped_zscore(price, st["clipped"][i], p)
        vwap = _vwap_divergence(price, volume, st["price"][-size:], st["volume"][-size:], p)
        levels.append(_levels(np.abs(z), grid.z) * (len(grid.vwap) + 1) + _levels(vwap, grid.vwap))
        st["clipped"][i] = band[-size:].tolist()
    most = max(size for size, _ in grid.windows)
    st.update(
        last_ts=int(ms[-1]),
        price=([*st["price"], *price[-most:].tolist()])[-most:],
        volume=([*st["volume"], *volume[-most:].tolist()])[-most:],
        **before["state"],
    )
    return levels, washed


def level_block(ms, price, volume, state: dict | None, grid: Grid, base: DetectorParams):
    """(levels by window, wash flags by setting, state) of ticks in order; a
    pause longer than the reset gap starts cold."""
    st = dict(state) if state else cold(grid)
    st["clipped"] = list(st["clipped"])
    cuts = np.flatnonzero(np.diff(ms) > base.gap_reset_ms) + 1
    if st["last_ts"] is not None and ms[0] - st["last_ts"] > base.gap_reset_ms:
        st = cold(grid)
    parts = []
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ms)])):
        if i:
            st = cold(grid)
        parts.append(_session_levels(ms[a:b], price[a:b], volume[a:b], st, grid, base))
    levels = [np.concatenate([p[0][i] for p in parts]) for i in range(len(grid.windows))]
    washed = [np.concatenate([p[1][i] for p in parts]) for i in range(len(grid.wash))]
    return levels, washed, st


def count_cells(levels, washed, groups: np.ndarray, grid: Grid) -> dict[str, np.ndarray]:
    """Occupied cells: group, window, wash, z_level, vwap_level, washed, n."""
    columns: dict[str, list] = {k: [] for k in ("group", "window", "wash", "z_level", "vwap_level", "washed", "n")}
    inner = len(grid.vwap) + 1
    cells = (len(grid.z) + 1) * inner
    for w, level in enumerate(levels):
        code = (groups * cells + level) * 2
        for v, flag in enumerate(washed):
            counts = np.bincount(code + flag)
            at = np.flatnonzero(counts)
            place = at // 2
            for name, values in (
                ("group", place // cells), ("window", np.full(len(at), w)), ("wash", np.full(len(at), v)),
                ("z_level", place % cells // inner), ("vwap_level", place % inner), ("washed", at % 2 == 1), ("n", counts[at]),
            ):
                columns[name].append(values)
    return {k: np.concatenate(v) for k, v in columns.items()}


def exceedance_cube(
    ticks: DataFrame,
    grid: Grid = Grid(),
    base: DetectorParams = DetectorParams(),
    by: Sequence[str] = ("label",),
    s: Slicing = TICKS,
    target_rows: int = SLICE_ROWS,
    burn_ticks: int = 8_192,
) -> DataFrame:
    """One row per ticker, group of the ``by`` columns and occupied cell:
    ticker, by, window, wash, z_level, vwap_level, washed, n.

    ``window`` and ``wash`` are positions in the grid, the levels say how many
    thresholds are exceeded. ``base`` gives what the grid leaves open (clip,
    look-back, reset gap). Null groups are groups of their own. The counts are
    those of one pass over each ticker, however it is cut (``score_slices``)."""
    by, order = list(by), list(s.order)
    narrow = ticks.select(*dict.fromkeys([*INPUT, *order, *by]))
    cell_fields = [StructField("ticker", StringType()), *[narrow.schema[c] for c in by], *CELL]
    schema = unit_schema(cell_fields)

    def score(pdf: pd.DataFrame, starts: dict) -> list[pd.DataFrame]:
        own, burn = split_unit(pdf, order)
        if own.empty:
            return []
        ticker, slice_id = own["ticker"].iat[0], int(own[SLICE].iat[0])
        state = json.loads(starts[""]) if starts.get("") else None
        if burn is not None:
            _, _, state = level_block(*(burn[c].to_numpy() for c in INPUT[1:]), state, grid, base)
        start = json.dumps(state, sort_keys=True) if state else ""
        arrays = [own[c].to_numpy() for c in INPUT[1:]]
        levels, washed, state = level_block(*arrays, state, grid, base)
        if by:
            groups = own.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            first = pd.Series(np.arange(len(own))).groupby(groups).first()
            keys = own[by].iloc[first.to_numpy()].reset_index(drop=True)
        else:
            groups, keys = np.zeros(len(own), int), pd.DataFrame(index=[0])
        cells = count_cells(levels, washed, groups, grid)
        rows = pd.DataFrame({k: v for k, v in cells.items() if k != "group"})
        for c in by:
            rows[c] = keys[c].to_numpy()[cells["group"]]
        rows["ticker"] = ticker
        book = book_row(ticker, arrays[0], base.gap_reset_ms, start, json.dumps(state, sort_keys=True))
        return [typed(p.assign(param_id="", **{SLICE: slice_id}), schema) for p in (rows, book)]

    counted = score_slices(narrow, score, schema, target_rows, burn_ticks, base.wash_lookback_ms)
    keys = ["ticker", *by, "window", "wash", "z_level", "vwap_level", "washed"]
    return cut_lineage(counted.groupBy(*keys).agg(F.sum("n").alias("n")))


# --- reading a cube -----------------------------------------------------------

SETTING = ["window", "wash", "z_pos", "vwap_pos"]
COUNTS = [f"{c}_{k}" for k in TYPES for c in ("tp", "flag", "pos")]


def setting_counts(cube: DataFrame, grid: Grid, by: Sequence[str] = ()) -> DataFrame:
    """by, the setting (window, wash, z_pos, vwap_pos), for each of TYPES the
    true positives, flags and positives (``tp_any``, ``flag_any``, ``pos_any``)
    and n_ticks: one row per group and setting. Cumulative sums over both
    levels; needs ``label``."""
    by = list(by)
    cells = cube.groupBy(*by, "label", "window", "wash", "z_level", "vwap_level", "washed").agg(F.sum("n").alias("n"))
    points = cells.withColumn("z_pos", F.explode(F.sequence(F.lit(0), F.lit(len(grid.z) - 1))))
    points = points.withColumn("vwap_pos", F.explode(F.sequence(F.lit(0), F.lit(len(grid.vwap) - 1))))
    shock = (F.col("z_level") > F.col("z_pos")) | (F.col("vwap_level") > F.col("vwap_pos"))
    flags = {"price_shock": shock, "wash_trade": F.col("washed") & ~shock, "any": shock | F.col("washed")}
    positives = {k: F.col("label") == k for k in TYPES[:2]} | {"any": F.col("label") != "normal"}

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = [
        column
        for k in TYPES
        for column in (
            total(flags[k] & positives[k]).alias(f"tp_{k}"), total(flags[k]).alias(f"flag_{k}"), total(positives[k]).alias(f"pos_{k}"),
        )
    ]
    return points.groupBy(*by, *SETTING).agg(*sums, F.sum("n").alias("n_ticks"))


def scores(counts: DataFrame, kind: str) -> DataFrame:
    """The counts with precision, recall and f1 of one kind."""
    columns = prf_columns(f"tp_{kind}", f"flag_{kind}", f"pos_{kind}")
    return counts.withColumns({k: v for k, v in columns.items() if k != "flagged"})


def _best(rows: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """The row with the highest F1 of every group, the first in order on a tie."""
    first = Window.partitionBy(*by).orderBy(F.desc("f1"), *order)  # settings of a grid, not ticks
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def tune(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by and setting, shock_f1, wash_f1: for each group of ``setting_counts``
    the window and thresholds with the best price_shock F1, then the wash
    setting with the best wash_trade F1 given those shocks (which take
    precedence). The first in grid order wins a tie."""
    by = list(by)
    shock = _best(scores(counts.filter("wash = 0"), "price_shock"), by, "window", "z_pos", "vwap_pos")
    shock = shock.select(*by, "window", "z_pos", "vwap_pos", F.col("f1").alias("shock_f1"))
    keys = [*by, "window", "z_pos", "vwap_pos"]
    wash = _best(scores(counts.join(F.broadcast(cut_lineage(shock)), keys), "wash_trade"), by, "wash")
    return wash.select(*by, *SETTING, "shock_f1", F.col("f1").alias("wash_f1"))


def at_settings(counts: DataFrame, settings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, kind, tp, n_flag, n_pos, n_ticks, precision, recall and f1 of one
    setting per group, all kinds."""
    rows = counts.join(settings.select(*by, *SETTING), [*by, *SETTING])
    kinds = [
        F.struct(F.lit(k).alias("kind"), *[F.col(f"{c}_{k}").alias(a) for c, a in (("tp", "tp"), ("flag", "n_flag"), ("pos", "n_pos"))])
        for k in TYPES
    ]
    each = rows.select(*by, "n_ticks", F.explode(F.array(*kinds)).alias("k")).select(*by, "k.*", "n_ticks")
    columns = prf_columns("tp", "n_flag", "n_pos")
    return each.withColumns({k: v for k, v in columns.items() if k != "flagged"})


def named(settings: DataFrame, grid: Grid) -> DataFrame:
    """Settings with their values (window_size, min_samples, z, vwap,
    wash_ratio, wash_range) in place of grid positions."""

    def pick(values: Sequence, position: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(position).cast("int") + 1)

    values = {
        "window_size": pick([w for w, _ in grid.windows], "window"),
        "min_samples": pick([m for _, m in grid.windows], "window"),
        "z": pick(grid.z, "z_pos"),
        "vwap": pick(grid.vwap, "vwap_pos"),
        "wash_ratio": pick([r for r, _ in grid.wash], "wash"),
        "wash_range": pick([w for _, w in grid.wash], "wash"),
    }
    return settings.withColumns(values).drop(*SETTING)


def leave_one_out(own: DataFrame, grid: Grid, key: str = "ticker") -> DataFrame:
    """One row per value of ``key`` in ``own`` (``setting_counts`` by key): the
    setting tuned on all others, its F1 on the value's own ticks (shock_f1,
    wash_f1, any_f1), and what the value's own best setting reaches
    (own_shock_f1, own_wash_f1). What is held out is the totals minus its own."""
    own = cut_lineage(own)
    totals = own.groupBy(*SETTING).agg(*[F.sum(c).alias(f"_{c}") for c in (*COUNTS, "n_ticks")])
    differences = [(F.col(f"_{c}") - F.col(c)).alias(c) for c in (*COUNTS, "n_ticks")]
    rest = cut_lineage(own.join(totals, SETTING).select(key, *SETTING, *differences))
    tuned = cut_lineage(tune(rest, [key]).select(key, *SETTING))
    per_kind = at_settings(own, tuned, [key]).groupBy(key)
    held = per_kind.agg(*[F.max(F.when(F.col("kind") == k, F.col("f1"))).alias(f) for k, f in zip(TYPES, ("shock_f1", "wash_f1", "any_f1"))])
    best = tune(own, [key]).select(key, F.col("shock_f1").alias("own_shock_f1"), F.col("wash_f1").alias("own_wash_f1"))
    return named(tuned, grid).join(held, key).join(best, key)


def threshold_surface(counts: DataFrame, grid: Grid, by: Sequence[str] = ()) -> DataFrame:
    """by, window_size, min_samples, z, vwap and the price_shock counts and
    scores of every window and pair of thresholds."""
    rows = scores(counts.filter("wash = 0"), "price_shock")
    rows = rows.select(
        *by, *SETTING, F.col("tp_price_shock").alias("tp"), F.col("flag_price_shock").alias("n_flag"),
        F.col("pos_price_shock").alias("n_pos"), "n_ticks", "precision", "recall", "f1",
    )
    return named(rows, grid).drop("wash_ratio", "wash_range")

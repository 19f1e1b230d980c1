"""The exceedance cube against scored ticks and plain searches."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import cube as cb
from tapewatch.operators.detect import detect_batch
from tapewatch.params import DetectorParams
from tests.conftest import random_ticks

GRID = cb.Grid(
    windows=((10, 5), (20, 10), (7, 3)), z=(1.0, 2.0, 2.5, 3.0), vwap=(0.0002, 0.001), wash=((0.2, 0.002), (0.4, 0.01), (0.7, 0.0015))
)
BASE = DetectorParams()


@pytest.fixture(scope="module")
def labelled(spark):
    t = random_ticks(spark, 700, tickers=("A", "B", "C"), gap_every=250, shock=0.05)
    label = F.when(F.col("arrival") % 20 == 3, "price_shock").when(F.col("arrival") % 20 == 7, "wash_trade").otherwise("normal")
    period = F.when(F.col("arrival") < 500, "train").otherwise("test")
    return t.withColumns({"label": label, "period": period}).cache()


@pytest.fixture(scope="module")
def cube(labelled):
    return cb.exceedance_cube(labelled, GRID, BASE, by=["label", "period"]).cache()


@pytest.fixture(scope="module")
def scored(labelled):
    """Every tick with its scores of every window and wash setting."""
    sets = {f"w{i}": BASE.only().with_(window_size=w, min_samples=m) for i, (w, m) in enumerate(GRID.windows)}
    sets |= {f"v{i}": BASE.only("wash_rule").with_(wash_volume_ratio=r, wash_price_range=g) for i, (r, g) in enumerate(GRID.wash)}
    rows = detect_batch(labelled, sets, carry=["label", "period", "arrival"]).toPandas()
    return {k: g.set_index(["ticker", "arrival"]).sort_index() for k, g in rows.groupby("param_id")}


def flags(scored, w, v, i, j):
    rows = scored[f"w{w}"]
    shock = ((rows.zscore.abs() > GRID.z[i]) | (rows.vwap_divergence > GRID.vwap[j])).to_numpy()
    wash = (scored[f"v{v}"].anomaly_type == "wash_trade").to_numpy() & ~shock
    return shock, wash, rows


def f1(flag, pos):
    tp, n, m = (flag & pos).sum(), flag.sum(), pos.sum()
    p, r = (tp / n if n else 0.0), (tp / m if m else 0.0)
    return 2 * p * r / (p + r) if p + r else 0.0


def search(scored, mask):
    """Window, thresholds and wash setting by trying all of them on a mask."""
    rows = scored["w0"]
    lab, m = rows.label.to_numpy(), mask(rows)

    def shock_f1(k):
        return f1(flags(scored, k[0], 0, k[1], k[2])[0][m], (lab == "price_shock")[m])

    w, i, j = max(itertools.product(range(3), range(4), range(2)), key=shock_f1)
    v = max(range(3), key=lambda v: f1(flags(scored, w, v, i, j)[1][m], (lab == "wash_trade")[m]))
    return (w, v, i, j), shock_f1((w, i, j)), f1(flags(scored, w, v, i, j)[1][m], (lab == "wash_trade")[m])


def test_counts_of_every_setting(cube, scored):
    counts = cb.setting_counts(cube, GRID, ["ticker", "period"]).toPandas()
    assert len(counts) == 3 * 2 * 3 * 3 * 4 * 2
    for (t, period), own in counts.groupby(["ticker", "period"]):
        for r in own.itertuples():
            shock, wash, rows = flags(scored, r.window, r.wash, r.z_pos, r.vwap_pos)
            m = ((rows.index.get_level_values(0) == t) & (rows.period == period)).to_numpy()
            lab = rows.label.to_numpy()
            for kind, flag, pos in (("price_shock", shock, lab == "price_shock"), ("wash_trade", wash, lab == "wash_trade"), ("any", shock | wash, lab != "normal")):
                found = tuple(getattr(r, f"{c}_{kind}") for c in ("tp", "flag", "pos"))
                assert found == ((flag & pos & m).sum(), (flag & m).sum(), (pos & m).sum())
            assert r.n_ticks == m.sum()


def test_tuning_under_masks_is_a_plain_search(cube, scored):
    counts = cb.setting_counts(cube, GRID, ["period"])
    for r in cb.tune(counts, ["period"]).collect():
        setting, shock, wash = search(scored, lambda rows: (rows.period == r.period).to_numpy())
        assert (r.window, r.wash, r.z_pos, r.vwap_pos) == setting
        assert (r.shock_f1, r.wash_f1) == pytest.approx((shock, wash))
    whole = cb.tune(cb.setting_counts(cube, GRID)).collect()
    assert len(whole) == 1 and tuple(whole[0][c] for c in cb.SETTING) == search(scored, lambda rows: np.ones(len(rows), bool))[0]


def test_leave_one_out_is_a_plain_search(cube, scored):
    for r in cb.leave_one_out(cb.setting_counts(cube, GRID, ["ticker"]), GRID).collect():
        (w, v, i, j), _, _ = search(scored, lambda rows: rows.index.get_level_values(0) != r.ticker)
        assert (r.window_size, r.min_samples, r.z, r.vwap, r.wash_ratio, r.wash_range) == (*GRID.windows[w], GRID.z[i], GRID.vwap[j], *GRID.wash[v])
        _, own_shock, own_wash = search(scored, lambda rows: rows.index.get_level_values(0) == r.ticker)
        shock, wash, rows = flags(scored, w, v, i, j)
        m, lab = rows.index.get_level_values(0) == r.ticker, rows.label.to_numpy()
        held = f1(shock[m], (lab == "price_shock")[m]), f1(wash[m], (lab == "wash_trade")[m]), f1((shock | wash)[m], (lab != "normal")[m])
        assert (r.shock_f1, r.wash_f1, r.any_f1, r.own_shock_f1, r.own_wash_f1) == pytest.approx((*held, own_shock, own_wash))


def rows_of(df):
    return sorted(map(tuple, df.select("ticker", "label", "period", *[f.name for f in cb.CELL]).collect()), key=str)


@pytest.mark.parametrize("target, burn", [(150, 1), (90, 30), (300, 2000)])
def test_slices_count_like_one_pass(labelled, cube, target, burn):
    sliced = cb.exceedance_cube(labelled, GRID, BASE, by=["label", "period"], target_rows=target, burn_ticks=burn)
    assert rows_of(sliced) == rows_of(cube)


def test_cells_are_bounded_by_the_grid(spark, labelled):
    many = labelled.unionByName(random_ticks(spark, 4000, tickers=("A",), seed=5).withColumns({"label": F.lit(None).cast("string"), "period": F.lit("train")}))
    few = cb.exceedance_cube(many, GRID, BASE)
    per = few.groupBy("ticker", "label").count().toPandas()
    assert per["count"].max() <= 3 * 3 * 5 * 3 * 2 and per.label.isna().sum() == 1
    assert few.filter("window = 0 AND wash = 0").agg(F.sum("n")).first()[0] == many.count()
    assert cb.exceedance_cube(many.limit(0), GRID, BASE).count() == 0


def test_counts_ignore_warm_up_and_ties():
    levels = cb._levels(np.array([np.nan, 1.0, 1.0000001, 9.0, np.inf]), (1.0, 2.0))
    assert levels.tolist() == [0, 0, 1, 2, 2]
    cells = cb.count_cells([levels * 3], [np.array([True, False, False, False, True])], np.zeros(5, int), GRID)
    frame = pd.DataFrame(cells)
    assert frame.n.sum() == 5 and set(frame[frame.washed].z_level) == {0, 2}


def test_a_grid_is_ascending_and_not_empty():
    for wrong in ({"z": (3.0, 2.0)}, {"wash": ()}, {"vwap": (0.2, 0.1)}):
        with pytest.raises(ValueError):
            cb.Grid(**wrong)

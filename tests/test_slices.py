"""Sliced windows give what a whole-ticker window gives."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewatch.operators import quantiles, signals
from tapewatch.operators import ticks as tk
from tapewatch.operators.slices import GREATEST, LEAST, SUM, Slicing, plan_width, running_sum, trailing_ranges
from tapewatch.plans.surveillance import native_scores
from tests.conftest import random_ticks

def whole():
    return Window.partitionBy("ticker").orderBy("event_time_ms", "arrival")


# from a few ticks per slice to everything in one
WIDTHS = [4_000, 60_000, 10_000_000]


@pytest.fixture(scope="module")
def frame(spark):
    return random_ticks(spark, 400, gap_every=90).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select("ticker", "arrival", *columns).collect()))


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:2] == y[:2]
        for u, v in zip(x[2:], y[2:]):
            assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, rel=1e-9, abs=1e-9))


@pytest.mark.parametrize("width", WIDTHS)
def test_index(frame, width):
    s = Slicing(width_ms=width)
    got = tk.indexed(frame, 1_800_000, s)
    gap = F.col("event_time_ms") - F.lag("event_time_ms").over(whole())
    want = (
        frame.withColumn("gap_ms", gap)
        .withColumn("pos", F.row_number().over(whole()) - 1)
        .withColumn("session_id", F.sum(F.coalesce((F.col("gap_ms") > 1_800_000).cast("long"), F.lit(0))).over(whole()))
        .withColumn("ms_seq", F.row_number().over(Window.partitionBy("ticker", "event_time_ms").orderBy("arrival")) - 1)
    )
    same(rows(got, "gap_ms", "pos", "session_id", "ms_seq"), rows(want, "gap_ms", "pos", "session_id", "ms_seq"))
    same(rows(tk.with_session(frame, 1_800_000, s), "session_id"), rows(want, "session_id"))
    same(rows(tk.with_pos(frame, s), "pos"), rows(want, "pos"))


@pytest.mark.parametrize("width", WIDTHS)
def test_rolling_rows(frame, width):
    w = whole().rowsBetween(-20, -1)
    n, m, sd = F.count("price").over(w), F.avg("price").over(w), F.stddev_pop("price").over(w)
    want = frame.withColumn("zscore", F.when(n >= 10, F.when(sd > 1e-9, (F.col("price") - m) / sd).otherwise(0.0)))
    got = signals.rolling_z(frame, 20, 10, Slicing(width_ms=width))
    same(rows(got, "zscore"), rows(want, "zscore"))


@pytest.mark.parametrize("width", WIDTHS)
def test_trailing_time(frame, width):
    s = Slicing(width_ms=width)
    w = Window.partitionBy("ticker").orderBy("event_time_ms").rangeBetween(-20_000, -1)
    want = frame.withColumn("prior_ticks", F.count("price").over(w)).withColumn("prior_volume", F.sum("volume").over(w))
    got = signals.wash_lookback(frame, 20_000, s=s)
    same(rows(got, "prior_ticks", "prior_volume"), rows(want, "prior_ticks", "prior_volume"))
    edge = F.max(F.col("event_time_ms") - F.col("volume").cast("long") * 100).over(whole())
    got = signals.adaptive_cutoff(frame, F.col("volume").cast("long") * 100, s)
    same(rows(got, "cutoff_ms"), rows(frame.withColumn("cutoff_ms", edge), "cutoff_ms"))


@pytest.mark.parametrize("width, span", [(2_000, 20_000), (1_999, 20_000), (7_000, 20_000), (20_000, 20_000), (50_000, 20_000), (500, 61_234)])
def test_ranges_over_narrow_slices(frame, width, span):
    s = Slicing(width_ms=width)
    w = Window.partitionBy("ticker").orderBy("event_time_ms").rangeBetween(-span, -1)
    wanted = {"low": (LEAST, F.col("price")), "high": (GREATEST, F.col("price")), "total": (SUM, F.col("volume"))}
    plain = {"low": F.min("price"), "high": F.max("price"), "total": F.sum("volume")}
    got = trailing_ranges(frame, span, wanted, s)
    same(rows(got, *wanted), rows(frame.withColumns({k: c.over(w) for k, c in plain.items()}), *wanted))


def test_look_backs_do_not_depend_on_the_slices(frame):
    narrow, wide = Slicing(width_ms=1_900), Slicing(width_ms=10_000_000)
    for look, columns in (
        (lambda s: signals.wash_lookback(frame, 20_000, price_range=0.01, s=s), ("prior_low", "prior_high", "prior_ticks", "prior_volume", "flat_market", "wash_ratio")),
        (lambda s: signals.trailing_time_stats(frame, 20_000, s=s), ("trail_mean", "trail_std", "zscore", "vwap_divergence")),
        (lambda s: native_scores(frame, lookback_ms=20_000, price_range=0.01, s=s), ("zscore", "vwap_divergence", "wash_ratio", "risk_score", "pos")),
    ):
        a, b = rows(look(narrow), *columns), rows(look(wide), *columns)
        assert [x[:2] for x in a] == [x[:2] for x in b]
        for u, v in ((u, v) for x, y in zip(a, b) for u, v in zip(x[2:], y[2:])):
            assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, rel=1e-6, abs=1e-7))


def test_a_row_is_in_two_slices_at_most(frame, monkeypatch):
    seen = []
    plain = type(frame).unionByName

    def spied(a, b, **kw):
        out = plain(a, b, **kw)
        seen.append(out.count())
        return out

    monkeypatch.setattr(type(frame), "unionByName", spied)
    trailing_ranges(frame, 60_000, {"n": (SUM, F.lit(1))}, Slicing(width_ms=1_000)).count()
    assert seen == [2 * frame.count()]  # each tick once as itself and once as a question


@pytest.mark.parametrize("width", WIDTHS)
def test_running_sum(frame, width):
    s = Slicing(width_ms=width)
    w = whole().rowsBetween(Window.unboundedPreceding, 0)
    got = running_sum(s.assign(frame), s, total="volume")
    same(rows(got, "total"), rows(frame.withColumn("total", F.sum("volume").over(w)), "total"))


@pytest.mark.parametrize("width", WIDTHS)
def test_incidents(frame, width):
    s = Slicing(width_ms=width)
    t = tk.indexed(frame, 1_800_000, s).withColumn("is_anomaly", F.pmod(F.hash("arrival", "ticker"), F.lit(9)) == 0)
    got = {(r["ticker"], r["pos"]): r["incident_id"] for r in signals.with_incident(t, 10, s=s).collect()}
    want, last = {}, {}
    for r in sorted(t.filter("is_anomaly").collect(), key=lambda r: (r["ticker"], r["pos"])):
        k = r["ticker"]
        open_id = last.get(k)
        if open_id is None or r["pos"] - open_id[0] - 1 > 10 or r["session_id"] != open_id[1]:
            name = f"{k}-{r['event_time_ms']}"
        else:
            name = open_id[2]
        last[k] = (r["pos"], r["session_id"], name)
        want[(k, r["pos"])] = name
    assert got == want


@pytest.mark.parametrize("accuracy", [200, 20])
def test_percentiles_are_exact(spark, monkeypatch, accuracy):
    # a coarse grid takes more rounds to the same result
    monkeypatch.setattr(quantiles, "GRID", accuracy)
    rng = np.random.default_rng(1)
    data = {"a": np.concatenate([np.full(4000, 7.0), rng.exponential(10, 1500)]), "b": rng.normal(0, 1, 37), "c": np.array([3.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    ps = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    for r in quantiles.exact_percentiles(df, "v", ps, ["k"]).collect():
        np.testing.assert_allclose([r[n] for n in ps], np.percentile(data[r["k"]], [100 * p for p in ps.values()]))
        assert r["n"] == len(data[r["k"]])
    every = np.concatenate(list(data.values()))
    r = quantiles.exact_percentiles(df, "v", ps).first()
    np.testing.assert_allclose([r[n] for n in ps], np.percentile(every, [100 * p for p in ps.values()]))


@pytest.mark.parametrize("bucket", [100, 1 << 15])
def test_smallest_k(spark, monkeypatch, bucket):
    monkeypatch.setattr(quantiles, "BUCKET", bucket)
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("h"))
    want = df.withColumn("n", F.lit(40) + F.col("k"))
    got = quantiles.smallest_k(want, "h", "n", ["k"]).collect()
    by = {}
    for r in want.collect():
        by.setdefault(r["k"], []).append(r["h"])
    for k, hs in by.items():
        assert sorted(r["h"] for r in got if r["k"] == k) == sorted(hs)[: 40 + k]


def test_plan_width(frame):
    width = plan_width(frame, Slicing(), target_rows=50)
    counts = Slicing(width_ms=width).assign(frame).groupBy("ticker", "slice_id").count().agg(F.avg("count")).first()[0]
    assert 1 <= counts <= 100


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_pair_enumeration_and_no_whole_ticker_window(frame):
    s = Slicing(width_ms=60_000)
    for df in (
        tk.indexed(frame, 1_800_000, s),
        signals.rolling_baseline(frame, s=s),
        signals.wash_lookback(frame, s=s),
        tk.with_side(frame, "global", s),
        tk.replay_schedule(frame, scope="global", s=s),
    ):
        plan = _nodes(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        # windows that do not partition by slice run over slice summaries only
        for line in plan.splitlines():
            if "Window [" in line and "event_time_ms" in line.split("]")[-2]:
                assert "slice_id" in line


def test_no_look_back_slides_over_ticks(frame):
    """A frame that slides adds all of its rows up again for every tick."""
    s = Slicing(width_ms=10_000_000)
    looks = [
        signals.wash_lookback(frame, 61_234, s=s),
        signals.trailing_time_stats(frame, 61_234, s=s),
        native_scores(frame, lookback_ms=61_234, s=s),
        signals.wash_lookback(frame, 61_234, s=s.by(width_ms=10_000)),
    ]
    for look in looks:
        plan = look._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, -61234" not in plan and "RangeFrame, unbounded" in plan

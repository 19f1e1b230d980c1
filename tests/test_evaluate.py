"""Event, incident and tuning scores, and the injected data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import bars, evaluate, inject, tuning
from tapewatch.operators import ticks as tk
from tapewatch.operators.quality import LOG, order_report, partition_consistency, with_order_violation
from tapewatch.operators.slices import Slicing
from tapewatch.params import DetectorParams
from tapewatch.plans.evaluation import evaluation_report
from tests.conftest import START, make_ticks, random_ticks, tick_frame

S = Slicing(width_ms=60_000)


def labelled(spark, n=60, **marks):
    t = tick_frame(spark, make_ticks([(100, 10)] * n), "A")
    label = F.lit("normal")
    for kind, at in marks.items():
        label = F.when(F.col("arrival").isin(at), kind).otherwise(label)
    return tk.indexed(t.withColumn("label", label), 600_000, S)


def test_later_event_wins_and_tp_fp(spark):
    t = labelled(spark, price_shock=[10, 12], wash_trade=[14, 40])
    cover = {r["pos"]: (r["event_pos"], r["event_kind"]) for r in evaluate.cover_events(evaluate.labelled_events(t)).collect()}
    assert cover[11] == (10, "price_shock") and cover[13] == (12, "price_shock") and cover[14] == (14, "wash_trade")
    assert cover[16] == (14, "wash_trade") and cover[48] == (40, "wash_trade") and 49 not in cover
    flags = spark.createDataFrame(
        [("A", START + 11_000, "price_shock", "A-1"), ("A", START + 15_000, "price_shock", "A-1"),
         ("A", START + 41_000, "wash_trade", "A-2"), ("A", START + 58_000, "wash_trade", "A-3"), ("A", 5, "wash_trade", "A-9")],
        "ticker string, event_time_ms long, anomaly_type string, incident_id string",
    )
    assert evaluate.unmatched_flags(evaluate.locate_flags(t, flags)).first()[0] == 1
    got = {r["kind"]: r for r in evaluate.score_against_labels(t, flags).collect()}
    assert (got["any"]["flags"], got["any"]["events"], got["any"]["events_found"], got["any"]["true_incidents"]) == (4, 4, 3, 2)
    assert got["price_shock"]["event_precision"] == 0.5 and got["price_shock"]["event_recall"] == 0.5
    assert got["wash_trade"]["event_precision"] == 0.5 and got["wash_trade"]["incident_precision"] == 0.5
    assert got["any"]["tick_precision"] == 0.0 and got["any"]["tick_f1"] is None


def test_flags_named_by_position_meet_one_tick_of_a_millisecond(spark):
    t = labelled(spark, price_shock=[11]).withColumn("event_time_ms", F.lit(START))
    flags = spark.createDataFrame(
        [("A", START, 10, "price_shock", "A-1"), ("A", START, 11, "price_shock", "A-1"), ("A", START, 99, "price_shock", "A-1")],
        "ticker string, event_time_ms long, pos long, anomaly_type string, incident_id string",
    )
    assert evaluate.unmatched_flags(evaluate.locate_flags(t, flags)).first()[0] == 1
    got = {r["kind"]: r for r in evaluate.score_against_labels(t, flags).collect()}
    assert got["any"]["flags"] == 2 and got["any"]["tick_precision"] == 0.5


def test_flags_in_another_kind_are_ignored(spark):
    t = labelled(spark, price_shock=[10], wash_trade=[30])
    flags = spark.createDataFrame(
        [("A", 11, "price_shock"), ("A", 31, "price_shock"), ("A", 50, "price_shock"), ("A", 12, "wash_trade")],
        "ticker string, pos long, family string",
    )
    got = {r["kind"]: r for r in evaluate.event_metrics(flags, evaluate.original_spans(t)).collect()}
    assert got["price_shock"]["precision"] == 0.5 and got["price_shock"]["detected"] == 1
    assert got["wash_trade"]["precision"] == 0.0 and got["wash_trade"]["detected"] == 0 and got["wash_trade"]["f1"] == 0.0


def test_spans_end_with_the_session(spark):
    ms, p, v = make_ticks([(100, 10)] * 30)
    ms[12:] += 3_600_000
    t = tick_frame(spark, (ms, p, v), "A").withColumn("label", F.when(F.col("arrival") == 10, "wash_trade").otherwise("normal"))
    r = evaluate.original_spans(tk.indexed(t, 600_000, S)).first()
    assert (r["start_pos"], r["end_pos"]) == (10, 12)
    hours = evaluate.trading_hours(t, 600_000, S).first()["hours"]
    assert hours == pytest.approx((11 + 17) * 1000 / 3_600_000)


def test_order_checks(spark):
    log = spark.createDataFrame(
        [(0, 0, "A", 10), (0, 1, "A", 9), (0, 2, "B", 11), (1, 0, "B", 5), (1, 1, "B", 5)],
        "partition int, offset long, key string, event_time_ms long",
    )
    s = LOG.by(width_ms=2)
    assert [r["offset"] for r in with_order_violation(log, s).filter("violation").collect()] == [1]
    got = {r["partition"]: (r["keys"], r["messages"], r["newest_ms"], r["violations"]) for r in order_report(log, s).collect()}
    assert got == {0: (2, 3, 11, 1), 1: (1, 2, 5, 0)}
    assert [r["key"] for r in partition_consistency(log).collect()] == ["B"]


def test_nearest_bar_ties_go_to_the_earlier(spark):
    b = spark.createDataFrame([("A", m) for m in (0, 30_000, 90_000)], "ticker string, bar_ms long")
    a = spark.createDataFrame([("A", m) for m in (0, 14_999, 15_000, 15_999, 16_000, 60_000, 61_000, 500_000)], "ticker string, event_time_ms long")
    for width in (10_000, 40_000, 10**9):
        got = {r["event_time_ms"]: r["bar_ms"] for r in bars.nearest_bar(a, b, Slicing(width_ms=width)).collect()}
        assert got == {0: 0, 14_999: 0, 15_000: 0, 15_999: 0, 16_000: 30_000, 60_000: 30_000, 61_000: 90_000, 500_000: 90_000}


def test_bar_reader_and_csv_reader_minimum(spark):
    t = tick_frame(spark, make_ticks([(100 + i % 3, 10) for i in range(8)], step=30_000), "A")
    b = bars.ohlc_bars(t)
    two = [r["zscore"] for r in bars.bar_zscore(b, min_n=2).orderBy("bar_ms").collect()]
    five = [r["zscore"] for r in bars.bar_zscore(b, min_n=5).orderBy("bar_ms").collect()]
    assert two[0] == 0 and two[1] != 0 and five[:4] == [0.0] * 4 and five[4:] == two[4:]


@pytest.fixture(scope="module")
def quoted(spark):
    t = random_ticks(spark, 3000, gap_every=1000, shock=0.0)
    return t.withColumn("bid", F.col("price") - 0.01).withColumn("ask", F.col("price") + 0.01).cache()


def test_injected_anomalies(quoted):
    out = inject.inject_anomalies(quoted, 0.02, 42, S).cache()
    assert out.count() == quoted.count()
    again = inject.inject_anomalies(quoted.repartition(7), 0.02, 42, Slicing(width_ms=10_000_000))
    assert out.select(sorted(out.columns)).exceptAll(again.select(sorted(out.columns))).count() == 0
    both = out.select("ticker", "arrival", "label", "price", "volume", "bid", "ask", "pos", "session_id").join(
        quoted.select("ticker", "arrival", F.col("price").alias("p0"), F.col("volume").alias("v0")), ["ticker", "arrival"])
    pdf = both.toPandas().sort_values(["ticker", "pos"]).reset_index(drop=True)
    counts = pdf.label.value_counts()
    assert counts["price_shock"] > 20 and counts["wash_trade"] > 20
    np.testing.assert_allclose(pdf.ask - pdf.bid, 0.02, atol=1e-9)
    touched = np.zeros(len(pdf), bool)
    for i in pdf.index[pdf.label != "normal"]:
        r = pdf.loc[i]
        n = 5 if r.label == "price_shock" else 9
        block = pdf.loc[i : i + n - 1]
        block = block[(block.ticker == r.ticker) & (block.session_id == r.session_id)]
        sigma = max(np.std(np.diff(pdf[(pdf.ticker == r.ticker) & (pdf.session_id == r.session_id)].p0)), 1e-4)
        if r.label == "price_shock":
            moved = (block.price - block.p0).to_numpy()
            assert 4 * sigma - 1e-9 <= abs(moved[0]) <= 8 * sigma + 1e-9
            np.testing.assert_allclose(moved, moved[0] * (1 - np.arange(len(moved)) / len(moved)), atol=1e-9)
        else:
            ratio = (block.volume / block.v0).to_numpy()
            live = ratio[: max(4, int((ratio > 5.9).sum()))]
            assert (ratio[: min(4, len(ratio))] >= 6 - 1e-9).all() and (live <= 15 + 1e-9).all()
            assert abs(r.price - r.p0) < sigma
        assert not touched[i]
        touched[block.index[: 5 if r.label == "price_shock" else 4]] = True
    same = ~touched & (pdf.label == "normal")
    assert (pdf.price[same] == pdf.p0[same]).mean() > 0.95
    often = inject.inject_anomalies(quoted, 0.5, 7, S)
    assert often.filter("label <> 'normal'").count() > len(starts_of(out))
    with pytest.raises(ValueError):
        inject.inject_anomalies(quoted, 1.5)


@pytest.mark.parametrize("spread", [16, 1 << 13])
@pytest.mark.parametrize("rate", [1.0, 0.4])
def test_dense_candidates_are_chosen_one_by_one(spark, monkeypatch, spread, rate):
    monkeypatch.setattr(inject, "SPREAD", spread)
    rng = np.random.default_rng(3)
    at = {t: np.flatnonzero(rng.random(900) < rate) for t in "AB"}
    rows = [(t, int(p), int(rng.integers(1, 10)), float(p)) for t in "AB" for p in at[t]]
    fixed = [("C", p, 5, 0.0) for p in range(300)]  # chains of one length never meet
    candidates = spark.createDataFrame(rows + fixed, "ticker string, pos long, length int, anchor double").repartition(5)
    got = sorted((r.ticker, r.pos, r.length) for r in inject._spread_out(candidates, 9).collect())
    want, free = [], {}
    for t, p, n, _ in sorted(rows + fixed):
        if p >= free.get(t, 0):
            want.append((t, p, n))
            free[t] = p + n
    assert got == want


def test_every_tick_may_start_an_event(quoted):
    out = inject.inject_anomalies(quoted, 1.0, 5, S).toPandas().sort_values(["ticker", "pos"])
    for _, own in out.groupby(["ticker", "session_id"]):
        at = own.pos[own.label != "normal"].to_numpy()
        assert at[0] == own.pos.min() and 4 <= np.diff(at).min() and np.diff(at).max() <= 9


def test_long_stretches_lose_no_place(spark, monkeypatch):
    monkeypatch.setattr(inject, "SLOTS", 3)
    stretches = spark.createDataFrame([("A", 5, 1000), ("A", 2000, 2010), ("B", 0, 70)], "ticker string, a long, b long")
    slots = F.floor((F.col("b") - F.col("a")) / 10)
    got = sorted((r.ticker, r.a, r._slot) for r in inject._slots(stretches, slots).collect())
    assert got == sorted([("A", 5, i) for i in range(99)] + [("A", 2000, 0)] + [("B", 0, i) for i in range(7)])


def starts_of(out):
    return out.filter("label <> 'normal'").collect()


def test_short_sessions_stay_untouched(spark):
    t = tick_frame(spark, make_ticks([(100, 10)] * 19), "A").withColumn("bid", F.lit(99.0)).withColumn("ask", F.lit(101.0))
    assert inject.inject_anomalies(t, 0.1, 1, S).filter("label <> 'normal'").count() == 0


@pytest.mark.parametrize("variant", [*inject.EXISTING_VARIANTS, *inject.HELDOUT_VARIANTS], ids=lambda v: v.kind)
def test_injected_variants(quoted, variant):
    label = F.when(F.col("arrival") % 300 == 150, "price_shock").when(F.col("arrival") % 300 == 299, "wash_trade").otherwise("normal")
    t = quoted.withColumn("label", label)
    data, spans = inject.inject_variant(t, variant, 7, S)
    assert data.count() == t.count()
    places = spans.toPandas()
    marks = data.filter("label <> 'normal'").select("ticker", "pos").toPandas()
    sessions = data.select("ticker", "pos", "session_id").toPandas().set_index(["ticker", "pos"]).session_id
    tail = 5 if variant.family == "price_shock" else 0
    for ticker, own in places.groupby("ticker"):
        assert len(own) == 10  # as many as original events of the family
        own = own.sort_values("start_pos")
        length = own.end_pos - own.start_pos
        assert length.between(variant.length[0] + tail, variant.length[1] + tail).all()
        assert (own.start_pos.to_numpy()[1:] - own.end_pos.to_numpy()[:-1] >= 40).all()
        at = marks.pos[marks.ticker == ticker].to_numpy()
        for a, b in zip(own.start_pos, own.end_pos):
            assert ((at + 40 <= a) | (at - 40 >= b)).all()
            assert sessions[ticker, a] == sessions[ticker, b - 1]
    joined = data.select("ticker", "arrival", "pos", "price", "volume").join(
        t.select("ticker", "arrival", F.col("price").alias("p0"), F.col("volume").alias("v0")), ["ticker", "arrival"]).toPandas()
    inside = np.zeros(len(joined), bool)
    for r in places.itertuples():
        inside |= ((joined.ticker == r.ticker) & joined.pos.between(r.start_pos, r.end_pos - 1)).to_numpy()
    assert (joined.price[~inside] == joined.p0[~inside]).all() and (joined.volume[~inside] == joined.v0[~inside]).all()
    if variant.volume:
        ratio = (joined.volume / joined.v0)[inside]
        assert ratio.between(variant.volume[0] - 1e-9, variant.volume[1] + 1e-9).all()
    else:
        assert (joined.price[inside] != joined.p0[inside]).mean() > 0.9


def test_sweep_first_in_grid_order_wins(spark):
    rows = spark.createDataFrame([(float(i), i >= 5, "a" if i % 2 else "b") for i in range(10)], "s double, y boolean, ticker string")
    grid = [1.0, 4.0, 4.5, 8.0]
    got = tuning.with_prf(tuning.sweep(rows, "s", "y", grid)).orderBy("grid_pos").collect()
    assert [(r["tp"], r["n_flag"], r["n_pos"]) for r in got] == [(5, 8, 5), (5, 5, 5), (5, 5, 5), (1, 1, 5)]
    assert tuning.best(tuning.with_prf(tuning.sweep(rows, "s", "y", grid))).first()["threshold"] == 4.0
    empty = tuning.with_prf(tuning.sweep(rows, "s", F.lit(False), grid)).first()
    assert empty["precision"] == 0 and empty["recall"] == 0 and empty["f1"] == 0
    loo = {r["ticker"]: r for r in tuning.leave_one_out(tuning.sweep(rows, "s", "y", grid, ["ticker"])).collect()}
    assert set(loo) == {"a", "b"} and loo["a"]["held_out_f1"] == 1.0


def test_evaluation_report(quoted):
    label = F.when(F.col("arrival") % 300 == 150, "price_shock").when(F.col("arrival") % 300 == 299, "wash_trade").otherwise("normal")
    report = evaluation_report(quoted.withColumn("label", label), DetectorParams(), inject.EXISTING_VARIANTS[:1], s=S)
    got = {(r["dataset"], r["source"], r["kind"]): r for r in report.collect()}
    assert set(got) == {
        ("original", "detector", "price_shock"), ("original", "detector", "wash_trade"), ("original", "incidents", "any"),
        ("original", "naive", "price_shock"), ("original", "naive", "wash_trade"),
        ("shock_ramp", "detector", "shock_ramp"), ("shock_ramp", "incidents", "any"), ("shock_ramp", "naive", "shock_ramp"),
    }
    assert got["shock_ramp", "detector", "shock_ramp"]["events"] == 20
    assert all(0 <= r["precision"] <= 1 and 0 <= r["recall"] <= 1 for r in got.values())


def broadcast_joins(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_spelled_out_positions_are_not_broadcast(spark, tmp_path):
    """A table of spans is small to Spark, and so are all the positions in them."""
    spark.range(1000).selectExpr("'A' AS ticker", "id * 9 AS start_pos", "id * 9 + 9 AS end_pos", "'wash_trade' AS kind").write.parquet(str(tmp_path / "s"))
    spark.range(9000).selectExpr("'A' AS ticker", "id AS pos", "'wash_trade' AS family", "'A-1' AS incident_id").write.parquet(str(tmp_path / "f"))
    spans, flags = (spark.read.parquet(str(tmp_path / n)) for n in "sf")
    cover = evaluate.cover_events(spans)
    assert broadcast_joins(flags.join(cover, ["ticker", "pos"], "left")) == 0
    assert broadcast_joins(evaluate.caught_events(flags, spans)) == 0
    assert broadcast_joins(evaluate.incident_rows(flags, spans)) == 0
    (got,) = evaluate.event_metrics(flags, spans).collect()
    assert (got["events"], got["detected"], got["precision"]) == (1000, 1000, 1.0)


def test_changed_ticks_are_not_broadcast(spark):
    t = labelled(spark, 300, price_shock=[150], wash_trade=[200]).select("ticker", "event_time_ms", "price", "volume", "arrival", "label")
    variant, _ = inject.inject_variant(t, inject.EXISTING_VARIANTS[0], 7, S)
    quoted = t.withColumns({"bid": F.col("price"), "ask": F.col("price")})
    for df in (variant, inject.inject_anomalies(quoted, 0.5, 7, S)):
        joins = [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join " in x and "LeftOuter" in x]
        assert joins and not any("BroadcastHashJoin" in x for x in joins)

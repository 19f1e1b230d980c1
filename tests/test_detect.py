"""Batch and streaming detector: one result however the ticks are cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.operators import detect
from tapewatch.operators import ticks as tk
from tapewatch.operators.diff import diff_frames
from tapewatch.params import DetectorParams
from tapewatch.schemas import ANOMALIES, EXACT_FIELDS, FLOAT_FIELDS, RAW_EVENTS, SCORED, TICK
from tapewatch.sources.files import stream_ticks_from_files
from tapewatch.sources.tables import read_table
from tapewatch.streaming.detect import SCORED_WITH_LATE, TickScorer, checkpoint_path, detect_stream
from tapewatch.streaming.progress import progress_summary
from tapewatch.streaming.sinks import build_sink, start_sink
from tests.conftest import START, random_ticks

PARAMS = DetectorParams(z_threshold=4.0, ewma_threshold=3.0)


def assert_same(a, b):
    key = ["ticker", "tick_id"]
    summary, examples = diff_frames(a, b, key, FLOAT_FIELDS, [f for f in EXACT_FIELDS if f != "tick_id"] + ["timestamp"])
    found = {r["check"]: r["n"] for r in summary.collect()}
    matched = found.pop("matched")
    assert matched > 0 and not any(found.values()), (found, examples.take(5))


@pytest.fixture(scope="module")
def ticks(spark):
    return random_ticks(spark, 1500, gap_every=600).cache()


@pytest.fixture(scope="module")
def whole(spark, ticks):
    return detect.detect_batch(ticks, PARAMS).cache()


def test_one_pass_scores_every_tick(ticks, whole):
    assert whole.schema.fieldNames() == SCORED.fieldNames()
    assert whole.count() == ticks.count() and whole.filter("is_anomaly").count() > 20
    assert set(t for (t,) in whole.select("signals").filter("signals is not null").distinct().collect())


@pytest.mark.parametrize("target, burn", [(200, 1), (100, 40), (400, 5000)])
def test_slices_agree_with_one_pass(ticks, whole, target, burn):
    assert_same(whole, detect.detect_batch(ticks, PARAMS, target_rows=target, burn_ticks=burn))


def test_hot_ticker_is_spread_and_slow_one_is_not(spark):
    hot = random_ticks(spark, 900, tickers=("HOT",))
    slow = random_ticks(spark, 90, tickers=("SLOW",), seed=3, step=15_000)
    both = hot.unionByName(slow)
    plan = {r["ticker"]: r["_final"] + 1 for r in detect.slice_plan(both, 100, 50).collect()}
    assert plan == {"HOT": 9, "SLOW": 1}
    assert_same(detect.detect_batch(both, PARAMS), detect.detect_batch(both, PARAMS, target_rows=100, burn_ticks=20))


def test_several_parameter_sets_in_one_read(ticks, whole):
    sets = {"base": PARAMS, "z": PARAMS.only("zscore")}
    scored = detect.detect_batch(ticks, sets, target_rows=300, burn_ticks=50)
    assert_same(whole, scored.filter("param_id = 'base'").drop("param_id"))
    only = scored.filter("param_id = 'z' and is_anomaly").select("signals").distinct().collect()
    assert [r["signals"] for r in only] == ["zscore"]


def test_labels_are_attached_by_id(ticks, whole):
    labelled = tk.with_tick_id(ticks).withColumn("label", F.when(F.col("arrival") % 50 == 0, "price_shock").otherwise("normal"))
    joined = detect.attach_labels(whole, labelled, "label")
    assert joined.count() == whole.count() and joined.filter("label is null").count() == 0


def test_detector_never_sees_the_label(ticks):
    assert "label" not in tk.detector_input(ticks.withColumn("label", F.lit("x"))).columns
    assert "label" not in detect.INPUT


def write_batches(df, path, n):
    """The ticks in time order as n files with increasing modification time."""
    pdf = df.orderBy("event_time_ms", "arrival").toPandas()
    pdf["bid"] = pdf["ask"] = None
    size = -(-len(pdf) // n)
    spark = df.sparkSession
    for i in range(n):
        part = pdf.iloc[i * size : (i + 1) * size]
        rows = [(r.ticker, int(r.event_time_ms), float(r.price), float(r.volume), None, None, "price_shock") for r in part.itertuples()]
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(str(path))


def run_stream(spark, source, base, params=PARAMS, **kw):
    scored = detect_stream(stream_ticks_from_files(spark, str(source)), params, **kw)
    sink = build_sink(scored, f"{base}/ck", "detector", raw_path=f"{base}/raw", anomalies_path=f"{base}/bad")
    query = start_sink(sink, available_now=True)
    query.awaitTermination()
    return query


def stored_matches(spark, base, whole):
    raw = read_table(spark, f"{base}/raw", RAW_EVENTS)
    bad = read_table(spark, f"{base}/bad", ANOMALIES)
    assert raw.count() == whole.count() == raw.select("tick_id").distinct().count()
    assert_same(whole.filter("is_anomaly"), bad.withColumnRenamed("event_time", "timestamp"))


# ticks of one millisecond keep file order, which the batch side knows as arrival
@pytest.fixture(scope="module")
def stream_ticks(spark):
    return random_ticks(spark, 700, gap_every=300, same_ms=0.0, seed=8).cache()


@pytest.fixture(scope="module")
def stream_whole(spark, stream_ticks):
    return detect.detect_batch(stream_ticks, PARAMS).cache()


@pytest.mark.parametrize("batches, arrow", [(1, 50), (3, 10_000), (7, 10_000)])
def test_stream_equals_batch(spark, stream_ticks, stream_whole, tmp_path, batches, arrow):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        write_batches(stream_ticks, tmp_path / "in", batches)
        query = run_stream(spark, tmp_path / "in", tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    summary = progress_summary(query)
    assert summary["batches"] == batches and summary["rows_dropped_by_watermark"] == 0
    stored_matches(spark, tmp_path, stream_whole)


def test_restart_continues_from_the_checkpoint(spark, stream_ticks, stream_whole, tmp_path):
    first = stream_ticks.filter(F.col("arrival") < 333)
    write_batches(first, tmp_path / "in", 2)
    run_stream(spark, tmp_path / "in", tmp_path)
    write_batches(stream_ticks.filter(F.col("arrival") >= 333), tmp_path / "in", 1)
    run_stream(spark, tmp_path / "in", tmp_path)
    stored_matches(spark, tmp_path, stream_whole)


def test_late_ticks_watermark_and_scorer(spark, tmp_path):
    """Beyond the watermark Spark drops the row; within it the scorer does."""
    start = 1_700_000_000_000

    def file(ms):
        rows = [("A", start + m, 100.0, 10.0, None, None, None) for m in ms]
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    file([0, 1000, 600_000])
    file([601_000])
    file([590_000, 1000, 602_000])  # 10 s late: scorer; 10 min late: watermark
    scored = detect_stream(stream_ticks_from_files(spark, str(tmp_path / "in")), PARAMS, with_late=True)
    assert scored.schema.fieldNames() == SCORED_WITH_LATE.fieldNames()
    q = scored.writeStream.outputMode("update").format("memory").queryName("late_test").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("late_test")
    assert out.count() == 5 and out.agg(F.max("late_dropped")).first()[0] == 1
    assert progress_summary(q)["rows_dropped_by_watermark"] == 1


def test_checkpoint_path_names_the_layout():
    from tapewatch.schemas import STATE_LAYOUT_VERSION

    assert checkpoint_path("/data/ck/", "detector") == f"/data/ck/state-v{STATE_LAYOUT_VERSION}/detector"


def test_slices_are_no_narrower_than_the_look_back_and_settle_in_few_rounds(spark, monkeypatch):
    dense = random_ticks(spark, 3_000, tickers=("A",), step=20, seed=9)  # 60 s in all
    params = PARAMS.with_(wash_lookback_ms=5_000, wash_lookback_ticks=0.0)
    wide = detect.slice_plan(dense, 30, 5, params.wash_lookback_ms).first()
    assert wide["_width"] >= params.wash_lookback_ms and wide["_burn"] > params.wash_lookback_ms
    written, plain = [], detect.cut_lineage
    monkeypatch.setattr(detect, "cut_lineage", lambda df: written.append(1) or plain(df))
    got = detect.detect_batch(dense, params.with_(wash_lookback_ms=1), target_rows=50, burn_ticks=5)
    assert_same(detect.detect_batch(dense, params.with_(wash_lookback_ms=1)), got)
    assert len(written) < 2 + 2 * 10 + 2  # two tables a round; 60 slices that replay five ticks took a round each


class Kept:
    """The value state of one key."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def scored_by_stream(frames, with_late=False):
    scorer, state = TickScorer(PARAMS, with_late), Kept()
    scorer.init(state)
    return [list(scorer.handleInputRows(("A",), iter(parts), None)) for parts in frames], state.value


def test_a_dense_ticker_is_scored_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    n, late = 1_000, 150
    ms = START + np.cumsum(rng.integers(0, 2_000, n))
    pdf = pd.DataFrame({"ticker": "A", "event_time_ms": ms, "price": 100 + rng.normal(0, 0.1, n), "volume": rng.integers(1, 90, n) * 1.0})
    pdf["arrival"] = np.arange(n)
    again = pdf.head(late)  # all before the last tick
    batches = [[pdf.sample(frac=1, random_state=1).iloc[:400], pdf.sample(frac=1, random_state=1).iloc[400:]]]
    batches.append([again, pdf.assign(event_time_ms=ms + ms[-1] - START + 1, arrival=pdf["arrival"] + n)])
    whole, end = scored_by_stream(batches, True)
    monkeypatch.setattr("tapewatch.streaming.detect.SLICE_ROWS", 100)
    pieces, end_of_pieces = scored_by_stream(batches, True)
    assert max(len(f) for parts in pieces for f in parts) <= 100 < max(len(f) for parts in whole for f in parts)
    for a, b in zip(whole, pieces):
        pd.testing.assert_frame_equal(pd.concat(a, ignore_index=True), pd.concat(b, ignore_index=True))
    assert end == end_of_pieces and (pieces[1][0]["late_dropped"] > 0).all()


def test_flags_alone_leave_the_scorer(ticks, whole):
    flags = detect.detect_batch(ticks, PARAMS, target_rows=200, burn_ticks=1, flags_only=True)
    assert flags.filter("NOT is_anomaly").isEmpty()
    assert_same(whole.filter("is_anomaly"), flags)


def test_states_are_not_broadcast(spark, ticks, monkeypatch):
    plans, write = [], detect.cut_lineage

    def seen(df):
        if "_from" in df.columns:
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df)

    monkeypatch.setattr(detect, "cut_lineage", seen)
    detect.detect_batch(ticks, PARAMS, target_rows=200, burn_ticks=1)
    assert plans and all("Inner, BuildLeft" in p and "BuildRight" not in p for p in plans)
    monkeypatch.setattr(detect, "BROADCAST_ROWS", 0)
    plans.clear()
    detect.detect_batch(ticks, PARAMS, target_rows=200, burn_ticks=1)
    assert plans and not any("BroadcastHashJoin" in p for p in plans)

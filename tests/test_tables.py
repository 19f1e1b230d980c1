"""Decoding, contract, idempotent writes, partition pruning, exports."""

import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapewatch.operators import desk
from tapewatch.schemas import ANOMALIES, PARTITION_COLUMNS, RAW_EVENTS, SCORED, TICK
from tapewatch.sources import files, log, tables
from tapewatch.sources.files import stream_ticks_from_files
from tapewatch.streaming.sinks import build_sink
from tests.conftest import random_ticks


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def scored_row(i=0, flagged=False, when="2026-09-16 14:30:00.250", **changes):
    row = dict(
        ticker="AAPL", timestamp=at(when), price=100.0 + i, volume=10.0, zscore=None, vwap_divergence=None,
        is_anomaly=flagged, anomaly_type="price_shock" if flagged else None, ewma_divergence=None, cusum_price=None,
        cusum_volume=None, risk_score=1.5 if flagged else 0.1, signals="zscore" if flagged else None,
        incident_id="AAPL-1" if flagged else None, tick_id=f"AAPL-1-{i}",
    )
    row.update(changes)
    return tuple(row[c] for c in SCORED.fieldNames())


def test_decode_sends_bad_payloads_aside(spark):
    good = json.dumps({"ticker": "A", "event_time_ms": 5, "price": 1.5, "volume": 2, "side": "buy"})
    rows = [(good,), ("not json",), ('{"ticker": "A"}',), (None,)]
    ticks, rejected = files.decode_ticks(spark.createDataFrame(rows, "value string"))
    assert [(r["ticker"], r["event_time_ms"], r["price"], r["bid"]) for r in ticks.collect()] == [("A", 5, 1.5, None)]
    assert rejected.count() == 3


def test_scored_lines_read_back(spark, tmp_path):
    lines = [
        "starting up ...",
        json.dumps({"ticker": "A", "timestamp": "2026-09-16T14:30:00.250Z", "price": 1.0, "is_anomaly": False, "tick_id": "A-1-0"}),
        "",
        '  {"ticker": "A", "timestamp": "2026-09-16T14:30:01.000Z", "price": 2.0, "zscore": 3.5, "is_anomaly": true}',
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = sorted(files.read_scored_jsonl(spark, str(tmp_path)).collect(), key=lambda r: r["event_time_ms"])
    assert [r["event_time_ms"] for r in rows] == [1789569000250, 1789569001000]
    assert rows[0]["zscore"] is None and rows[1]["zscore"] == 3.5 and rows[1]["tick_id"] is None


def test_csv_scan_and_export(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "ticker,event_time_ms,price,bid,ask,volume,label\nA,1000,1.5,1.4,1.6,10,normal\nA,2000,2.5,2.4,2.6,20,price_shock\n"
    )
    t = files.read_ticks_csv(spark, str(tmp_path / "t.csv"))
    assert [(r["price"], r["volume"], r["label"]) for r in t.orderBy("arrival").collect()] == [
        (1.5, 10.0, "normal"), (2.5, 20.0, "price_shock")]
    files.write_csv(t.drop("arrival"), str(tmp_path / "out"))
    assert files.read_ticks_csv(spark, str(tmp_path / "out")).drop("arrival").exceptAll(t.drop("arrival")).count() == 0


def test_messages_leave_out_what_is_missing(spark):
    t = spark.createDataFrame([("A", 1, 2.0, 3.0, float("nan"), None)], "ticker string, event_time_ms long, price double, volume double, bid double, label string")
    r = files.ticks_to_messages(t).first()
    assert r["key"] == "A" and json.loads(r["value"]) == {"ticker": "A", "event_time_ms": 1, "price": 2.0, "volume": 3.0}


def test_log_options_and_shape(spark):
    o = log.stream_options("k:9092", "ticks", "earliest", 500)
    assert o["failOnDataLoss"] == "false" and o["maxOffsetsPerTrigger"] == "500" and o["startingOffsets"] == "earliest"
    assert "maxOffsetsPerTrigger" not in log.stream_options("k:9092", "ticks")
    assert log.bounded_options("k", "t")["endingOffsets"] == "latest"
    with pytest.raises(ValueError):
        log.stream_options("k", "t", "middle")
    raw = spark.createDataFrame([(0, 7, b"A", b'{"event_time_ms": 5}')], "partition int, offset long, key binary, value binary")
    assert log.with_message_time(log.log_records(raw)).first().asDict() == {
        "partition": 0, "offset": 7, "key": "A", "value": '{"event_time_ms": 5}', "event_time_ms": 5}


def test_both_layouts_are_normalised(spark):
    new = tables.normalise_scored(spark.createDataFrame([scored_row(3, True)], SCORED)).first()
    assert new["tick_id"] == "AAPL-1-3" and new["day"] == date(2026, 9, 16) and new["risk_score"] == 1.5
    old = spark.createDataFrame([scored_row(3, True)], SCORED).select(
        "ticker", "timestamp", "price", "volume", "zscore", "vwap_divergence", "is_anomaly", "anomaly_type")
    r = tables.normalise_scored(old).first()
    assert r["tick_id"] == "AAPL-1789569000250-0" and r["risk_score"] is None and r["signals"] is None and r["incident_id"] is None
    with pytest.raises(ValueError):
        tables.normalise_scored(old.drop("timestamp"))


def test_batch_written_twice_is_stored_once(spark, tmp_path):
    raw, bad = str(tmp_path / "raw"), str(tmp_path / "bad")
    batch = spark.createDataFrame([scored_row(0), scored_row(1, True)], SCORED)
    write = tables.persist_batch(raw, bad)
    for _ in range(2):
        write(batch, 0)
        assert spark.read.parquet(raw).count() == 2
        stored = tables.read_table(spark, bad, ANOMALIES).collect()
        assert len(stored) == 1 and stored[0]["day"] == date(2026, 9, 16)
    later = spark.createDataFrame([scored_row(2), scored_row(5, when="2026-09-17 00:00:01")], SCORED)
    write(later, 1)
    assert tables.read_table(spark, raw, RAW_EVENTS).count() == 4


def test_upsert_replaces_changed_rows_and_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "raw")
    first = [scored_row(i) for i in range(4)] + [scored_row(9, when="2026-09-17 10:00:00")]
    tables.upsert_partitions(tables.raw_rows(spark.createDataFrame(first, SCORED)), path)
    changed = [scored_row(1, price=555.0), scored_row(7)]
    tables.upsert_partitions(tables.raw_rows(spark.createDataFrame(changed, SCORED)), path)
    stored = {r["tick_id"]: r["price"] for r in tables.read_table(spark, path, RAW_EVENTS).collect()}
    assert stored == {"AAPL-1-0": 100.0, "AAPL-1-1": 555.0, "AAPL-1-2": 102.0, "AAPL-1-3": 103.0, "AAPL-1-7": 107.0, "AAPL-1-9": 109.0}
    assert spark.read.parquet(path).count() == 6


def test_custom_writer_gets_raw_rows_first(spark):
    seen = []
    write = tables.persist_batch("raw", "bad", writer=lambda df, path: seen.append((path, df.count())))
    write(spark.createDataFrame([scored_row(0), scored_row(1, True)], SCORED), 0)
    assert seen == [("raw", 2), ("bad", 1)]


def test_contract_lists_every_problem(spark, tmp_path):
    raw, bad, lost = (str(tmp_path / n) for n in ("raw", "bad", "lost"))
    row = spark.createDataFrame([scored_row(0, True)], SCORED)
    tables.raw_rows(row).write.partitionBy("ticker").parquet(raw)
    tables.anomaly_rows(row).drop("signals").write.partitionBy(*PARTITION_COLUMNS).parquet(bad)
    with pytest.raises(tables.ContractError) as e:
        tables.verify_contract(spark, {raw: RAW_EVENTS, bad: ANOMALIES, lost: RAW_EVENTS})
    text = str(e.value)
    assert "partitioned by ['ticker']" in text and "missing ['signals']" in text and "does not exist" in text
    good = str(tmp_path / "good")
    tables.raw_rows(row).write.partitionBy(*PARTITION_COLUMNS).parquet(good)
    tables.verify_contract(spark, {good: RAW_EVENTS})


def test_sink_refuses_an_old_table(spark, tmp_path):
    raw = str(tmp_path / "raw")
    tables.raw_rows(spark.createDataFrame([scored_row(0)], SCORED)).write.partitionBy("ticker").parquet(raw)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCORED).parquet(str(tmp_path / "in"))
    with pytest.raises(tables.ContractError):
        build_sink(stream, "ck", raw_path=raw, anomalies_path=str(tmp_path / "bad"))


def test_one_destination_only(spark, tmp_path):
    stream = spark.readStream.schema(SCORED).parquet(str(tmp_path))
    with pytest.raises(ValueError):
        build_sink(stream, "ck", raw_path="a", anomalies_path="b", topic="t", servers="k")
    with pytest.raises(ValueError):
        build_sink(stream, "ck", raw_path="a")
    with pytest.raises(ValueError):
        build_sink(stream, "ck", topic="t")


def test_payload_for_a_topic(spark):
    r = files.keyed_json(spark.createDataFrame([scored_row(0)], SCORED), "ticker", SCORED.fieldNames()).first()
    value = json.loads(r["value"])
    assert r["key"] == "AAPL" and value["tick_id"] == "AAPL-1-0" and "zscore" not in value


@pytest.fixture(scope="module")
def midnight(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "raw")
    rows = [scored_row(i, when=f"2026-09-16 23:{55 + i}:00") for i in range(5)]
    rows += [scored_row(5 + i, when=f"2026-09-17 00:0{i}:00") for i in range(5)]
    rows += [scored_row(50, when="2026-09-16 10:00:00", ticker="MSFT")]
    tables.upsert_partitions(tables.raw_rows(spark.createDataFrame(rows, SCORED)), path)
    return tables.read_table(spark, path, RAW_EVENTS)


def test_windows_across_midnight(midnight):
    start, end = at("2026-09-16 23:57:00"), at("2026-09-17 00:10:00")
    found = desk.scan_partitions(midnight, ["AAPL"], start, end)
    assert sorted(r["price"] for r in found.collect()) == [102.0 + i for i in range(8)]
    assert [r["price"] for r in desk.newest_rows(found, 3).collect()] == [109.0, 108.0, 107.0]
    newest = {r["ticker"]: r["latest_event"] for r in desk.latest_event(midnight).collect()}
    assert newest["AAPL"].minute == 4 and newest["MSFT"].hour == 10


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("PushedFilters")[0] for x in plan.split("PartitionFilters")[1:]]


def test_lookback_reads_its_days_and_the_newest_of_empty_tickers(midnight):
    now = at("2026-09-17 00:04:30")
    assert desk.partition_days(midnight)["MSFT"] == [now.date() - timedelta(days=1)]
    found = desk.lookback(midnight, now, 3)
    assert sorted((r["ticker"], r["price"]) for r in found.collect()) == [
        ("AAPL", 107.0), ("AAPL", 108.0), ("AAPL", 109.0), ("MSFT", 150.0),
    ]
    recent, older = partition_filters(found)[:2]
    assert "day" in recent and "2026-09-17" in recent and "ticker" in older and "MSFT" in older and "2026-09-16" in older
    assert desk.lookback(midnight, now, 3, fallback=False).count() == 3
    early = desk.lookback(midnight, at("2026-09-16 23:56:30"), 1)  # later rows do not count
    assert sorted((r["ticker"], r["price"]) for r in early.collect()) == [("AAPL", 101.0), ("MSFT", 150.0)]
    assert desk.lookback(midnight, at("2026-09-15 00:00:00"), 60).count() == 0


def test_metrics_of_a_lookback(midnight, spark):
    kinds = {f.name: f.dataType for f in ANOMALIES.fields if f.name not in midnight.columns}
    rows = midnight.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    bars = spark.createDataFrame([("AAPL", at("2026-09-17 00:04:00"), 1, 5.0)], "ticker string, bar_time timestamp, bar_ms long, close double")
    stored = spark.createDataFrame([("AAPL",), ("NONE",)], "ticker string")
    got = {r["ticker"]: r for r in desk.lookback_metrics(rows, bars, at("2026-09-17 00:04:30"), 3, stored).collect()}
    assert got["AAPL"]["anomaly_count"] == 3 and got["AAPL"]["latest_price"] == 5.0 and got["NONE"]["anomaly_count"] == 0


def test_rejected_records_are_kept_and_counted(spark, tmp_path):
    from tapewatch.sources.log import split_records
    from tapewatch.streaming.sinks import rejected_counts, start_quarantine

    good = '{"ticker": "A", "event_time_ms": 5, "price": 1.0}'
    rows = [(0, 1, good), (0, 2, "no json"), (1, 3, '{"ticker": "A"}'), (1, 4, None), (1, 5, '{"price": 2}')]
    raw = spark.createDataFrame(rows, "partition int, offset long, value string")
    raw.write.parquet(str(tmp_path / "in"))
    ticks, rejected = split_records(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")))
    assert "arrival" in ticks.columns and "event_time" in ticks.columns
    start_quarantine(rejected, str(tmp_path / "bad"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted(r["offset"] for r in stored.collect()) == [2, 3, 4, 5]
    counts = {(r["partition"], r["reason"]): r["records"] for r in rejected_counts(stored).collect()}
    assert counts == {(0, "unreadable"): 1, (1, "incomplete"): 2, (1, "unreadable"): 1}


def test_alert_log_of_a_retried_batch_stays_single(spark, tmp_path):
    from tapewatch.streaming.sinks import alert_log_batch

    row = spark.sql("SELECT 'a' AS alert_id, 'opened' AS event, timestamp'2026-01-01 00:00:00' AS end_time")
    write = alert_log_batch(str(tmp_path / "log"))
    for batch_id in (0, 1, 1):
        write(row, batch_id)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_upsert_reads_only_touched_partitions(spark):
    condition = tables.in_partitions(["ticker", "day"], [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", 5)])
    rows = spark.createDataFrame([(t, d) for t in "ABCD" for d in range(7)], "ticker string, day int")
    assert sorted(tuple(r) for r in rows.filter(condition).collect()) == [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("C", 5)]
    assert rows.filter(tables.in_partitions(["ticker", "day"], [])).count() == 0


def test_only_the_named_partitions_are_read(midnight):
    found = desk.scan_partitions(midnight, ["AAPL"], at("2026-09-16 23:57:00"), at("2026-09-17 00:10:00"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "ticker" in part and "day" in part
    assert "GreaterThanOrEqual(event_time" in plan
    assert len(found.inputFiles()) >= 1


def test_reports_and_alert_log(spark, tmp_path):
    report = spark.createDataFrame([("x", 1)], "name string, n int")
    files.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().asDict() == {"name": "x", "n": 1}
    for i in (1, 3, 2):
        files.append_alert_log(spark.createDataFrame([(f"a{i}", f"2026-01-0{i}T00:00:00Z")], "alert_id string, created_at string"), str(tmp_path / "log"))
    alerts = spark.read.json(str(tmp_path / "log"))
    assert alerts.count() == 3 and files.latest_alert(alerts).first()["alert_id"] == "a3"


def test_sink_reads_a_batch_once(spark, tmp_path):
    """Both writes come from the kept batch, not from a second evaluation."""
    calls = spark.sparkContext.accumulator(0)
    t = random_ticks(spark, 20, tickers=("A",))
    rows = t.select(F.struct(*[F.lit(None).alias("x")])).count()
    batch = spark.createDataFrame([scored_row(i, i % 3 == 0) for i in range(rows)], SCORED).coalesce(1)

    def count(it):
        for pdf in it:
            calls.add(len(pdf))
            yield pdf

    counted = batch.mapInPandas(count, SCORED)
    tables.persist_batch(str(tmp_path / "r"), str(tmp_path / "b"))(counted, 0)
    assert calls.value == rows


def test_of_repeated_keys_in_a_batch_the_last_row_is_kept(spark, tmp_path):
    day = date(2024, 1, 3)
    when = datetime(2024, 1, 3, 10, tzinfo=timezone.utc)
    rows = [("A", day, when, "A-1", 9.0), ("A", day, when, "A-2", 1.0), ("A", day, when, "A-1", 2.0), ("A", day, when, "A-1", None)]
    frame = spark.createDataFrame(rows[:3], "ticker string, day date, event_time timestamp, tick_id string, price double").coalesce(1)
    path = str(tmp_path / "t")
    tables.upsert_partitions(frame, path)
    assert sorted((r.tick_id, r.price) for r in spark.read.parquet(path).collect()) == [("A-1", 2.0), ("A-2", 1.0)]
    tables.upsert_partitions(spark.createDataFrame(rows[3:], frame.schema), path)
    assert {r.tick_id: r.price for r in spark.read.schema(frame.schema).parquet(path).collect()} == {"A-1": None, "A-2": 1.0}


def test_reading_streams_twice_leaves_the_schemas_alone(spark, tmp_path):
    spark.createDataFrame([("A", 1, 1.0, 1.0, 7)], "ticker string, event_time_ms long, price double, volume double, arrival long").write.parquet(str(tmp_path / "in"))
    before = TICK.fieldNames()
    for _ in range(2):
        stream = stream_ticks_from_files(spark, str(tmp_path / "in"), arrival=True)
        assert stream.columns.count("arrival") == 1 and TICK.fieldNames() == before

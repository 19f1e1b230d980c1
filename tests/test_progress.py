"""Counts of micro-batches that outlive what a query remembers."""

from pyspark.sql import functions as F

from tapewatch.operators import ticks as tk
from tapewatch.operators.kernel import score_block
from tapewatch.params import DetectorParams
from tapewatch.streaming.progress import progress_summary, progress_totals, record_progress, stored_progress
from tests.conftest import random_ticks


def test_many_batches_are_counted_over_a_restart(spark, tmp_path):
    source, rows = str(tmp_path / "in"), 0
    recorder = record_progress(spark, str(tmp_path / "progress"))

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        sink = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state"))
        query = sink.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    try:
        for files in (110, 40):
            spark.range(rows, rows + 3 * files, 1, files).write.mode("append").parquet(source)
            rows += 3 * files
            query = run()
        totals = progress_totals(stored_progress(spark, str(tmp_path / "progress"))).collect()
    finally:
        spark.streams.removeListener(recorder)
    assert [(r.batches, r.rows, r.rows_dropped_by_watermark, r.last_batch_id) for r in totals] == [(150, 450, 0, 149)]
    assert progress_summary(query)["batches"] == 40


def test_late_ticks_are_those_a_stream_drops(spark):
    t = random_ticks(spark, 300).withColumn("batch", F.floor((F.col("arrival") + F.pmod(F.hash("arrival", "ticker"), F.lit(60))) / 25))
    for per_slice in (2, 1_000):
        marked = tk.late_mask(t, "batch", per_slice).toPandas()
        assert marked.is_late.sum() > 10
        for ticker, own in marked.groupby("ticker"):
            state, kept = None, 0
            for _, batch in own.groupby("batch"):
                batch = batch.sort_values("event_time_ms", kind="stable")
                _, columns, state = score_block(ticker, *(batch[c].to_numpy() for c in ("event_time_ms", "price", "volume")), DetectorParams(), state)
                kept += len(columns["zscore"]) if columns else 0
            assert state["late_dropped"] == own.is_late.sum() and kept == (~own.is_late).sum()
    assert tk.drop_late(t, "batch").count() == (~marked.is_late).sum()

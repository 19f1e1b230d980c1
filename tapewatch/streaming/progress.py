"""What a streaming query has done so far."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "query_id string, run_id string, name string, batch_id long, rows long, rows_dropped_by_watermark long, at string"
FLUSH_MS = 30_000


class ProgressRecorder(StreamingQueryListener):
    """Writes the counts of every micro-batch of the session's queries to a
    folder, one small file each. A batch that is run again, after a failure or
    a restart, replaces its file, so that it counts once; a trigger without
    data replaces nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {
            "query_id": str(p.id),
            "run_id": str(p.runId),
            "name": p.name,
            "batch_id": p.batchId,
            "rows": p.numInputRows,
            "rows_dropped_by_watermark": sum(op.numRowsDroppedByWatermark for op in p.stateOperators),
            "at": p.timestamp,
        }
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/query={p.id}/batch-{p.batchId}.json")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if row["rows"] == 0 and row["rows_dropped_by_watermark"] == 0 and files.exists(target):
            return
        out = files.create(target, True)
        try:
            out.write((json.dumps(row) + "\n").encode("utf-8"))
        finally:
            out.close()


def record_progress(spark: SparkSession, path: str) -> ProgressRecorder:
    """Starts recording; ``spark.streams.removeListener`` ends it."""
    recorder = ProgressRecorder(spark, path)
    spark.streams.addListener(recorder)
    return recorder


def stored_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per micro-batch that was recorded. Waits until the events of
    batches that are done have arrived."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(FLUSH_MS)
    return spark.read.schema(PROGRESS).json(path)


def progress_totals(progress: DataFrame) -> DataFrame:
    """Per query: batches with data, rows, rows dropped by the watermark and
    the last batch, over all runs of the query."""
    return progress.groupBy("query_id").agg(
        F.count_if(F.col("rows") > 0).alias("batches"),
        F.sum("rows").alias("rows"),
        F.sum("rows_dropped_by_watermark").alias("rows_dropped_by_watermark"),
        F.max("batch_id").alias("last_batch_id"),
    )


def progress_summary(query: StreamingQuery) -> dict:
    """Batches with data, rows read, and rows dropped by the watermark among
    the batches that the query still remembers (Spark keeps the last 100 of a
    run); ``record_progress`` has them all."""
    known = query.recentProgress
    return {
        "batches": sum(p["numInputRows"] > 0 for p in known),
        "rows": sum(p["numInputRows"] for p in known),
        "rows_dropped_by_watermark": sum(op["numRowsDroppedByWatermark"] for p in known for op in p["stateOperators"]),
        "last_batch_id": known[-1]["batchId"] if known else None,
    }

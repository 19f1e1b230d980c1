"""Starting a scored or alert stream into a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tapewatch.schemas import ANOMALIES, RAW_EVENTS, SCORED_COLUMNS
from tapewatch.sources.files import keyed_json, write_alert_log
from tapewatch.sources.tables import create_table, persist_batch, verify_contract
from tapewatch.streaming.detect import checkpoint_path


def build_sink(
    scored: DataFrame,
    checkpoint: str,
    name: str = "detector",
    raw_path: str | None = None,
    anomalies_path: str | None = None,
    servers: str | None = None,
    topic: str | None = None,
) -> DataStreamWriter:
    """A writer to exactly one destination: the two tables, a topic, or the
    console. The tables are checked against their contract before the start."""
    tables = raw_path is not None or anomalies_path is not None
    if tables and topic is not None:
        raise ValueError("choose either the tables or an output topic")
    if tables and (raw_path is None or anomalies_path is None):
        raise ValueError("both table paths are needed")
    location = checkpoint_path(checkpoint, name)
    if tables:
        spark = scored.sparkSession
        targets = {raw_path: RAW_EVENTS, anomalies_path: ANOMALIES}
        for path, schema in targets.items():
            create_table(spark, path, schema)
        verify_contract(spark, targets)
        writer = scored.writeStream.foreachBatch(persist_batch(raw_path, anomalies_path))
    elif topic is not None:
        if not servers:
            raise ValueError("an output topic needs bootstrap servers")
        writer = (
            keyed_json(scored, "ticker", SCORED_COLUMNS).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
        )
    else:
        writer = scored.writeStream.format("console").option("truncate", False)
    return writer.option("checkpointLocation", location).outputMode("update").queryName(name)


def start_sink(writer: DataStreamWriter, available_now: bool = False) -> StreamingQuery:
    """Starts the query: over what is there and then stop, or continuously."""
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_quarantine(
    rejected: DataFrame, path: str, checkpoint: str, name: str = "quarantine", available_now: bool = False
) -> StreamingQuery:
    """Stores records that are no ticks under ``path``; ``rejected_counts``
    counts them."""
    writer = rejected.writeStream.format("parquet").option("path", path).queryName(name)
    return start_sink(writer.option("checkpointLocation", checkpoint_path(checkpoint, name)), available_now)


def rejected_counts(quarantine: DataFrame) -> DataFrame:
    """Rejected records per log partition and why: unreadable or incomplete."""
    readable = F.coalesce(F.json_object_keys("value").isNotNull(), F.lit(False))
    why = F.when(readable, "incomplete").otherwise("unreadable")
    return quarantine.groupBy("partition", why.alias("reason")).agg(F.count("*").alias("records"))


def alert_log_batch(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function writing dispatched alerts as JSON lines, a folder
    per micro-batch: a batch that is retried replaces its own lines."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sent = batch.filter(F.col("event").isin("opened", "escalated"))
        write_alert_log(with_created_at(sent), f"{path}/batch_id={batch_id}")

    return write


def with_created_at(alerts: DataFrame) -> DataFrame:
    """Creation time of the alert and its delay after the last event."""
    now = F.current_timestamp()
    delay = (F.unix_micros(now) - F.unix_micros("end_time")) / 1000.0
    return alerts.withColumn("created_at", now).withColumn("detection_latency_ms", F.round(delay, 2))


def with_written_at(rows: DataFrame, time: str = "event_time") -> DataFrame:
    """Write time of a sink batch and the latency since the event."""
    now = F.current_timestamp()
    return rows.withColumn("written_at", now).withColumn(
        "latency_ms", (F.unix_micros(now) - F.unix_micros(time)) / 1000.0
    )


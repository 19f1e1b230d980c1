"""Ticks in a Kafka log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.session import ensure_utc
from tapewatch.sources.files import decode_ticks


MAX_OFFSETS = 1_000_000  # records per micro-batch, so that a backlog does not land in one frame


def stream_options(servers: str, topic: str, starting: str = "latest", max_offsets: int | None = None) -> dict[str, str]:
    if starting not in ("latest", "earliest"):
        raise ValueError("starting is latest or earliest")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_tick_stream(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", max_offsets: int | None = MAX_OFFSETS
) -> DataFrame:
    """Streaming ticks with event time and arrival offset, without the label.
    Records that are no ticks are in ``read_rejected_stream``."""
    return split_records(_records(spark, servers, topic, starting, max_offsets))[0]


def read_rejected_stream(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", max_offsets: int | None = MAX_OFFSETS
) -> DataFrame:
    """The stream's records that are no ticks, for ``sinks.start_quarantine``."""
    return split_records(_records(spark, servers, topic, starting, max_offsets))[1]


def _records(spark: SparkSession, servers: str, topic: str, starting: str, max_offsets: int | None) -> DataFrame:
    ensure_utc(spark)
    return spark.readStream.format("kafka").options(**stream_options(servers, topic, starting, max_offsets)).load()


def split_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ticks, rejected)`` of Kafka-shaped records. Rejected ones keep their
    coordinates and payload."""
    ticks, rejected = decode_ticks(raw.select("partition", "offset", "value"))
    named = (
        ticks.drop("label", "partition")
        .withColumnRenamed("offset", "arrival")
        .withColumn("event_time", F.timestamp_millis("event_time_ms"))
    )
    return named, rejected.withColumn("value", F.col("value").cast("string"))


def bounded_options(servers: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "endingOffsets": "latest",
        "failOnDataLoss": "false",
    }


def read_topic_bounded(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Every message of a topic with its coordinates, key and payload text."""
    raw = spark.read.format("kafka").options(**bounded_options(servers, topic)).load()
    return log_records(raw)


def log_records(raw: DataFrame) -> DataFrame:
    """Kafka-shaped rows as ``partition, offset, key, value`` with text columns."""
    return raw.select(
        "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


def with_message_time(log: DataFrame) -> DataFrame:
    """Log records with the event time of their payload."""
    return log.withColumn("event_time_ms", F.get_json_object("value", "$.event_time_ms").cast("long"))

"""Tick files, scored-row files and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewatch.schemas import SCORED, TICK, TICK_CSV
from tapewatch.session import ensure_utc


def read_ticks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled history with its declared schema; ``arrival`` keeps file order."""
    ensure_utc(spark)
    return spark.read.schema(TICK_CSV).option("header", True).csv(path).withColumn(
        "arrival", F.monotonically_increasing_id()
    )


def stream_ticks_from_files(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1, arrival: bool = False
) -> DataFrame:
    """The tick stream read from a folder instead of a log. With ``arrival``
    the files hold the arrival number that orders ticks of one millisecond."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError("fmt is parquet, json or csv")
    ensure_utc(spark)
    schema = StructType(list((TICK if fmt != "csv" else TICK_CSV).fields))  # a list of its own, which may grow
    if arrival:
        schema = schema.add("arrival", "long")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    ticks = reader.format(fmt).load(path)
    return ticks.drop("label").withColumn("event_time", F.timestamp_millis("event_time_ms"))


def decode_ticks(records: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(ticks, rejected)``: JSON payloads as tick columns, and the records
    whose payload is no tick (unreadable, or without ticker, time or price)."""
    parsed = records.withColumn("_tick", F.from_json(F.col(value).cast("string"), TICK))
    ok = (
        F.col("_tick.ticker").isNotNull()
        & F.col("_tick.event_time_ms").isNotNull()
        & F.col("_tick.price").isNotNull()
    )
    ok = F.coalesce(ok, F.lit(False))
    rest = [c for c in records.columns if c != value]
    ticks = parsed.filter(ok).select(*rest, "_tick.*")
    rejected = parsed.filter(~ok).select(*records.columns)
    return ticks, rejected


def read_scored_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Scored rows from JSON lines: other lines are skipped, missing fields are
    null, ``event_time_ms`` is derived from the ISO time."""
    ensure_utc(spark)
    lines = spark.read.text(path).filter(F.ltrim("value").startswith("{"))
    rows = lines.select(F.from_json("value", SCORED).alias("r")).select("r.*")
    return rows.withColumn("event_time_ms", F.unix_millis("timestamp"))


def keyed_json(rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``key, value`` records with the columns as a JSON object; null fields
    are left out of it."""
    columns = columns or rows.columns
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def ticks_to_messages(ticks: DataFrame) -> DataFrame:
    """Producer payloads: bid, ask, label and side only where present, NaN as
    null."""

    def clean(name: str) -> Column:
        kind = dict(ticks.dtypes)[name]
        c = F.col(name)
        return F.when(~F.isnan(c), c).alias(name) if kind in ("double", "float") else c

    names = ["ticker", "event_time_ms", "price", "volume"]
    names += [c for c in ("side", "bid", "ask", "label") if c in ticks.columns]
    return keyed_json(ticks.select(*[clean(c) for c in names]), "ticker")


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report frame (one or a few rows) as JSON."""
    report.write.mode(mode).json(path)


def append_alert_log(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def write_alert_log(alerts: DataFrame, path: str) -> None:
    """The lines of one micro-batch, replacing those of an earlier try."""
    alerts.write.mode("overwrite").json(path)


def latest_alert(log: DataFrame) -> DataFrame:
    """The newest record of the alert log, as one row."""
    return log.agg(F.max_by(F.struct(*log.columns), F.struct("created_at", "alert_id")).alias("_a")).select("_a.*")

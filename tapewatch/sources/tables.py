"""The two stored tables: contract, normalising, idempotent upsert."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewatch.schemas import ANOMALIES, PARTITION_COLUMNS, RAW_EVENTS, ROW_KEY
from tapewatch.session import ensure_utc

# Columns a detector output may lack.
OPTIONAL = {
    "zscore": "double",
    "vwap_divergence": "double",
    "anomaly_type": "string",
    "ewma_divergence": "double",
    "cusum_price": "double",
    "cusum_volume": "double",
    "risk_score": "double",
    "signals": "string",
    "incident_id": "string",
    "tick_id": "string",
}


class ContractError(RuntimeError):
    """A stored table does not have the layout the sink writes."""


def normalise_scored(rows: DataFrame) -> DataFrame:
    """Either detector layout as the stored layout: ``event_time``, every
    optional column, a non-null ``tick_id``, and the UTC ``day``."""
    ensure_utc(rows.sparkSession)
    if "timestamp" in rows.columns:
        rows = rows.withColumnRenamed("timestamp", "event_time")
    elif "event_time" not in rows.columns:
        raise ValueError("detector output needs a timestamp or event_time column")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in rows.columns})
    made_up = F.concat_ws("-", F.col("ticker"), F.unix_millis("event_time"), F.lit("0"))
    return rows.withColumn("tick_id", F.coalesce("tick_id", made_up)).withColumn("day", F.to_date("event_time"))


def raw_rows(rows: DataFrame) -> DataFrame:
    """Scored ticks as ``raw_events`` rows."""
    rows = normalise_scored(rows)
    if "side" not in rows.columns:
        rows = rows.withColumn("side", F.lit(None).cast("string"))
    return rows.select(*RAW_EVENTS.fieldNames())


def anomaly_rows(rows: DataFrame) -> DataFrame:
    """Flagged scored ticks as ``anomalies`` rows."""
    return normalise_scored(rows).filter("is_anomaly").select(*ANOMALIES.fieldNames())


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def partition_columns(spark: SparkSession, path: str, schema: StructType) -> list[str] | None:
    """Partition columns of a stored table, from the folder names of one of
    its files; None for a table without rows."""
    stored = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    one = stored.select(F.col("_metadata.file_path").alias("p")).first()
    return None if one is None else [part.split("=")[0] for part in one["p"].split("/") if "=" in part]


def contract_problems(
    found: StructType | None, partitions: Sequence[str], table: str, required: Iterable[str],
    part_cols: Sequence[str] = tuple(PARTITION_COLUMNS),
) -> list[str]:
    if found is None:
        return [f"table {table} does not exist"]
    missing = sorted(set(required) - set(found.fieldNames()))
    if missing:
        return [f"{table} is missing {missing}"]
    if set(partitions) != set(part_cols):
        return [f"{table} is partitioned by {sorted(partitions)}, not {sorted(part_cols)}"]
    return []


def verify_contract(spark: SparkSession, tables: dict[str, StructType]) -> None:
    """Raises one error naming every problem of the stored tables
    (``{path: schema}``); returns quietly when all match. A table without rows
    takes the layout of the first write."""
    problems: list[str] = []
    for path, schema in tables.items():
        optional = {"side"}
        required = [c for c in schema.fieldNames() if c not in optional]
        if not _path_exists(spark, path):
            problems += contract_problems(None, [], path, required)
            continue
        partitions = partition_columns(spark, path, schema)
        if partitions is not None:
            problems += contract_problems(spark.read.parquet(path).schema, partitions, path, required)
    if problems:
        raise ContractError("; ".join(problems))


def create_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty partitioned table, so that readers find it before any write."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*PARTITION_COLUMNS).parquet(path)


def _dedupe(rows: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Of rows with one key the last of the batch, as a store keeps it that
    writes them one after the other."""
    w = Window.partitionBy(*key_cols).orderBy(F.desc("_at"))
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_at")


def upsert_partitions(
    rows: DataFrame,
    path: str,
    part_cols: Sequence[str] = tuple(PARTITION_COLUMNS),
    key_cols: Sequence[str] = tuple(ROW_KEY),
    time_col: str = "event_time",
) -> None:
    """Writes rows so that a repeated write leaves the same table.

    Stored rows are looked up only in the partitions that the batch touches,
    stated as constants, and there in its time range. Rows whose key is not stored
    yet are appended; a batch that is retried finds its rows and appends
    nothing. Only when a stored row has other values than the new one are the
    partitions concerned rewritten, through a staging folder next to the table.
    One writer at a time."""
    spark = rows.sparkSession
    values = [c for c in rows.columns if c not in key_cols]
    new = _dedupe(rows, key_cols).persist()
    marked = None
    try:
        span = new.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
        if span["lo"] is None:
            return
        if not _path_exists(spark, path):
            _append(new, path, part_cols)
            return
        stored = spark.read.schema(rows.schema).parquet(path)
        touched = [tuple(r) for r in new.select(*part_cols).distinct().collect()]  # a few per micro-batch
        near = stored.filter(
            in_partitions(part_cols, touched) & F.col(time_col).between(F.lit(span["lo"]), F.lit(span["hi"]))
        )
        old = near.select(*key_cols, F.struct(*values).alias("_old"))
        state = (
            F.when(F.col("_old").isNull(), "absent")
            .when(F.col("_old").eqNullSafe(F.struct(*values)), "same")
            .otherwise("changed")
        )
        marked = new.join(old, list(key_cols), "left").withColumn("_state", state).drop("_old").persist()
        changed = marked.filter(F.col("_state") == "changed").select(*part_cols).distinct()
        fresh = marked.filter(F.col("_state") == "absent").drop("_state").select(*rows.columns)
        if changed.isEmpty():
            _append(fresh, path, part_cols)
        else:
            _append(fresh.join(changed, list(part_cols), "left_anti"), path, part_cols)
            rewritten = [tuple(r) for r in changed.collect()]
            kept = stored.filter(in_partitions(part_cols, rewritten))
            _rewrite(new.join(changed, list(part_cols), "left_semi"), kept, path, part_cols, key_cols)
    finally:
        if marked is not None:
            marked.unpersist()
        new.unpersist()


def in_partitions(part_cols: Sequence[str], wanted: Sequence[tuple]) -> Column:
    """Condition that holds in the named partitions only, as constants, so that
    others are not read. Partitions with the same rest share one part of it."""
    last, rest = part_cols[-1], part_cols[:-1]
    by_rest: dict[tuple, set] = {}
    for p in wanted:
        by_rest.setdefault(p[:-1], set()).add(p[-1])
    shared: dict[frozenset, list[tuple]] = {}
    for head, tails in by_rest.items():
        shared.setdefault(frozenset(tails), []).append(head)
    condition = F.lit(False)
    for tails, heads in shared.items():
        own = F.col(last).isin(sorted(tails))
        if rest:
            names = F.lit(False)
            for head in heads:
                names |= reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in zip(rest, head)])
            own &= names
        condition |= own
    return condition


def _append(rows: DataFrame, path: str, part_cols: Sequence[str]) -> None:
    # rebalance: one file per partition where it is small, several where it is hot
    rows.hint("rebalance", *part_cols).write.mode("append").partitionBy(*part_cols).parquet(path)


def _rewrite(
    new: DataFrame, stored: DataFrame, path: str, part_cols: Sequence[str], key_cols: Sequence[str]
) -> None:
    """Replaces whole partitions by stored rows with the new ones put over
    them. They are staged first, because a partition cannot be overwritten
    while it is read."""
    spark = new.sparkSession
    merged = stored.join(new.select(*key_cols), list(key_cols), "left_anti").select(*new.columns).unionByName(new)
    staging = f"{path.rstrip('/')}__staging/{uuid.uuid4().hex}"
    merged.hint("rebalance", *part_cols).write.partitionBy(*part_cols).parquet(staging)
    spark.read.schema(new.schema).parquet(staging).hint("rebalance", *part_cols).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*part_cols).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(staging)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def persist_batch(
    raw_path: str, anomalies_path: str, writer: Callable[[DataFrame, str], None] = upsert_partitions
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: every scored tick to the raw table, then the
    flagged ones to the anomaly table. The batch is kept while both writes
    read it. ``writer`` may target another store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            # counts every partition, so that each commits its state
            if batch.count() == 0:
                return
            writer(raw_rows(batch), raw_path)
            writer(anomaly_rows(batch), anomalies_path)
        finally:
            batch.unpersist()

    return write

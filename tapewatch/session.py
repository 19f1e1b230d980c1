"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tapewatch", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on. Cluster sizing
    (executors, memory, shuffle partitions) is left to the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_state_store(spark: SparkSession) -> None:
    """The stateful operators need a state store with column families."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB_PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir when the
    session names one, a throw-away folder only for a local master."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SCOPES: list[list[str]] = []


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``cut_lineage`` writes inside the block when it
    is left. What was built inside must have been written or read by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """df written as a table and read back. Its shuffle files, which nothing
    needs after that, are deleted at the end of the write and not when the
    driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once as a table under the shared checkpoint folder and read
    back: later branches read only the columns they need, and a lost executor
    costs no recomputation. ``intermediate_tables`` deletes such tables."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return write_table(df, path)

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tapewatch.session import checkpoint_folder, write_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{kind}/{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables in the shared folder, deleted once they are used up."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.live: set[str] = set()

    def write(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "tables")
        kept = write_table(df, path)
        kept._scratch_path = path
        self.live.add(path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.live.discard(df._scratch_path)
            delete(self.spark, df._scratch_path)

    def result(self, df: DataFrame) -> DataFrame:
        """df as a table, the only one that is left."""
        others = set(self.live)
        kept = self.write(df)
        for path in others:
            self.live.discard(path)
            delete(self.spark, path)
        return kept


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Arrow batches by bytes as well as rows, since one text may be long. A
    smaller limit of the session's own is kept."""
    name, limit = "spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20
    known = spark.conf.get(name, None)
    if known is None or not known.isdigit() or int(known) > limit:
        spark.conf.set(name, str(limit))


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # a C library without it
        return None


def release_memory() -> None:
    """Gives memory that this Python process no longer uses back to the
    system. Spark keeps its Python workers for later stages, and what a worker
    has freed would stay with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = _malloc_trim()
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` or ``mapInPandas`` that gives its memory
    back at the end of a task."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def releasing_group(run: Callable) -> Callable:
    """The same for a function of one group."""

    @wraps(run)
    def wrapped(group):
        try:
            return run(group)
        finally:
            release_memory()

    return wrapped

"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector becomes the bits of its signs, cut into segments of 16 bits. Every
code is indexed once per segment. Round r looks up all segment values that
differ from the query's in exactly r bits; after it, every code not yet met
differs by more than r bits in each segment, so all distances up to
``segments * (r + 1) - 1`` are provably covered. A query leaves the search once
its k-th verified distance is covered. Equal codes are one entry with their
smallest ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.llm.common import Scratch

SEGMENT_BITS = 16


def sign_code(vector: Column, bits: int) -> Column:
    """The signs of ``bits`` numbers as an array of 16-bit segments; missing
    and null numbers count as not positive."""
    segments = []
    for at in range(0, bits, SEGMENT_BITS):
        value = F.lit(0)
        for i in range(at, min(at + SEGMENT_BITS, bits)):
            value = value + F.when(F.get(vector, F.lit(i)) > 0, 1 << (i - at)).otherwise(0)
        segments.append(value)
    return F.array(*segments)


def _first(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; tasks cut their groups before they send them."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def _flipped(queries: DataFrame, r: int) -> DataFrame:
    """(segment, value, q): all segment values at exactly r bits from the queries'."""
    masks = F.expr(f"filter(sequence(0, {(1 << SEGMENT_BITS) - 1}), m -> bit_count(m) = {r})")  # a constant
    each = queries.select("q", F.posexplode("q").alias("segment", "own"))
    return each.select("segment", "q", "own", F.explode(masks).alias("mask")).select(
        "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"), "q"
    )


def _distances(segments: int) -> list[Column]:
    return [F.bit_count(F.get("q", F.lit(s)).bitwiseXOR(F.get("code", F.lit(s)))) for s in range(segments)]


def _meet(queries: DataFrame, index: DataFrame, r: int, segments: int) -> DataFrame:
    """(q, distance, ids) of the codes first met in round r: pairs that an
    earlier round or an earlier segment of this one has met are left out."""
    apart = _distances(segments)
    first = F.lit(True)
    for s, d in enumerate(apart):
        first &= F.when(F.col("segment") > s, d > r).otherwise(d >= r)
    flipped, index = _flipped(queries, r), index.withColumnRenamed("segment", "_s").withColumnRenamed("value", "_v")
    same = (F.col("segment") == F.col("_s")) & (F.col("value") == F.col("_v"))
    # planned as a shuffle: the size of exploded rows is not known beforehand
    met = flipped.hint("merge").join(index, same & first)
    return met.select("q", sum(apart[1:], apart[0]).alias("distance"), "ids")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", bits: int = 64
) -> DataFrame:
    """(query_id, rank, key, distance): the k rows of ``vectors`` nearest to
    each row of ``queries`` by Hamming distance of sign codes, itself left out,
    ties by key.

    Rows with a null key or vector take no part; rows that repeat a key count
    once per key and code; further columns are ignored. With fewer than k other rows
    all of them are returned; empty tables give no rows."""
    scratch = Scratch(vectors.sparkSession)

    def coded(df: DataFrame) -> DataFrame:
        known = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
        return known.select(F.col(key).alias("id"), sign_code(F.col(vector), bits).alias("code")).distinct()

    rows = coded(vectors)
    entries = _first(rows, "code", ["id"], k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = scratch.write(entries)  # collects k + 1 ids at most
    asked = scratch.write(coded(queries).withColumnRenamed("code", "q"))
    need = min(k + 1, entries.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0])
    segments = -(-bits // SEGMENT_BITS)
    index = entries.select(F.posexplode("code").alias("segment", "value"), "code", "ids")
    left = scratch.write(asked.select("q").distinct())
    found = scratch.write(left.select("q", F.lit(0).alias("distance"), F.lit(0).cast("long").alias("id")).limit(0))
    for r in range(SEGMENT_BITS + 1):
        if left.isEmpty() or not need:
            break
        met = _meet(left, index, r, segments).select("q", "distance", F.explode("ids").alias("id"))
        best = scratch.write(_first(found.unionByName(met), "q", ["distance", "id"], k + 1))
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        done = state.filter((F.col("n") >= need) & (F.col("far") <= segments * (r + 1) - 1)).select("q")
        after = scratch.write(left.join(done, "q", "left_anti"))
        scratch.drop(found, left)
        found, left = best, after
    order = Window.partitionBy("query_id").orderBy("distance", "near")
    return (
        asked.select(F.col("id").alias("query_id"), "q")
        .join(found.select("q", "distance", F.col("id").alias("near")), "q")
        .filter("query_id <> near")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("near").alias(key), F.col("distance").cast("int").alias("distance"))
    )

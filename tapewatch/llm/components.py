"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import Scratch


def _attached(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return (
        _attached(both, least)
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _attached(down, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``, root being the least node it
    is connected to. Loops are ignored; no links give no rows.

    Every round is written to the shared folder and the round before it is
    deleted; rounds end when the edges stay the same. Their number grows with
    the logarithm of the nodes. Minima are aggregated before edges meet them,
    so a node with very many links is no burden to one task."""
    scratch = Scratch(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    edges = scratch.write(edges.distinct())

    def mark(df: DataFrame):
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 20))).first())

    known = mark(edges)
    while known[0]:
        after = scratch.write(_small_star(_large_star(edges)))
        now = mark(after)
        scratch.drop(edges)
        edges = after
        if now == known:
            break
        known = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Sharding by descending a weighted hash tree.

Regions hold racks, racks hold shards. At each level every child draws an
exponential variate from the hash of (key, child), divided by its weight, and
the least draw wins: a child is chosen in proportion to its weight, and a row
changes course only where the weight of a child changed. Draws are expressions
on the row alone, so placing rows needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.llm.common import Scratch


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with a number."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int = 16, racks: int = 2, regions: int = 2) -> Node:
    """An even tree over shards 0 to shards-1, filled region by region."""
    per_rack = -(-shards // (racks * regions))
    numbers, found = iter(range(shards)), []
    for r in range(regions):
        rack_nodes = []
        for k in range(racks):
            own = [n for _, n in zip(range(per_rack), numbers)]
            if own:
                rack_nodes.append(Node(f"r{r}/k{k}", tuple(Node(f"s{n}", shard=n) for n in own)))
        if rack_nodes:
            found.append(Node(f"r{r}", tuple(rack_nodes)))
    return Node("root", tuple(found))


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a rack and region of its own: every draw among the
    old children stays as it was, so rows move into the new shard and nowhere
    else. (A shard added to an old rack with ``dataclasses.replace`` confines
    movement to that region instead.)"""
    n = len(_shards(root))
    r = f"r{len(root.children)}"
    leaf = Node(f"s{n}", shard=n, own_weight=weight)
    return replace(root, children=(*root.children, Node(r, (Node(f"{r}/k0", (leaf,)),))))


def _shards(node: Node) -> list[Node]:
    return [x for c in node.children for x in _shards(c)] if node.children else [node]


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 32 bits of an MD5."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node.name}"))), 1, 8), 16, 10).cast("double")
    return -F.log((h + 0.5) / 4294967296.0) / F.lit(float(node.weight))


def descend(rows: DataFrame, key: Column, root: Node, name: str) -> DataFrame:
    """``rows`` with the shard number that ``key`` (a string) descends to in
    column ``name``. Each level is a column of its own that the next one reads,
    so that a row computes the draws along its path only."""
    level, at = [root], F.lit(0)
    step = 0
    while any(n.children for n in level):
        below: list[Node] = []
        chosen = None
        for i, node in enumerate(level):
            children = node.children or (node,)
            numbers = range(len(below), len(below) + len(children))
            below += children
            if len(children) == 1:
                value = F.lit(numbers[0])
            else:
                draws = [F.struct(_draw(key, c).alias("d"), F.lit(j).alias("i")) for j, c in zip(numbers, children)]
                value = F.array_min(F.array(*draws))["i"]
            chosen = F.when(at == i, value) if chosen is None else chosen.when(at == i, value)
        rows = rows.withColumn(f"_{name}{step}", chosen)
        at, level, step = F.col(f"_{name}{step}"), below, step + 1
    number = F.element_at(F.array(*[F.lit(n.shard) for n in level]), at + 1)
    return rows.withColumn(name, number).drop(*[f"_{name}{i}" for i in range(step)])


def shard_rows(rows: DataFrame, key: str, root: Node) -> DataFrame:
    """``rows`` with ``shard`` and ``grown_shard`` (with one shard more).

    Only the key decides, under the law that growth moves rows into the new
    shard alone. Null keys share the draws of the word ``null``; repeated rows
    go to the same shard; empty input stays empty."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return descend(descend(rows, k, root, "shard"), k, grow(root), "grown_shard")


def number_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``slot``: 0, 1, 2 ... within each shard in the given order.

    Rows are cut into key ranges, numbered inside each range and shifted by the
    counts of the ranges before, so that no shard is numbered by one task. The
    ranges are written first: a lost task cannot change them. The offsets are
    one row per shard and range."""
    scratch = Scratch(rows.sparkSession)
    ranged = rows.repartitionByRange("shard", *order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.write(ranged)
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_range").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(inside))
    return numbered.join(offsets, ["shard", "_range"]).withColumn(
        "slot", (F.col("_before") + F.col("_row") - 1).cast("long")
    ).drop("_range", "_row", "_before")


def shard_documents(docs: DataFrame, root: Node | None = None) -> DataFrame:
    """doc_id, size (bytes of the text and one), text_crc32, law, shard, slot,
    grown_shard for every document. A null text has no bytes and the checksum
    of none; further columns are ignored. Texts are read and not shuffled."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard_rows(slim, "doc_id", root or tree())
    return number_slots(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, root: Node | None = None) -> None:
    """Writes whole documents into one folder per shard."""
    placed = shard_rows(docs, "doc_id", root or tree()).drop("grown_shard")
    placed.write.partitionBy("shard").parquet(path)

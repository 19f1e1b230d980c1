"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits are linked. A
fingerprint is cut into two segments, so that of two linked ones some segment
differs in at most one bit. Each segment is indexed once per bit with that bit
wiped out (a one-wildcard variant), variants meet in an equality join, and the
whole fingerprints are compared. Documents with one fingerprint are counted as
one before the search, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import Scratch, bounded_batches, releasing
from tapewatch.llm.components import connected

SEED = 42
SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 2
SEGMENT_BITS = 64 // SEGMENTS
CROWD = 64  # fingerprints that may share a segment before its variants get a finer key
CHUNK = 1 << 16  # shingle hashes counted at a time


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included. Only A-Z are
    lower-cased; words are split at ASCII white space."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends)
    )


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``fp``, the fingerprint as a
    signed long. Null and blank texts have fingerprint 0. No shuffle."""
    bounded_batches(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    columns = list(dict.fromkeys([*kept, text]))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text))
            prints = np.fromiter(
                (fingerprint(shingle_hashes(t.as_py() or "")) for t in texts), np.uint64, len(texts)
            )
            arrays = [batch.column(columns.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(prints.view(np.int64))], [*kept, "fp"])

    return docs.select(*columns).mapInArrow(releasing(compute), docs.select(*kept).schema.add("fp", "long"))


def _segment(s: int) -> Column:
    return F.shiftrightunsigned("fp", s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _wiped(s: int, value: Column) -> Column:
    """Array of (wildcard, value): a segment with each of its bits wiped out."""

    def one(j: Column) -> Column:
        kept = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))
        return F.struct((F.lit(s * SEGMENT_BITS) + j).alias("wildcard"), value.bitwiseAND(kept).alias("value"))

    return F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), one)


def _pieces(other: Column) -> Column:
    """Array of (piece, part): a segment cut into one piece more than the bits
    that may differ, one of which two linked fingerprints then share."""
    n = MAX_BITS + 1
    width = -(-SEGMENT_BITS // n)
    return F.array(*[
        F.struct(
            F.lit(i + 1).alias("piece"),
            F.shiftrightunsigned(other, i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("part"),
        )
        for i in range(n)
    ])


def variants(prints: DataFrame) -> DataFrame:
    """(wildcard, value, piece, part, fp): every segment of every fingerprint
    with one bit wiped out.

    Where more than CROWD fingerprints share a segment, its variants are keyed
    by a piece of the other segment as well, once per piece: linked
    fingerprints still meet, and a dense group does not become one bucket."""
    scratch = Scratch(prints.sparkSession)
    segments = F.array(*[F.struct(F.lit(s).alias("s"), _segment(s).alias("value")) for s in range(SEGMENTS)])
    crowded = (
        prints.select(F.explode(segments).alias("x"))
        .groupBy("x.s", "x.value")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > CROWD)
    )
    wiped = F.when(F.col("s") == 0, _wiped(0, F.col("value"))).otherwise(_wiped(1, F.col("value")))
    crowded = scratch.write(
        crowded.select(F.explode(wiped).alias("v")).select("v.*").distinct().withColumn("crowded", F.lit(True))
    )
    index = prints.select("fp", F.explode(F.concat(_wiped(0, _segment(0)), _wiped(1, _segment(1)))).alias("v"))
    index = index.select("v.wildcard", "v.value", "fp").join(crowded, ["wildcard", "value"], "left")
    other = F.when(F.col("wildcard") < SEGMENT_BITS, _segment(1)).otherwise(_segment(0))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).cast("long").alias("part")))
    keys = F.when(F.col("crowded"), _pieces(other)).otherwise(whole)
    return index.select("wildcard", "value", "fp", F.explode(keys).alias("k")).select(
        "wildcard", "value", "k.piece", "k.part", "fp"
    )


def links(prints: DataFrame) -> DataFrame:
    """All pairs (a, b), a below b, of the distinct fingerprints in ``prints``
    (column ``fp``) that differ in at most MAX_BITS bits."""
    index = variants(prints)
    left, right = index.alias("l"), index.alias("r")
    same = F.col("l.fp") < F.col("r.fp")
    for c in ("wildcard", "value", "piece", "part"):
        same &= F.col(f"l.{c}") == F.col(f"r.{c}")
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS
    # planned as a shuffle: the size of exploded rows is not known beforehand
    return left.hint("merge").join(right, same & near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id): documents joined by chains of linked
    fingerprints share the smallest key among them.

    Null and blank texts have fingerprint 0 and are linked like any other; a
    null key is no candidate for the component's. Repeated rows stay repeated
    rows of one component; further columns are ignored."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(with_fingerprints(docs, text, [key]))
    least = prints.groupBy("fp").agg(F.min(key).alias("_least"))
    roots = connected(scratch.write(links(prints.select("fp").distinct())))
    member = least.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root")
    )
    member = scratch.write(member)
    component = member.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of_print = scratch.write(member.join(component, "_root").select("fp", "component_id"))
    return prints.join(of_print, "fp").select(key, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", near=near_duplicates) -> DataFrame:
    """``docs`` with one document left of each component that ``near`` finds,
    that of the smallest key. Rows without a key cannot be named and stay. Of rows that repeat a
    kept key one stays. Texts move only if the list of dropped keys is too
    long to be broadcast."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(near(docs, text, key))
    dropped = scratch.write(found.filter(~F.col(key).eqNullSafe(F.col("component_id"))).select(key).distinct())
    repeated = found.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = scratch.write(repeated.filter(F.col(key).isNotNull()).select(key))
    kept = docs.join(dropped, key, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, key, "left_semi").dropDuplicates([key])
    return kept.join(repeated, key, "left_anti").unionByName(once)

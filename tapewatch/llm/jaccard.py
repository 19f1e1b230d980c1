"""Near-duplicates by the exact Jaccard similarity of word shingles.

Documents with the same set of shingles are counted as one. Sets whose SimHash
fingerprints are linked (``simhash.links``) are candidates first. Fingerprints
miss most pairs near 0.8, where about ten of 64 bits differ, too many to index;
so a set is also signed by BANDS keys of ROWS minima each, and sets that share a
key and are not connected yet are candidates too. Candidates are linked if the
exact similarity of their sets is high enough. At similarity 0.8 two sets share
no key with probability (1 - 0.8**ROWS)**BANDS, 5e-8.

A bucket of many sets is not paired off at once. Its first set (the pivot) is
compared with the others, which links a large group of near copies. Sets of
buckets that are not connected after that, such as texts around one common
passage, get finer keys without chance: of its shingles in one order for all,
those that many sets have last, a set takes so many that two similar sets must
have one of them in common. There, pivots are compared with what lies behind
them and is not connected to them, and their number grows until no bucket has a
pair left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tapewatch.llm import simhash
from tapewatch.llm.common import Scratch, bounded_batches, releasing
from tapewatch.llm.components import connected
from tapewatch.llm.decontam import CHUNK, ShingleHasher

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
LONGS = ArrayType(LongType())
MORE_PIVOTS = 8  # times as many in each round
PLACES = 1 << 25  # bits that say which keys are asked for
COUNTERS = 1 << 18  # cells of the shingle counts that order shingles
SPACE = (9, 10, 11, 12, 13, 32)  # words as in ``simhash``: ASCII white space, only A-Z lower-cased
_WORD = np.array([i not in SPACE for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_DRAWS = np.random.default_rng(20).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FLIP, _TIMES = _DRAWS[0], _DRAWS[1] | np.uint64(1)
_FOLD = np.random.default_rng(21).integers(0, 1 << 64, ROWS + 1, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sets(column: pa.Array, hasher: ShingleHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingle hashes, offsets) of the texts of a column, some at a time; the
    hashes of a text are sorted and distinct."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
        hashes, cuts = hasher(_LOWER[data[ends[at] : ends[upto]]], ends[at : upto + 1] - ends[at])
        owner = np.repeat(np.arange(upto - at), np.diff(cuts))
        order = np.lexsort((hashes, owner))
        hashes = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield hashes[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=upto - at))))
        at = upto


def _names(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A name for each set; 0 for the empty one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ _FOLD[ROWS]), dtype=np.uint64)))
    return _mix(sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64)


def band_keys(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Set by band: the keys of sets that are not empty."""
    out = np.zeros((len(cuts) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(cuts) - 1, band, np.uint64)
        for row in range(ROWS):
            k = band * ROWS + row
            least = np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], cuts[:-1]) if len(cuts) > 1 else key
            key = _mix(key * _FOLD[row] + least)
        out[:, band] = key
    return out.view(np.int64)


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, set, n, fp, keys) of every row; ``fp`` is the SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(SHINGLE, _WORD)
        for batch in batches:
            at = 0
            for hashes, cuts in _sets(batch.column(1), hasher):
                n = np.diff(cuts)
                full = np.flatnonzero(n)
                keys = band_keys(hashes, np.append(cuts[:-1][full], cuts[-1]))
                offsets = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
                texts = batch.column(1).slice(at, len(n))
                prints = (simhash.fingerprint(simhash.shingle_hashes(t.as_py() or "")) for t in texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(n)),
                        pa.array(_names(hashes, cuts)),
                        pa.array(n, pa.int64()),
                        pa.array(np.fromiter(prints, np.uint64, len(n)).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                    ],
                    [key, "set", "n", "fp", "keys"],
                )
                at += len(n)

    fields = docs.select(key).schema.add("set", "long").add("n", "long").add("fp", "long").add("keys", LONGS)
    return docs.select(key, text).mapInArrow(releasing(run), fields)


def _place(key: str) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(PLACES - 1))


def _places(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each of PLACES, set where a key of ``keys`` falls; at most
    PLACES / 64 rows come back."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    words = keys.select(_place(key).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found, out = words.toArrow(), np.zeros(PLACES >> 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _shingled(docs: DataFrame, asked: DataFrame, key: str, text: str) -> DataFrame:
    """(key, set, shingles) of the rows whose key is in ``asked``, and of a few
    others whose key falls where one of those does. Texts stay where they are,
    however many keys are asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(_places(asked, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(SHINGLE, _WORD)
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((sent.value[place >> 6] >> (place & 63)) & 1 == 1))
            at = 0
            for hashes, cuts in _sets(batch.column(1), hasher):
                n = len(cuts) - 1
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes.view(np.int64)))
                named = [batch.column(0).slice(at, n), pa.array(_names(hashes, cuts)), lists]
                yield pa.RecordBatch.from_arrays(named, [key, "set", "shingles"])
                at += n

    fields = docs.select(key).schema.add("set", "long").add("shingles", LONGS)
    return docs.select(key, text, _place(key).alias("place")).mapInArrow(releasing(run), fields)


def _counts(shingled: DataFrame) -> np.ndarray:
    """How many shingles fall into each of COUNTERS cells; one row per cell
    comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_cell(batch.column(0).flatten().to_numpy()), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    summed = shingled.select("shingles").mapInArrow(releasing(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found, out = summed.toArrow(), np.zeros(COUNTERS, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)


def first_shingles(shingles: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Of a set's shingles in the order of their counts so many that a set of
    similarity ``least`` has one of them among its own first ones."""
    n = len(shingles)
    shared = int(np.ceil(least * n - 1e-9))  # by two similar sets, at least
    return shingles[np.lexsort((shingles, counts[_cell(shingles)]))[: n - shared + 1]]


def _prefixed(shingled: DataFrame, least: float) -> DataFrame:
    """(set, n, keys) of the sets in ``shingled``."""
    sent = shingled.sparkSession.sparkContext.broadcast(_counts(shingled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            parts = [first_shingles(flat[a:b], sent.value, least) for a, b in zip(ends - ends[0], ends[1:] - ends[0])]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([flat[:0], *parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), keys], ["set", "n", "keys"])

    return shingled.select("set", "shingles").mapInArrow(releasing(run), "set long, n long, keys array<long>")


def _bucketed(sets: DataFrame) -> DataFrame:
    """(set, n, root, at, band_key, rank, m): the sets of every key that more
    than one set has, in order, and the key's place among those of the set."""
    bucket = Window.partitionBy("band_key")
    keyed = sets.select("set", "n", "root", F.posexplode("keys").alias("at", "band_key"))
    ranked = keyed.withColumn("rank", F.row_number().over(bucket.orderBy("set")) - 1)
    return ranked.withColumn("m", F.count("*").over(bucket)).filter("m > 1")


def _with_pivot(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, crowded): the first set of every band key with each of
    the others; ``crowded`` if there is more than one other."""
    bucket = Window.partitionBy("band_key")
    keyed = sets.select("set", "n", F.explode("keys").alias("band_key"))
    first = F.first(F.struct("set", "n")).over(bucket.orderBy("set"))
    met = keyed.withColumns({"first": first, "m": F.count("*").over(bucket)}).filter((F.col("m") > 1) & (F.col("set") != F.col("first.set")))
    return met.groupBy(F.col("first.set").alias("a"), F.col("set").alias("b")).agg(
        F.min("first.n").alias("n_a"), F.min("n").alias("n_b"), F.max(F.col("m") > 2).alias("crowded")
    )


def _with_print(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): the first set of every fingerprint with the others that
    have it, and the first sets of linked fingerprints."""
    scratch = Scratch(sets.sparkSession)
    prints = scratch.write(sets.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("first"), F.count("*").alias("m")))
    many = prints.filter("m > 1").select("fp", "first")
    same = sets.join(many, "fp").filter(F.col("set") != F.col("first.set")).select("first", F.struct("set", "n").alias("other"))
    a, b = (prints.select(F.col("fp").alias(c), F.col("first").alias(f)) for c, f in (("a", "first"), ("b", "other")))
    linked = simhash.links(prints.select("fp")).join(a, "a").join(b, "b").select("first", "other")
    return same.unionByName(linked).select(
        F.col("first.set").alias("a"), F.col("other.set").alias("b"), F.col("first.n").alias("n_a"), F.col("other.n").alias("n_b")
    )


def _stars(roots: DataFrame) -> DataFrame:
    """(a, b): what is connected already, in the fewest links. Later links are
    joined to these, which takes fewer rounds than all links from the start."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with the roots of both sets, ``root_a`` and ``root_b``."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").withColumns({f"root_{c}": F.coalesce(f"root_{c}", c) for c in "ab"})


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not connected."""
    return _rooted(pairs, roots).filter("root_a <> root_b").select(*pairs.columns)


def _not_connected(paired: DataFrame, roots: DataFrame) -> DataFrame:
    """(set, root): the sets around first sets that some of theirs are not
    connected to."""
    around = _rooted(paired.filter("crowded"), roots)
    split = around.filter("root_a <> root_b").select("a").distinct()
    of_both = F.array(*[F.struct(F.col(c).alias("set"), F.col(f"root_{c}").alias("root")) for c in "ab"])
    return around.join(split, "a", "left_semi").select(F.explode(of_both).alias("s")).select("s.*").distinct()


def _apart(ranked: DataFrame, roots: DataFrame, done: int) -> DataFrame:
    """The buckets that have sets behind the first ``done`` which are not all
    connected, with the roots of their sets."""
    bucket = Window.partitionBy("band_key")
    left = ranked.join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    left = left.filter(F.col("m") > done + 1).withColumn("root", F.coalesce("root", "set"))
    apart = F.min("root").over(bucket) != F.max("root").over(bucket)
    return left.withColumn("_apart", apart).filter("_apart").drop("_apart")


def _similar(pairs: DataFrame, shingled: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough."""
    x = shingled.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    y = shingled.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    both = pairs.join(x, "b").join(y, "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared / (F.size("x") + F.size("y") - shared) >= least).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """(key, set, component_id): documents joined by chains of pairs of
    similarity ``least`` or more share the smallest key among them.

    Null and blank texts are one empty set. Rows without a key are left out."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    named = docs.filter(F.col(key).isNotNull()).select(key, text)
    signed = scratch.write(_signed(named, key, text))
    sets = signed.groupBy("set").agg(F.min(key).alias("_least"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    sets = scratch.write(sets)
    enough = F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= least
    printed = scratch.write(_with_print(sets.filter("n > 0").select("set", "n", "fp")).filter(enough).select("a", "b"))
    paired = scratch.write(_with_pivot(sets))
    either = paired.select("a", "b").unionByName(printed).select(F.explode(F.array("a", "b")).alias("set")).distinct()
    met = scratch.write(either.join(sets.select("set", "_least"), "set").withColumnRenamed("_least", key))
    shingled = _shingled(named, met, key, text).join(met, [key, "set"], "left_semi")
    shingled = scratch.write(shingled.select("set", "shingles").dropDuplicates(["set"]))
    roots = scratch.write(connected(scratch.write(_similar(printed, shingled, least))))
    links = scratch.write(_similar(_open(paired, roots).filter(enough).select("a", "b"), shingled, least))
    roots = scratch.write(connected(_stars(roots).unionByName(links)))
    again = scratch.write(_not_connected(paired, roots))
    finer = _prefixed(scratch.write(shingled.join(again, "set", "left_semi")), least).join(again, "set")
    ranked = scratch.write(_apart(_bucketed(finer).drop("root"), roots, 0))
    done, pivots = 0, 1
    while not ranked.isEmpty():
        p, o = ranked.filter((F.col("rank") >= done) & (F.col("rank") < done + pivots)).alias("p"), ranked.alias("o")
        open_ = (F.col("p.band_key") == F.col("o.band_key")) & (F.col("p.rank") < F.col("o.rank"))
        open_ &= F.col("p.root") != F.col("o.root")
        open_ &= F.least("p.n", "o.n") / F.greatest("p.n", "o.n") >= least
        # the first shingle in common leaves enough behind it in both
        rest = F.least(F.col("p.n") - F.col("p.at"), F.col("o.n") - F.col("o.at"))
        open_ &= rest >= (F.col("p.n") + F.col("o.n")) * (least / (1 + least)) - 1e-6
        pairs = p.hint("merge").join(o, open_).select(F.col("p.set").alias("a"), F.col("o.set").alias("b")).distinct()
        links = scratch.write(_similar(pairs, shingled, least))
        roots = scratch.write(connected(_stars(roots).unionByName(links)))
        done, pivots = done + pivots, pivots * MORE_PIVOTS
        ranked = scratch.write(_apart(ranked.drop("root"), roots, done))
    member = sets.join(roots, F.col("set") == F.col("node"), "left").select(
        "set", "_least", F.coalesce("root", "set").alias("_root")
    )
    member = scratch.write(member)
    component = member.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of_set = scratch.write(member.join(component, "_root").select("set", "component_id"))
    return scratch.result(signed.select(key, "set").join(of_set, "set").select(key, "set", "component_id"))

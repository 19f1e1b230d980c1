"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is cut into word shingles and put in the partition of its size, the
next power of two. The partition fixes into how many bins the shingles' hash
values are dealt, two to four for each shingle, and the few least values of
each bin are the document's signature. As the bins grow with the size, a short
test item keeps the same chance of meeting the signature of a long document as
that of a short one: a bin has half a shingle at most on average and keeps
eight, so one shared shingle is missed with a probability below 10^-7, and an
item is missed only if all it shares are. Items whose shingles meet the
signature are candidates, whatever their size, and candidates are verified by
the exact share of the item's shingles that the document contains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import Scratch, bounded_batches, releasing

SHINGLE = 5
CONTAINMENT = 0.8
MINIMA = 8  # of each bin in a document's signature
FILTER_BITS = 20
BLOCK_BYTES = 8 << 20  # item texts searched in one pass over the documents
CHUNK = 1 << 21  # bytes hashed at a time
SEPARATORS = "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+"  # all ASCII but letters and digits
_SPLIT = re.compile(SEPARATORS)
_IS_WORD = np.array([bool(chr(i).isalnum()) or i >= 128 for i in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str, size: int = SHINGLE) -> set[str]:
    """The distinct word shingles of a lower-cased text; of one with fewer
    words, all of them as one."""
    words = [w for w in _SPLIT.split(text) if w]
    if not words:
        return set()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class ShingleHasher:
    """Hashes the shingles of texts that lie back to back in a buffer, by
    prefix sums over bytes instead of a loop over words."""

    def __init__(self, size: int = SHINGLE, word: np.ndarray = _IS_WORD):
        self.size = size
        self.word = word  # of each byte: is it part of a word?
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets into them) of the texts data[offsets[i]:offsets[i + 1]]."""
        n = len(data)
        self._powers(max(n, 1))
        texts = len(offsets) - 1
        word = self.word[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = offsets[:-1][offsets[:-1] < n]
        begins[inner] = word[inner]
        starts = np.flatnonzero(begins)
        stops_at = np.zeros(n + 1, bool)
        stops_at[1:][word] = True  # behind each word byte ...
        stops_at[:-1][word & ~begins] = False  # ... unless the word goes on
        stops = np.flatnonzero(stops_at)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        value = _mix((sums[stops] - sums[starts]) * self.inverse[starts])
        per_text = np.searchsorted(starts, offsets)
        words = np.diff(per_text)
        count = np.where(words > 0, np.maximum(words - self.size + 1, 1), 0)
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(texts), count)
        first = per_text[:-1][owner] + np.arange(len(owner)) - (ends - count)[owner]
        total = np.zeros(len(owner), np.uint64)
        for k in range(self.size):
            inside = first + k < per_text[1:][owner]
            at = np.minimum(first + k, max(len(value) - 1, 0))
            total = total * _STEP + np.where(inside, value[at] if len(value) else 0, np.uint64(0))
        return _mix(total), np.concatenate(([0], ends))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def partition(n: int) -> int:
    """The size partition of n shingles: the exponent of the next power of two."""
    return max(n - 1, 0).bit_length()


def signature(ordered: np.ndarray, bits: int) -> np.ndarray:
    """The MINIMA least values of each of 2**(bits + 1) bins of sorted, distinct
    hashes; the leading bits name the bin."""
    if len(ordered) <= MINIMA:
        return ordered
    bins = ordered >> np.uint64(63 - bits)
    return ordered[np.concatenate((np.ones(MINIMA, bool), bins[MINIMA:] != bins[:-MINIMA]))]


class ItemIndex:
    """The items of one block: their shingles, and all hashes of these in order
    with the item of each."""

    def __init__(self, items: list[tuple], least: float = CONTAINMENT):
        self.items = [(key, shingles(text)) for key, text in items]
        self.items = [x for x in self.items if x[1]]
        self.hashed = []
        self.least = least
        hasher = ShingleHasher()
        for _, text in items:
            raw = text.encode("utf-8")
            h, _ = hasher(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(h):
                self.hashed.append(np.unique(h))
        self.values, self.owner = _lookup(list(enumerate(self.hashed)))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.values >> np.uint64(64 - FILTER_BITS)] = True

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items that have a shingle among a document's signature, as far as
        the document has enough of the item's hashes."""
        own = np.unique(hashes)
        signed = signature(own, partition(len(own)))
        met = np.unique(_meet(signed[self.maybe[signed >> np.uint64(64 - FILTER_BITS)]], self.values, self.owner))
        enough = [_found(own, self.hashed[i]).sum() >= self.least * len(self.hashed[i]) for i in met]
        return met[np.array(enough, bool)]


def _lookup(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, sorted; item of each value)."""
    values = np.concatenate([np.zeros(0, np.uint64), *[v for _, v in parts]])
    owner = np.repeat(np.array([i for i, _ in parts], np.int64), [len(v) for _, v in parts])
    order = np.argsort(values, kind="stable")
    return values[order], owner[order]


def _meet(mine: np.ndarray, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Items that have one of the values ``mine``."""
    if not len(values) or not len(mine):
        return owner[:0]
    mine = np.unique(mine)
    low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
    return np.concatenate([owner[:0], *[owner[a:b] for a, b in zip(low, high) if a < b]])


def _found(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among the sorted values ``own``?"""
    return own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted


def _search(docs: DataFrame, items: list[tuple], key: str, item_key: str, types, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        index, hasher = ItemIndex(sent.value, least), ShingleHasher()
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            at, found = 0, []
            while at < len(column):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, side="right")) - 1)
                hashes, cuts = hasher(data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at])
                for i in np.flatnonzero(np.diff(cuts)):
                    items_met = index.candidates(hashes[cuts[i] : cuts[i + 1]])
                    if len(items_met):
                        own = shingles(column[int(at + i)].as_py())
                        for m in items_met:
                            name, wanted = index.items[m]
                            shared = len(wanted & own)
                            if shared >= least * len(wanted):
                                doc = batch.column(0)[int(at + i)].as_py()
                                found.append((doc, name, shared, len(wanted), shared / len(wanted)))
                at = upto
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], fields.names)

    from pyspark.sql.pandas.types import to_arrow_type

    fields = docs.select(key).schema.add(item_key, types).add("shared", "long").add("total", "long")
    fields = fields.add("containment", "double")
    arrow = [to_arrow_type(f.dataType) for f in fields]
    return docs.mapInArrow(releasing(run), fields)


def find_contaminated(
    docs: DataFrame,
    items: DataFrame,
    least: float = CONTAINMENT,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """(key, item_key, shared, total, containment) of every document that
    contains at least ``least`` of an item's shingles.

    Case and ASCII punctuation do not count. Null texts and texts without words
    contain and are contained in nothing; null keys are kept; repeated
    documents and repeated items give repeated rows; further columns are
    ignored; empty tables give no rows. Documents are read where they lie. The
    items are the stated query set: they are sent to the tasks in blocks of
    about BLOCK_BYTES of text, one pass over the documents per block."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    asked = items.filter(F.col(text).isNotNull()).select(item_key, F.lower(text).alias("_text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(item_key, "_text"), F.lit(blocks))
    passes = []
    for b in range(blocks):
        own = [tuple(r) for r in asked.filter(block == b).collect()]
        passes.append(_search(texts, own, key, item_key, items.schema[item_key].dataType, least))
    return reduce(DataFrame.unionByName, passes)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that contain an item. A row is named by its key
    and the CRC of its text, so that rows without a key or with a repeated one
    are decided one by one. The list of dropped names is written first; texts
    move only if it is too long to be broadcast."""
    scratch = Scratch(docs.sparkSession)
    name = F.struct(F.col(key).alias("key"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    found = find_contaminated(docs.select(name.alias("_row"), text), items, key="_row", text=text)
    dropped = scratch.write(found.select("_row.key", "_row.crc").distinct()).alias("_dropped")
    same = docs[key].eqNullSafe(F.col("_dropped.key")) & name["crc"].eqNullSafe(F.col("_dropped.crc"))
    return docs.join(dropped, same, "left_anti")

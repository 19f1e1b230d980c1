"""Source divergence audit: how far the word use of two sources lies apart.

1. A task counts the terms of its documents per (lang, source) and hands on
   partial counts; Spark adds them up. Terms in at least ``min_docs`` documents
   of their language are kept, each with its counts by source.
2. The vocabulary of a language is put in the order of these counts, so that
   equal ones lie together, and cut into blocks. In a block every source's
   column of counts is run-length encoded; what no run covers is a zero.
3. In a block the run boundaries of two sources are intersected, and the
   difference of their rates is multiplied by the run's length. Blocks are
   summed.

Rates are whole numbers per thousand million, from long division in 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewatch.llm.common import Scratch, bounded_batches

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
BLOCK = 1 << 12  # rows of the ordered vocabulary whose runs meet in one group
HELD_TERMS = 1 << 18  # counters of a task before they are handed on
HELD_BYTES = 1 << 24  # and bytes of their terms
PIECE = 1 << 20  # bytes of a text looked at at a time

# All bytes but those of letters and of characters beyond ASCII become spaces.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

COUNTS = "lang string, source string, term string, n long, docs long"
RUNS = "lang string, block long, source string, start long, length long, n long"
PARTS = "lang string, source string, item string, value long"


def pieces(text: bytes, separator: int = 0x20) -> Iterator[list[bytes]]:
    """The words of a text of separated words, about PIECE bytes at a time."""
    at, mark = 0, bytes([separator])
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(mark, end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Held:
    """Counts of a task that were not handed on yet."""

    def __init__(self):
        self.occurrences: dict[tuple[str, str], Counter] = {}
        self.documents: dict[tuple[str, str], Counter] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        group = (lang, source)
        occurrences = self.occurrences.setdefault(group, Counter())
        distinct: set[bytes] = set()
        for words in pieces(text.encode("utf-8").translate(_LETTERS)):
            occurrences.update(words)
            distinct.update(words)
        self.documents.setdefault(group, Counter()).update(distinct)

    def full(self) -> bool:
        if sum(map(len, self.occurrences.values())) > HELD_TERMS:
            return True
        return sum(len(t) for c in self.occurrences.values() for t in c) > HELD_BYTES

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in self.occurrences.items():
            docs = self.documents[lang, source]
            terms = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([counts[t] for t in terms], pa.int64()),
                    pa.array([docs[t] for t in terms], pa.int64()),
                ],
                schema=schema,
            )


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group of
    documents and the documents that have it. ``docs`` has text, lang, source
    without nulls."""
    schema = pa.schema(
        [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                held.add(lang.as_py(), source.as_py(), text.as_py())
            if held.full():
                yield from held.rows(schema)
                held = _Held()
        yield from held.rows(schema)

    partial = docs.select("lang", "source", "text").mapInArrow(count, COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, counts): terms in enough documents of their language with
    their counts by source, one entry for each source that has the term."""
    by_source = F.sort_array(F.collect_list(F.struct("source", "n")))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), by_source.alias("counts"))
    return terms.filter(F.col("docs") >= min_docs).select("lang", "term", "counts")


def rate(n: str, total: str = "total") -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) in two steps of long
    division: no product leaves 64 bits while totals stay below 9 x 10^13;
    beyond, ANSI mode fails rather than return a wrong number. 0 for an empty
    vocabulary."""
    high, size = f"(({n} + {SMOOTHING}L) * 100000L)", f"({total} + {SMOOTHING}L * terms)"
    exact = f"1L + ({high} div {size}) * 10000L + (({high} % {size}) * 10000L) div {size}"
    return F.expr(f"CASE WHEN terms > 0 THEN {exact} ELSE 0L END")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms) of every group that occurs."""
    entries = kept.select("lang", F.explode("counts").alias("e")).groupBy("lang", F.col("e.source").alias("source"))
    groups = docs.select("lang", "source").distinct().join(entries.agg(F.sum("e.n").alias("total")), ["lang", "source"], "left")
    occurrences = F.aggregate("counts", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(occurrences).alias("lang_total"))
    zero = {"total": 0, "lang_total": 0, "terms": 0}
    return groups.join(langs, "lang", "left").na.fill(zero).select("lang", "source", "total", "lang_total", "terms")


def ordered_runs(kept: DataFrame) -> DataFrame:
    """(lang, block, source, start, length, n): the run-length encoded columns.

    Terms with the same counts are one row with a multiplicity; rows are
    ordered by their counts and cut into blocks of at most BLOCK. A run says
    that ``length`` terms from ``start`` on have ``n`` occurrences in the
    source; places without a run have none. A row with a null source has the
    length of its block."""
    vectors = kept.groupBy("lang", "counts").agg(F.count("*").alias("terms"))
    # ranges go by the first counts alone: their bounds are sampled to the driver
    head = [F.get("counts", F.lit(i))[c] for i in range(3) for c in ("source", "n")]
    ordered = vectors.repartitionByRange("lang", *head).sortWithinPartitions("lang", "counts")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, at, lang = TaskContext.get().partitionId() << 32, 0, 0, None
        open_runs: dict[str, list[int]] = {}  # source: start, end, n
        out: list[tuple] = []

        def close() -> None:
            out.extend((lang, block, s, a, b - a, n) for s, (a, b, n) in open_runs.items())
            if rows:
                out.append((lang, block, None, 0, at, 0))
            open_runs.clear()

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3))
            for here, counts, terms in zip(*columns):
                if here != lang or rows == BLOCK:
                    close()
                    block, rows, at, lang = block + 1, 0, 0, here
                for entry in counts:
                    source, n = entry["source"], entry["n"]
                    run = open_runs.get(source)
                    if run is not None and run[1] == at and run[2] == n:
                        run[1] = at + terms
                        continue
                    if run is not None:
                        out.append((lang, block, source, run[0], run[1] - run[0], run[2]))
                    open_runs[source] = [at, at + terms, n]
                at, rows = at + terms, rows + 1
            if out:
                yield _batch(out, RUN_TYPES)
                out.clear()
        close()
        yield _batch(out, RUN_TYPES)

    return ordered.select("lang", "counts", "terms").mapInArrow(encode, RUNS)


RUN_TYPES = pa.schema(
    [("lang", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("n", pa.int64())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def source_column(size: int, zero: int, start: np.ndarray, length: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, rates): the runs of one source with the gaps filled by the
    rate of a term it does not have."""
    order = np.argsort(start)
    start, stop, p = start[order], (start + length)[order], p[order]
    at = np.concatenate(([0], np.stack((start, stop), 1).ravel()))
    rates = np.concatenate(([zero], np.stack((p, np.full_like(p, zero)), 1).ravel()))
    wide = np.diff(np.append(at, size)) > 0
    return at[wide], rates[wide]


def intersect(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum over all places of the difference between two columns."""
    bounds = np.union1d(a[0], b[0])
    left = a[1][np.searchsorted(a[0], bounds, "right") - 1]
    right = b[1][np.searchsorted(b[0], bounds, "right") - 1]
    return int((np.abs(left - right) * np.diff(np.append(bounds, size))).sum())


def _pair_sums(group: pd.DataFrame) -> pd.DataFrame:
    head, runs = group[group["start"] < 0], group[group["start"] >= 0]
    size, lang = int(head["length"].iloc[0]), head["lang"].iloc[0]
    own = dict(list(runs.groupby("source", sort=False)))
    columns = {}
    for source, zero in zip(head["source"], head["p"]):
        mine = own.get(source, runs[:0])
        columns[source] = source_column(size, zero, *(mine[c].to_numpy(np.int64) for c in ("start", "length", "p")))
    names = sorted(columns)
    found = [
        (names[i], names[j], intersect(columns[names[i]], columns[names[j]], size))
        for i in range(len(names))
        for j in range(i + 1, len(names))
    ]
    both = found + [(b, a, f) for a, b, f in found]
    table = pd.DataFrame(both, columns=["source", "item", "value"])
    table.insert(0, "lang", lang)
    return table.astype({"value": "int64"})


def pair_divergence(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of rates for every
    ordered pair of sources of a language."""
    known = runs.filter("source IS NOT NULL").join(totals, ["lang", "source"])
    columns = ("lang", "block", "source", "start", "length")
    known = known.select(*columns, rate("n").alias("p"))
    # every source of the language in every block, with the rate of a term it lacks
    heads = runs.filter("source IS NULL").select("lang", "block", "length").join(totals, "lang")
    heads = heads.select("lang", "block", "source", F.lit(-1).cast("long").alias("start"), "length", rate("0L").alias("p"))
    sums = known.unionByName(heads).groupBy("lang", "block").applyInPandas(_pair_sums, PARTS)
    empty = totals.filter("terms = 0").select("lang", "source")
    others = empty.select("lang", F.col("source").alias("item"))
    silent = empty.join(others, "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    return sums.unionByName(silent).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(kept: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): terms that a source uses more often
    than its language does, at most ``top`` for each source."""
    everywhere = F.aggregate("counts", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    rows = kept.select("lang", F.col("term").alias("item"), everywhere.alias("n_lang"), F.explode("counts").alias("e"))
    rows = rows.select("lang", "item", "n_lang", "e.source", "e.n").join(totals, ["lang", "source"])
    value = (rate("n") - rate("n_lang", "lang_total")).alias("value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = rows.select("lang", "source", "item", value).filter("value > 0")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of documents.

    Part ``pair`` has the divergence from each other source of the language,
    all ranks; part ``term`` the ``top`` terms by which a source stands out
    from its language. Ranks run from 1 by falling value and then by item.

    Null text, lang or source counts as the empty string. Groups without terms
    have pairs (0 where the language keeps no term); a language with one source
    has none. Repeated rows are documents of their own, long texts are taken
    piece by piece, further columns are ignored, an empty table gives no rows.
    The pairs are as many as the result has rows; blocks and sums hold a
    language's sources, not its documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = scratch.write(kept_terms(count_terms(docs), min_docs))
    totals = scratch.write(group_totals(docs, kept))
    runs = scratch.write(ordered_runs(kept))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(runs, totals).withColumn("rank", F.row_number().over(best))
    terms = term_divergence(kept, totals, top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    parts = [f.withColumn("part", F.lit(part)).select(*columns) for f, part in ((pairs, "pair"), (terms, "term"))]
    result = scratch.write(parts[0].unionByName(parts[1]))
    scratch.drop(kept, totals, runs)
    return result

"""The corpus pipeline: language ID, near-duplicates, repeated strings,
benchmark decontamination, packing.

A stage gets the documents that the one before it kept, as read back from
Parquet, and all but the last return the columns of ``documents``.
``run`` applies them in order and keeps what lies between stages in the shared
checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import decontam, jaccard, langid, packing, repeats, simhash
from tapewatch.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_BYTES = 1  # a document that repeats others whole is gone

# Stages learn, search and order by hashes; no SQL says what they keep.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without
    letters. ``lang`` is filled in where it was null."""
    model = langid.train(docs)
    known = langid.identify(docs.select(*COLUMNS), model)
    kept = known.filter(langid.has_letter(F.col("text")) if model is None else F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates:
    candidates by SimHash fingerprints, then by MinHash keys, and an exact check
    of five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, near=jaccard.near_duplicates).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that an earlier document has from the texts; documents of
    which nothing is left are dropped. ``n_chars`` counts what is left."""
    cut = repeats.remove_repeats(docs.select(*COLUMNS), kept_text=True)
    kept = cut.filter((F.col("n_removed") == 0) | (F.octet_length("text") >= LEAST_BYTES))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows of tokens: one row per piece with its ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs

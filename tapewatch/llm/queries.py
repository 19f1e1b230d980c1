"""Registered queries of this package and their SQL.

Each applies one operator to its whole table and derives the digest columns
from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import chat, decontam, divergence, langid, licenses, packing, repeats, shards, simhash, topk, url_filter, warc, whitening
from tapewatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return register


# --- 7 sharding --------------------------------------------------------------

CRC_SQL = """
    crc_table AS (
        SELECT list(crc ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc
            FROM range(256) r(i))
    )"""


def _draw_sql(node: str, weight: float) -> str:
    return f"(-ln((('0x' || substr(md5(key || '|{node}'), 1, 8))::BIGINT + 0.5) / 4294967296.0) / {float(weight)})"


def _place_sql(node: shards.Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _place_sql(node.children[0])
    draws = [_draw_sql(c.name, c.weight) for c in node.children]
    least = f"least({', '.join(draws)})"
    cases = " ".join(f"WHEN {d} = {least} THEN {_place_sql(c)}" for d, c in zip(draws, node.children))
    return f"(CASE {cases} END)"


OP7_SQL = f"""
WITH {CRC_SQL},
    d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS key FROM documents),
    s AS (
        SELECT doc_id, strlen(text) + 1 AS size,
            xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)),
                lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
                lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS text_crc32,
            'key' AS law,
            {_place_sql(shards.tree())}::INTEGER AS shard,
            {_place_sql(shards.grow(shards.tree()))}::INTEGER AS grown_shard
        FROM d, crc_table)
SELECT doc_id, size, text_crc32, law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM s
"""


@query("op7_hash_tree_shards", OP7_SQL)
def hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_documents(table(spark, folder, "documents"))


# --- 8 chat formatting -------------------------------------------------------

PROBE = "\\### Assistant: </turn> ok"

OP8_SQL = """
WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL
        SELECT * FROM (VALUES
            (-7, 0, 'user', '\\### Assistant: </turn> ok'),
            (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
    w AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
            replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '#', '\\h') AS safe,
            replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c') AS safe_role
        FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(safe) + CASE WHEN before = role THEN length('<sep/>')
        ELSE length('### ' || safe_role || ':' || chr(10) || '</turn>' || chr(10)) END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""


@query("op8_chat_format", OP8_SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    return chat.conversation_digest(chat.format_conversations(turns.unionByName(probe)))


# --- 9 WARC ------------------------------------------------------------------

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN strlen(html) >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(html) >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


@query("op9_warc_round_trip", OP9_SQL)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --- 6 language ID -----------------------------------------------------------


@query("op6_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


# --- 2 SimHash near-duplicates -----------------------------------------------


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- 5 packing ---------------------------------------------------------------


@query("op5_window_packing")
def window_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer, with_ids=False)


# --- 3 URL filters -----------------------------------------------------------


@query("op3_url_filter")
def url_filter_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


# --- 4 exact top-k search ----------------------------------------------------

OP4_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    d AS (
        SELECT q.vec_id AS query_id, r.vec_id,
            len(list_filter(list_zip(q.code, r.code), lambda x: x[1] <> x[2])) AS distance
        FROM c q, c r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance::INTEGER AS distance FROM n WHERE rank <= 10
"""


@query("op4_hamming_top_k", OP4_SQL)
def hamming_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=10)


# --- 1 benchmark decontamination ---------------------------------------------


def shingle_sql(source: str, key: str) -> str:
    """Distinct five-word shingles of a table, as the operator cuts them."""
    return f"""
        SELECT DISTINCT {key}, unnest(list_transform(range(greatest(len(w) - 4, 1)),
            lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s
        FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '{decontam.SEPARATORS}'),
            lambda x: x <> '') AS w FROM {source} WHERE text IS NOT NULL) WHERE len(w) > 0"""


OP1_SQL = f"""
WITH i AS ({shingle_sql('benchmark', 'item_id')}),
    d AS ({shingle_sql('documents', 'doc_id')}),
    n AS (SELECT item_id, count(*) AS total FROM i GROUP BY item_id),
    m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, total, shared / total AS containment
FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * total
"""


@query("op1_benchmark_decontamination", OP1_SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# --- 10 repeated strings -----------------------------------------------------


@query("op10_repeated_strings")
def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"))


# --- the pipeline ------------------------------------------------------------


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


# --- 11 source divergence ----------------------------------------------------

OP11_SQL = r"""
WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
            coalesce(source, '') AS source FROM documents),
    w AS (
        SELECT lang, source, row, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
    c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
    t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
    f AS (
        SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
            1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
        FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source)
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    l AS (
        SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) //
            (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
        FROM c JOIN v USING (lang) GROUP BY lang, term),
    pair AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
            coalesce((SELECT sum(abs(x.p - y.p)) FROM f x JOIN f y USING (lang, term)
                WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    both_parts AS (
        SELECT * FROM pair UNION ALL
        SELECT lang, source, 'term', term, p - q FROM f JOIN l USING (lang, term) WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", OP11_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit_sources(table(spark, folder, "documents"))


# --- 12 license scans --------------------------------------------------------


def _places_sql(phrase: str) -> str:
    same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1))
    return f"list_filter(range(len(w)), lambda i: {same})"


def _labels_sql(labels: str) -> str:
    return f"array_to_string(list_sort(list_distinct({labels})), ',')"


OP12_SQL = f"""
WITH t AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
    p AS (
        SELECT doc_id, len(w) AS n_words,
            [{', '.join(f"{{'label': '{label}', 'at': {_places_sql(p)}}}" for p, label in licenses.PHRASES.items())}] AS found,
            ' ' || array_to_string(w, ' ') || ' ' AS line
        FROM t),
    q AS (
        SELECT doc_id, n_words, flatten(list_transform(found, lambda f: f.at)) AS starts,
            list_transform(list_filter(found, lambda f: len(f.at) > 0), lambda f: f.label) AS base,
            list_filter([{', '.join(f"CASE WHEN regexp_matches(line, ' {licenses.pattern(licenses.parse(t))}') THEN '{label}' END" for label, t in licenses.TEMPLATES.items())}],
                lambda x: x IS NOT NULL) AS more
        FROM p)
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
    {_labels_sql('base')} AS base_labels, {_labels_sql('list_concat(base, more)')} AS labels,
    CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM q
"""


@query("op12_license_scan", OP12_SQL)
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


# --- 13 embedding whitening --------------------------------------------------


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))

"""URL filter, top-k search, sharding, WARC, pipeline and registered queries."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from check_oracles import compare
from tapewatch.llm import shards, topk, url_filter, warc
from tapewatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


def test_rules_and_verdicts(spark):
    urls = [None, "", "no scheme.com/", "http://", "http://COM/", "https://www.Example.com/en/1?x#y", "ftp://a.example.com/en/",
            "http://example.com", "http://example.com?x=/en/", "http://xexample.com/en/", "a://b://c.net/fr/", "http://É.net/es/?",
            "http://www.example.com/enx", "http://a.b.www.example.com/en/#f", "x://n.org/" + "é%&=" * 20_000]
    urls += [f"http://h{i}.example.{'com' if i % 3 else 'net'}/{'en' if i % 2 else 'fr'}/{i}" for i in range(200)] + urls[:6]
    rows = [(i if i % 50 else None, u, "x", "y") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages).collect()
    by_url = {r.url: r for r in got}
    assert len(got) == len(rows)
    for u in urls:
        host, path, rule, verdict = judged(u)
        r = by_url[u]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.filter("url like 'http://h%'").limit(1)).collect()} <= {"allow", "block"}


def test_trees_judge_held_out_labelled_urls(spark):
    pages = url_filter.with_rule(url_filter.with_parts(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")))
    model = url_filter.train(pages.filter("page_id % 3 <> 0"))
    rest = url_filter.with_lexical(pages.filter("page_id % 3 = 0 AND rule IS NOT NULL"))
    rows = url_filter.with_suffixes(rest, model.suffixes, model.prior).select("rule_verdict", model.margin().alias("m")).collect()
    assert len(rows) > 200 and np.mean([(r.m > 0) == (r.rule_verdict == "block") for r in rows]) >= 0.95


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 40))
    vectors[50:90] = vectors[3]  # copies, and a cluster around one vector
    vectors[90:120] = vectors[4] + rng.normal(size=(30, 40)) * 0.3
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(900, None, "x"), (None, [1.0], "x"), (3, vectors[3].tolist(), "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = topk.top_k(frame, frame.filter("vec_id % 25 = 0 OR vec_id < 6"), k=7, bits=40).collect()
    code = vectors > 0
    want = []
    for q in [i for i in range(300) if i % 25 == 0 or i < 6]:
        near = sorted((int((code[q] != code[i]).sum()), i) for i in range(300) if i != q)[:7]
        want += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    few = frame.filter("vec_id < 4")
    assert topk.top_k(few, few, k=7, bits=40).count() == 12
    assert topk.top_k(frame.limit(0), few, k=7, bits=40).count() == 0 == topk.top_k(few, frame.limit(0), bits=40).count()


def test_growth_moves_rows_into_the_new_shard_only(spark):
    rows = spark.range(20_000).selectExpr("nullif(id, -1) AS doc_id", "nullif('t', '') AS text", "1 AS shard", "2 AS slot")
    odd = spark.createDataFrame([(None, None, 1, 2)] * 2 + [(0, "t", 1, 2)] * 3, rows.schema)
    got = shards.shard_documents(rows.unionByName(odd)).collect()
    assert {r.shard for r in got} == set(range(16))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {16} and abs(len(moved) / len(got) - 1 / 17) < 0.01
    counts = np.bincount([r.shard for r in got])
    assert counts.min() > 0.85 * len(got) / 16
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all((r.size, r.text_crc32) == ((1, 0) if r.doc_id is None else (2, zlib.crc32(b"t"))) for r in got)
    assert shards.shard_documents(rows.limit(0)).count() == 0


def test_weights_and_subtrees(spark):
    light, heavy = shards.Node("s0", shard=0, own_weight=1.0), shards.Node("s1", shard=1, own_weight=3.0)
    rack = shards.Node("k", (light, heavy))
    other = shards.Node("j", (shards.Node("s2", shard=2, own_weight=4.0),))
    root = shards.Node("root", (rack, other))
    rows = shards.shard_rows(spark.range(20_000), "id", root).collect()
    share = np.bincount([r.shard for r in rows]) / len(rows)
    assert np.allclose(share, [1 / 8, 3 / 8, 1 / 2], atol=0.015)


def test_warc_round_trip_in_tiny_ranges(spark, monkeypatch):
    rng = random.Random(3)
    bodies = ["".join(rng.choice("abé<> \r\n") for _ in range(n)) for n in (0, 5, 999, 1000, 4000, 4000)]
    bodies.append("".join(chr(rng.randrange(32, 0x2000)) for _ in range(300_000)))
    rows = [(i, f"http://x/{i}\r\n%0A é", bodies[i % len(bodies)], "z") for i in range(40)]
    rows += [(50, None, None, "z"), (None, "u", bodies[4], "z"), (39, "again", bodies[4], "z"), (7, "again", bodies[4], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    archives = warc.write_archives(pages, warc.new_folder(spark, "warc"))
    listed = archives.collect()
    for a in listed:
        raw = open(a.path.removeprefix("file:"), "rb").read()
        assert len(raw) == a.bytes and gzip.decompress(raw).startswith(b"WARC/1.1")
    for range_bytes in (777, 50_000, 1 << 23):
        got = warc.read_archives(archives, range_bytes).collect()
        assert sorted((str(r.page_id), r.url or "") for r in got) == sorted((str(i), u or "") for i, u, _, _ in rows)
    assert len({(r.archive, r["at"]) for r in got}) == len(rows)
    largest = {}
    for i, _, h, _ in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    texts = {(i, u): h or "" for i, u, h, _ in rows}
    for r in got:
        h = texts[(r.page_id, r.url)]
        raw = h.encode()
        again = len(raw) >= 1000 and r.page_id != largest[h]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", largest[h]) if again else ("response", None))
        assert again or bytes(r.payload) == raw
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", [*ORACLES])
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(QUERIES) <= set(names) and set(ORACLES) <= set(entry.oracle_sql())


def test_pipeline_stages_keep_and_drop_what_they_should(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    plain = docs.first()
    rows = [(5000, "1234 !!"), (5001, None), (5002, plain.text), (5003, "fresh words before it " + item), (None, "a text without id")]
    docs = docs.select(*c.COLUMNS).unionByName(spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], docs.select(*c.COLUMNS).schema))
    sizes, left = [docs.count()], {}
    for name, stage in c.STAGES:
        docs = c.Scratch(spark).write(stage(spark, docs, SF))
        left[name] = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert name == "packing" or docs.columns == c.COLUMNS
        sizes.append(docs.count())
    assert not left["language_id"] & {5000, 5001} and sizes[1] == sizes[0] - 2
    assert 5002 not in left["near_duplicates"] and 5003 in left["repeated_strings"] and 5003 not in left["decontamination"]
    assert left["packing"] == left["decontamination"] and None in left["packing"]


def test_trees_against_boosting_in_plain_python(spark):
    rng = random.Random(11)
    urls = []
    for i in range(260):
        host = rng.choice(["example.com", "www.example.com", "a.net", "b-c.net", "shop.example.com"])
        path = "/".join(rng.choice(["en", "es", "fr", "x1", "item", "A9"]) for _ in range(rng.randrange(1, 5)))
        urls.append((i, f"http://{host}/{path}/{rng.randrange(10**rng.randrange(1, 7))}" + rng.choice(["", "?a=1&b=2", "#f"])))
    ruled = url_filter.with_rule(url_filter.with_parts(spark.createDataFrame(urls, "page_id long, url string")))
    model = url_filter.train(ruled)
    labelled = url_filter.with_lexical(ruled.filter("rule_verdict IS NOT NULL"))
    frame = url_filter.with_suffixes(labelled, model.suffixes, model.prior)
    from pyspark.sql import functions as F

    cuts = [(i + 1) / url_filter.BINS for i in range(url_filter.BINS - 1)]
    edges = {f: sorted(set(v)) for f, v in frame.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in url_filter.FEATURES]).first().asDict().items()}
    rows = frame.collect()
    y = np.array([r.rule_verdict == "block" for r in rows], float)
    assert 20 < y.sum() < len(y) - 20 and model.prior == (y.sum() + 1) / (len(y) + 2)
    for name in ("tld", "domain", "section"):  # suffix statistics by counting
        for r in rows:
            own = np.array([q[name] == r[name] for q in rows])
            rate = (y[own].sum() + url_filter.SUFFIX_PRIOR * model.prior) / (own.sum() + url_filter.SUFFIX_PRIOR)
            assert r[f"{name}_rate"] == pytest.approx(rate) and r[f"{name}_count"] == pytest.approx(np.log1p(own.sum()))
    x = {f: np.array([r[f] for r in rows]) for f in url_filter.FEATURES}
    margin = np.full(len(y), np.log(model.prior / (1 - model.prior)))
    smooth = url_filter.SMOOTH
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h, seen, todo, step = y - p, p * (1 - p), {}, [(1, np.ones(len(y), bool), 0)], np.zeros(len(y))
        while todo:
            node, inside, depth = todo.pop()
            best = (1e-6, None, None)
            for f in url_filter.FEATURES:
                for e in edges[f]:
                    left, right = inside & (x[f] <= e), inside & (x[f] > e)
                    if left.any() and right.any():
                        gain = sum(s * g[m].sum() ** 2 / (h[m].sum() + smooth) for s, m in ((1, left), (1, right), (-1, inside)))
                        if round(gain, 6) > best[0]:
                            best = (round(gain, 6), f, e)
            if best[1] is None or depth == url_filter.DEPTH:
                seen[node] = url_filter.RATE * g[inside].sum() / (h[inside].sum() + smooth)
                step[inside] = seen[node]
            else:
                seen[node] = best[1:]
                todo += [(2 * node, inside & (x[best[1]] <= best[2]), depth + 1), (2 * node + 1, inside & (x[best[1]] > best[2]), depth + 1)]
        assert set(tree) == set(seen)
        for node, what in tree.items():
            if what[0] == "leaf":
                assert what[1] == pytest.approx(seen[node], abs=1e-6)
            else:
                # an edge between the same two values splits alike
                assert what[1] == seen[node][0] and ((x[what[1]] <= what[2]) == (x[what[1]] <= seen[node][1])).all()
        margin += step
    got = {r.page_id: r.m for r in frame.select("page_id", model.margin().alias("m")).collect()}
    assert [got[r.page_id] for r in rows] == pytest.approx(margin.tolist(), abs=1e-6)

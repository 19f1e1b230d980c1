"""Source divergence against a dictionary count and plain integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tapewatch.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def plain(rows, min_docs, top):
    lower = {i: i + 32 for i in range(65, 91)}
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = TERM.findall((text or "").translate(lower))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def rates(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: rates(counts[lang, s]) for s in sources}
        q = rates(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i) for i, (v, o) in enumerate(found, 1) if part == "pair" or i <= top]
    return out


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "straße", "日本語", "İ", "Kelvin"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", None, "fr"])
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "é", "z"])
        text = " ".join(rng.choice(words[: 20 + 15 * (i % 6)]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice([text, text.upper(), text.replace(" ", "1-")]), lang, source))
    rows += [(None, "en", "silent"), ("", None, "silent"), ("12 34 !?", "xx", "one"), ("12", "xx", "two"), ("rare", "yy", "only")]
    rows += [("same same", "en", "copies")] * 40 + [("long " * 300_000 + "end", "en", "a")]
    return rows


def test_audit_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    monkeypatch.setattr(divergence, "PIECE", 1000)
    rows = corpus(400)
    docs = spark.createDataFrame([(i if i % 9 else None, *r, i, "x") for i, r in enumerate(rows)], SCHEMA).repartition(6)
    got = [tuple(r) for r in divergence.audit_sources(docs, min_docs=12, top=9).collect()]
    assert sorted(got) == sorted(plain(rows, 12, 9))
    silent = [r for r in got if r[:3] == ("xx", "one", "pair")]
    assert silent == [("xx", "one", "pair", "two", 0, 1)] and not [r for r in got if r[0] == "yy"]


def test_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_cover_the_columns(spark):
    kept = spark.createDataFrame(
        [("en", f"t{i}", [(s, 1 + i % 3) for s in ("a", "b") if (i + len(s)) % 4]) for i in range(40)],
        "lang string, term string, counts array<struct<source:string,n:long>>",
    )
    runs = divergence.ordered_runs(kept).collect()
    assert sum(r.length for r in runs if r.source is None) == 40
    assert sum(r.length * r.n for r in runs if r.source == "a") == sum(e[1] for r in kept.collect() for e in r.counts if e[0] == "a")
    assert len([r for r in runs if r.source == "a"]) < 10  # equal counts lie together


def test_intersection_of_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(1, 40))
        dense, columns = [], []
        for zero in (3, 5):
            n = rng.integers(0, 4, size)
            cut = np.flatnonzero(np.diff(n, prepend=-1))
            length = np.diff(np.append(cut, size))
            some = n[cut] > 0
            columns.append(divergence.source_column(size, zero, cut[some], length[some], 10 * n[cut][some]))
            dense.append(np.where(n > 0, 10 * n, zero))
        assert divergence.intersect(*columns, size) == int(np.abs(dense[0] - dense[1]).sum())


def test_rates_stay_exact_for_large_counts(spark):
    row = spark.createDataFrame([(7 * 10**12 + 3, 8 * 10**13 + 1, 10**7)], "n long, total long, terms long")
    n, total, terms = row.first()
    assert row.select(divergence.rate("n")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)

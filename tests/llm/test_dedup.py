"""SimHash near-duplicates, components and repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tapewatch.llm import jaccard, repeats, simhash
from tapewatch.llm.components import connected

DOCS = "doc_id long, text string, fp string, component_id string"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    cut = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in cut]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    root = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_fingerprints_match_the_definition():
    rng = random.Random(2)
    words = ["Éa", "b", "C\u00a0d", "x" * 40, "e"]
    for n in (0, 1, 2, 3, 4, 70):
        text = "\t".join(rng.choice(words) for _ in range(n)) + " \n"
        assert simhash.fingerprint(simhash.shingle_hashes(text)) == fingerprint(text)


def test_links_are_all_pairs_within_two_bits(spark, monkeypatch):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(20)}
    base = rng.getrandbits(64)
    for _ in range(150):  # a dense group: many share a whole segment
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    for crowd in (64, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_duplicates_with_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(3000))
    texts = [base, base + " end", base.upper(), None, "", " \n", "one", "two words", "a b c d", "x" * 200_000, None]
    rows = [(10 + i, t, "no", "no") for i, t in enumerate(texts)] + [(None, base, "no", "no"), (10, base, "no", "no")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    prints = [fingerprint(t) for _, t, _, _ in rows]
    linked = [(a, b) for a in set(prints) for b in set(prints) if bin(a ^ b).count("1") <= 2]
    root = components(set(prints), linked)
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((str(i), p, least[root[p]]) for (i, *_), p in zip(rows, prints))
    assert sorted((str(r[0]), r[1] & (2**64 - 1), r[2]) for r in found) == want
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 1
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "component_id"}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(50)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "loops": [(3, 3), (3, 4), (4, 3), (4, 4)],
        "none": [],
    }[kind]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for e in links for x in e}, links)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in links)}


def removed(rows):
    """id -> (bytes, removed, runs, digest) for rows of one id each."""
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - 49):
            first[raw[j : j + 50]] = min(first.get(raw[j : j + 50], i), i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 49):
            if first[raw[j : j + 50]] < i:
                gone[j : j + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeated_docs(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.choice([30, 49, 50, 51, 80, 300]))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else str(rng.getrandbits(200)) for _ in range(rng.randrange(6))]
        rows.append((i * 3 - 20, "".join(parts)))
    rows += [(900, "z" * 3000), (901, "y" + "z" * 120), (902, None), (903, ""), (904, rows[7][1]), (905, "ab" * 200), (906, "ba" * 90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, monkeypatch, seed):
    rows = repeated_docs(seed)
    monkeypatch.setattr(repeats, "RUN", 40)  # many packed blocks, so that tasks have to agree
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "LONG", 400)  # long texts come in pieces
    monkeypatch.setattr(repeats, "BUCKET", 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()}
    assert got == removed(rows)


def test_a_hot_anchor_is_no_group(spark, monkeypatch):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, f"{rng.getrandbits(300):x}" + passage[i % 3 :] + f"{rng.getrandbits(300):x}") for i in range(150)]
    rows += [(i + 1000, t) for i, t in repeated_docs(3)]
    ordered = repeats._order_bucket

    def watched(group):
        anchors = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in group.column("anchors")])
        assert np.unique(anchors, return_counts=True)[1].max() <= 20
        return ordered(group)

    monkeypatch.setattr(repeats, "HOT", 20, raising=False)
    monkeypatch.setattr(repeats, "_order_bucket", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()}
    assert got == removed(rows)


def test_repeats_of_null_and_repeated_ids(spark):
    text = "".join(random.Random(6).choice("abcdef") for _ in range(200))
    rows = [(None, text), (5, text), (5, text), (5, "other" + text[:60]), (7, text), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int")
    got = sorted((str(r.doc_id), r.n_removed, r.text or "") for r in repeats.remove_repeats(docs, kept_text=True).collect())
    assert got == sorted([
        ("None", 0, text), ("5", 0, text), ("5", 0, text), ("5", 0, "other" + text[:60]), ("7", 200, ""), ("None", 0, ""),
    ])
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_column_wise_order_is_the_suffix_array():
    rng = random.Random(7)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        offsets = np.cumsum([0] + [len(s) for s in strings])
        who, length, prefix = repeats.collection_order(np.frombuffer(b"".join(strings), np.uint8), offsets)
        found = [strings[w][len(strings[w]) - n :] for w, n in zip(who, length)]
        assert found == sorted(found) and len(found) == sum(len(s) + 1 for s in strings)
        for a, b, p in zip(found, found[1:], prefix[1:]):
            assert a[:p] == b[:p] and (len(a) == p or len(b) == p or a[p] != b[p])


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_pipeline_stage_links_all_pairs_of_similarity_0_8(spark):
    import corpus_pipeline

    rng = random.Random(11)
    texts = [None, "", " \n", "one", "ONE ", "two words"]
    for group in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 400, 1000]))]
        for _ in range(40 if group == 0 else 4):  # a large group of near copies too
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(words))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (None, texts[-1])]
    cut = {i: word_sets(t) for i, t in rows if i is not None}
    pairs = [(a, b) for a in cut for b in cut if a < b]
    linked = [(a, b) for a, b in pairs if cut[a] == cut[b] or len(cut[a] & cut[b]) / max(1, len(cut[a] | cut[b])) >= 0.8]
    root = components(cut, linked)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert found == root and len(set(root.values())) < len(root) - 50
    table = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(root.values())) and kept.count(None) == 2
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stage_links_by_fingerprints_first(spark, monkeypatch):
    """What fingerprints link is checked exactly, and what they cannot link is
    still found; without MinHash keys they alone link near copies."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(800)]
    near, far = list(base), list(base)
    near[400] = "x"
    for i in range(0, 800, 100):
        far[i] = "y"
    rows = [(i, " ".join(t)) for i, t in enumerate([base, near, far, [f"z{i}" for i in range(50)]], 1)]
    bits = [bin(fingerprint(rows[0][1]) ^ fingerprint(rows[i][1])).count("1") for i in (1, 2)]
    assert bits[0] <= 2 < bits[1], bits
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    monkeypatch.setattr(jaccard, "_with_pivot", lambda sets: sets.sparkSession.createDataFrame([], "a long, b long, n_a long, n_b long, crowded boolean"))
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}

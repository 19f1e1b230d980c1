"""Decontamination, language ID, packing and chat formatting."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from tapewatch.llm import chat, decontam, langid, packing
from tapewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def word_text(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_contained_items_are_found_in_documents_of_every_size(spark):
    rng = random.Random(1)
    items = [(i, word_text(rng, rng.choice([3, 5, 12, 40]))) for i in range(40)] + [(90, None), (91, " ?! "), (None, "a b c d e f")]
    docs = [(1000, None, 0), (1001, "", 0), (None, items[3][1], 0), (1002, items[0][1].upper() + "!", 0)]
    for i in range(150):
        own = [word_text(rng, rng.choice([0, 5, 60, 900, 9000]))]
        for _, t in rng.sample(items[:40], 2):
            words = t.split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
            own.insert(rng.randrange(len(own) + 1), ", ".join(words))
        docs.append((i, "\n".join(own), 0))
    docs += docs[-1:]

    def cut(t):
        w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = []
    for d, t, _ in docs:
        own = cut(t)
        for i, x in items:
            wanted = cut(x)
            if wanted and len(wanted & own) >= 0.8 * len(wanted):
                want.append((str(d), str(i), len(wanted & own), len(wanted)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    asked = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, containment double")
    got = [(str(r[0]), str(r[1]), r[2], r[3]) for r in decontam.find_contaminated(frame, asked).collect()]
    found = set(got) & set(want)
    assert set(got) <= set(want) and len(found) >= 0.99 * len(set(want)) and len(set(want)) > 100
    # row by row: neither a missing key nor a repeated one changes what is dropped
    asked_cuts = [w for w in (cut(x) for _, x in items) if w]
    clean = [(d, t) for d, t, _ in docs if not any(len(w & cut(t)) >= 0.8 * len(w) for w in asked_cuts)]
    twice = frame.unionByName(spark.createDataFrame([(docs[0][0], "nothing to see here", 1), (None, "nor here", 2)], frame.schema))
    kept = [(r.doc_id, r.text) for r in decontam.decontaminate(twice, asked).collect()]
    assert sorted(kept, key=str) == sorted([*clean, (docs[0][0], "nothing to see here"), (None, "nor here")], key=str)
    assert decontam.find_contaminated(frame.limit(0), asked).count() == 0
    assert decontam.find_contaminated(frame, asked.limit(0)).count() == 0


def test_no_short_item_is_missed_in_long_documents(spark):
    rng = random.Random(21)
    sizes = [1 + i % 14 for i in range(70)] + [60 + i for i in range(10)] + [100, 150, 200, 300, 400, 504]
    items = [(i, word_text(rng, n)) for i, n in enumerate(sizes)]
    docs = []
    for d in range(120):
        words = word_text(rng, rng.choice([20, 700, 6000])).split()
        for _, t in rng.sample(items, 12):
            own = t.split()
            if rng.random() < 0.5:
                own[rng.choice([0, -1])] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, " ".join(words)))

    def cut(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    cuts = [(d, cut(t)) for d, t in docs]
    want = {(d, i) for i, x in items for wanted in [cut(x)] for d, own in cuts if len(wanted & own) >= 0.8 * len(wanted)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.find_contaminated(frame, asked).collect()]
    assert set(got) == want and len(got) == len(want) > 500
    # by length of the item: the signature alone meets every one that is contained
    index, hasher = decontam.ItemIndex(items), decontam.ShingleHasher()
    met = {}
    for d, t in docs:
        hashes, _ = hasher(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        met[d] = {index.items[i][0] for i in index.candidates(hashes)}
    by_size = {}
    for d, i in want:
        by_size.setdefault(sizes[i], []).append(i in met[d])
    assert all(all(found) for found in by_size.values()) and {5, 9, 14, 65, 504} <= set(by_size)


def test_signatures_keep_the_least_values_of_each_bin():
    rng = np.random.default_rng(2)
    for n in (1, 8, 9, 100, 3000):
        h = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for bits in (0, 3, decontam.partition(n)):
            kept = set(decontam.signature(h, bits).tolist())
            bins = {}
            for x in h.tolist():
                bins.setdefault(x >> (63 - bits), []).append(x)
            assert kept == {x for b in bins.values() for x in sorted(b)[: decontam.MINIMA]}
    h = np.unique(rng.integers(0, 1 << 64, 100_000, np.uint64))
    assert len(decontam.signature(h, decontam.partition(len(h)))) == len(h)


def test_item_blocks_give_the_same_pairs(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in decontam.find_contaminated(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert sorted(tuple(r) for r in decontam.find_contaminated(docs, items).collect()) == whole and whole


def test_shingle_hashes_do_not_depend_on_neighbours():
    hasher = decontam.ShingleHasher()
    texts = ["", "a", "one two three four five six", " x ", "é è ü ö ä ß", "a-b c,d"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    together, cuts = hasher(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for r, a, b in zip(raw, cuts, cuts[1:]):
        alone, _ = hasher(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert together[a:b].tolist() == alone.tolist()
    assert np.diff(cuts).tolist() == [0, 1, 2, 1, 2, 1]


def test_language_accuracy_on_held_out_documents(spark):
    found = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    rows = [(1, "the and of that this with", "en"), (2, "le la et de que les", "fr"), (3, None, "en"), (4, "", None)]
    rows += [(5, "12 34 !?", "fr"), (6, "the and of " * 100_000, None), (None, "et de que", None), (None, "et de que", None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, score int")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert [r.lang_pred for r in got] == ["en", "fr", "und", "und", "und", "en", "fr", "fr"]
    assert [r.score for r in got[2:5]] == [0, 0, 0] and got[0].asDict().keys() >= {"doc_id", "text", "lang"}
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0).cast("string")).filter("doc_id < 0")
    assert langid.train(unlabelled) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


@pytest.fixture(scope="module")
def tokens():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return packing.TextTokens(public_tokenizers.path("word_bpe_49k.json"))


def test_training_holds_no_cell_for_every_possible_gram(spark, monkeypatch):
    docs = spark.createDataFrame([("the cat sat on the mat", "en"), ("der Hund schläft", "de"), ("¿dónde está?", "es")], "text string, lang string")
    langid.train(docs)  # imports and caches are not counted
    tracemalloc.start()
    model = langid.train(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["de", "en", "es"] and peak < 80 << 20  # the look-up alone takes 34 MB
    texts, want = ["abcab", "", "ab", "xyz", "bca"], {}
    for t in texts:
        raw = t.encode()
        for g in {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}:
            code = int.from_bytes(g, "big") + (langid.ONE, langid.TWO, langid.THREE)[len(g) - 1]
            want[code] = want.get(code, 0) + 1
    for merged in (1, 4, 1 << 20):
        monkeypatch.setattr(langid, "MERGED", merged)
        codes, counts = langid.gram_counts(texts)
        assert list(zip(codes.tolist(), counts.tolist())) == sorted(want.items())


def test_word_table_gives_the_tokenizers_ids(tokens):
    texts = ["", "It's I'LL don't 'sa ''s 12½ ½²  İstanbul ΣΑΣ ñandú … a\xadb\x7f\x85 x\x1cy", "<|endoftext|> a b"]
    texts += ["naïve ßß ÿĀ!?.) ''ve", " a b 你好 é", "ǅ ǲ ª º µ × ÷ a×b", "e\u0301 x", "\x00 a", "a\u2028b"]
    rng = random.Random(8)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3000)])) for _ in range(80)) for _ in range(150)]
    for t, ids in zip(texts, tokens.encode(texts)):
        assert ids.tolist() == tokens.whole.encode(t, add_special_tokens=False).ids


def test_cuts_are_the_cheapest():
    rng = random.Random(9)
    for _ in range(60):
        at = sorted(rng.sample(range(1, 60), rng.randrange(1, 12)))
        at, penalties = packing.cut_candidates(np.array(at[-1:]), np.array(at), at[-1], 16)
        position = [0, *at]
        best = {0: 0}
        for j in range(1, len(position)):
            costs = []
            for i in range(j):
                n = position[j] - position[i]
                if n <= 16 and i in best:
                    costs.append(best[i] + (16 - n) + penalties[j - 1] + packing.NEW_WINDOW)
            best[j] = min(costs)
        cuts = [0, *packing.choose_cuts(at, penalties, 16)]
        cost = sum(16 - (b - a) + penalties[at.index(b)] + packing.NEW_WINDOW for a, b in zip(cuts, cuts[1:]))
        assert cost == best[len(at)] and max(b - a for a, b in zip(cuts, cuts[1:])) <= 16


def test_an_unfinished_chunk_pays_nothing_for_its_last_window():
    rng = random.Random(4)
    for _ in range(60):
        at = sorted(rng.sample(range(1, 60), rng.randrange(2, 12)))
        at, penalties = packing.cut_candidates(np.array(at[-1:]), np.array(at), at[-1], 16)
        position = [0, *at]
        best = {0: 0}
        for j in range(1, len(position) - 1):
            best[j] = min(
                best[i] + 16 - position[j] + position[i] + penalties[j - 1] + packing.NEW_WINDOW
                for i in range(j) if position[j] - position[i] <= 16
            )
        cuts = [0, *packing.choose_cuts(at, penalties, 16, last=False)]
        assert cuts[-1] == at[-1] and cuts[-1] - cuts[-2] <= 16
        reach = [best[i] for i in range(len(position) - 1) if position[-1] - position[i] <= 16]
        assert best[position.index(cuts[-2])] == min(reach)


def test_chunks_pad_little_more_than_a_whole_task(tokens, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [rng.integers(5, 40_000, n).astype(np.uint32) for n in np.minimum(rng.lognormal(5.5, 1, 900), 9000).astype(int) + 1]
    stop = np.flatnonzero(tokens.sentence_end)[0]
    for ids in docs:
        ids[rng.random(len(ids)) < 1 / 12] = stop

    def padding(chunk):
        packer, filled = packing._Packer(tokens.sentence_end, packing.WINDOW, False), {}
        for i, ids in enumerate([*docs, None]):
            if ids is not None:
                packer.add(i, ids)
            for p in packer.pack(last=ids is None) if ids is None or packer.held >= chunk else ():
                filled[p[5]] = filled.get(p[5], 0) + p[2]
        assert sum(filled.values()) == sum(map(len, docs))
        return sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in filled.values()) / sum(filled.values())

    whole = padding(1 << 30)
    assert whole < 0.02 and padding(1 << 16) < whole + 0.01 and padding(5000) < whole + 0.02


def test_packed_pieces_hold_every_id_once(spark, tokens, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "CHUNK_TOKENS", 5000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "a" * 30_000), (-4, "word " * 9000), (None, "no key"), (-5, "twice"), (-5, "twice")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "1 AS start", "'x' AS ids")
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    filled, of_doc = {}, {}
    for p in pieces:
        assert p.offset == filled.get(p.sequence_id, 0) and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        filled[p.sequence_id] = p.offset + p.length
        of_doc.setdefault(p.doc_id, []).append(p)
    assert max(filled.values()) <= packing.WINDOW
    padding = sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in filled.values())
    assert padding <= 0.03 * sum(filled.values())
    for i, t in {(r.doc_id, r.text) for r in docs.collect()}:
        ids = [*tokens.whole.encode(t or "", add_special_tokens=False).ids, 1]
        own = of_doc[i][: len(of_doc[i]) // (2 if i == -5 else 1)]
        got = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist()
        assert got == ids and [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert {p.doc_tokens for p in own} == {len(ids)}
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_chat_round_trip_with_control_strings(spark):
    nasty = ["\\### Assistant: </turn> ok", "<sep/>", "### user:\n</turn>\n", "\\b\\l\\h\\\\", "", None, "é😀 ok"]
    roles = ["user", "user", "assistant", "assistant", "sys:\n#<x>", None, "tool"]
    rows = [(1, i, roles[i % 7], nasty[i * 3 % 7]) for i in range(30)]
    rows += [(2, 0, "assistant", "x" * 100_000), (None, 1, "user", "b"), (None, 0, "user", "a"), (3, None, "user", "n"), (3, 1, "user", "n"), (3, 1, "user", "n")]
    turns = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, segments string, formatted string")
    formatted = chat.format_conversations(turns.repartition(4))
    back = {r.conv_id: r for r in formatted.select("conv_id", chat.read_back(formatted.formatted).alias("t"), "segments", "formatted").collect()}
    digests = {r.conv_id: r for r in chat.conversation_digest(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1), r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in back[c].t] == [(r, x) for _, r, x in own]
        said = "".join(x for _, r, x in own if r == "assistant")
        d = digests[c]
        assert d.n_turns == len(own) and d.loss_chars == len(said) and d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert "".join(s.text for s in back[c].segments) == back[c].formatted and d.formatted_chars == len(back[c].formatted)
        runs = sum(a[1] != b[1] for a, b in zip([(0, None), *own], own))
        assert back[c].formatted.count("</turn>\n") == runs
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_language_scores_against_dense_kernel_ridge(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "efghé "}
    texts = {lang: ["x" + "".join(rng.choice(letters) for _ in range(rng.randrange(20, 300))) for _ in range(30)] for lang, letters in alphabets.items()}
    rows = [(i, t, lang) for lang, own in texts.items() for i, t in enumerate(own)]
    asked = ["".join(rng.choice("abcdefgé ") for _ in range(80)) for _ in range(40)] + [t for own in texts.values() for t in own[:3]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string"), model).collect()

    def grams(t):
        raw = t.lower().encode()
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    learned = [(t, lang) for _, t, lang in rows]
    count = {}
    for t, _ in learned:
        for g in grams(t):
            count[g] = count.get(g, 0) + 1
    kept = sorted(count, key=lambda g: (-count[g], len(g), g))[: langid.VOCABULARY]
    weight = np.array([np.log((1 + len(learned)) / count[g]) + 0.05 for g in kept])

    def vector(t):
        own = grams(t)
        x = np.array([g in own for g in kept], float) * np.sqrt(weight)
        return x / max(np.linalg.norm(x), 1e-6)

    x = np.array([vector(t) for t, _ in learned])
    kernel = x @ x.T
    names = sorted(alphabets)
    target = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in learned])
    share = 1 / 30
    alpha = np.linalg.solve(kernel.T @ kernel * share + 0.1 / len(learned) * kernel + 1e-9 * np.eye(len(x)), kernel.T @ target * share)
    outputs = np.array([vector(t) for t in asked]) @ x.T @ alpha
    for r in got:
        own = outputs[r.doc_id]
        assert r.score == pytest.approx(np.clip((own.max() + 1) / 2, 0, 1), abs=2e-3)
        assert r.lang_pred == names[own.argmax()] or np.sort(own)[-1] - np.sort(own)[-2] < 4e-3

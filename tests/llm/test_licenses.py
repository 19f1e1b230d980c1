"""License scans against regular expressions and plain counting."""

import random
import re

import pytest

from tapewatch.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES):
    words = WORD.findall((text or "").translate(LOWER))
    places, base = [], set()
    for phrase, label in phrases.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    line = " " + " ".join(words) + " "
    more = {k for k, t in templates.items() if re.search(" " + licenses.pattern(licenses.parse(t)), line)}
    score = 1.0 if more else 0.5 if base else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


def filled(tree, rng):
    """A text that a template accepts."""
    out = []
    for part in tree.parts:
        if isinstance(part, bytes):
            out.append(part.decode())
        elif isinstance(part, licenses.Replaceable):
            out += [rng.choice(["acme", "the", "license", "é"]) for _ in range(rng.randint(part.least, part.most))]
        else:
            out += filled(rng.choice(part.options), rng)
    return out


def texts(n=300, seed=0):
    rng = random.Random(seed)
    trees = [licenses.parse(t) for t in licenses.TEMPLATES.values()]
    filler = ["lorem", "license", "the", "under", "mit", "cc", "by", "nc", "version", "2", "apache", "Straße", "日本"]
    out = [None, "", "   ", "...", "a", "cc by nc " * 50_000, "under the " * 100_000 + "MIT License", "x" * 300_000, "CC-BY-NC 4.0", "under the mit\nlicense2"]
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            wording = filled(rng.choice(trees), rng)
            if rng.random() < 0.4 and wording:  # not exactly the wording
                k = rng.randrange(len(wording))
                wording[k : k + rng.choice([0, 1])] = rng.choice([[], ["not"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = wording
        out.append(rng.choice([" ", "\n", ", ", "-"]).join(rng.choice([w, w.upper(), w.title()]) for w in words))
    return out


def test_scan_against_regular_expressions(spark, monkeypatch):
    from tapewatch.llm import divergence

    monkeypatch.setattr(divergence, "PIECE", 4000)
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts() + texts(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int").repartition(5)
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=str)
    assert got == sorted(((k, *plain(t)) for k, t, _, _ in rows), key=str)
    assert any(r[7] == 0.5 for r in got) and {label for r in got for label in r[6].split(",")} >= set(licenses.TEMPLATES)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_forgotten_states_change_nothing(monkeypatch):
    some = texts(60, seed=3)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    whole = [scanner.scan(t) for t in some]
    monkeypatch.setattr(licenses, "MAX_STATES", 3)
    again = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    assert [again.scan(t) for t in some] == whole and len(again.known) < len(scanner.known)


def accepts(template, text):
    return bool(licenses.Scanner({}, {"t": template}).scan(text)[5])


@pytest.mark.parametrize(
    "template, yes, no",
    [
        ("a [b] c", ["a c", "x a b c", "a b c c"], ["a b", "a b b c", "a x c"]),
        ("a {1,3} c", ["a x c", "a c c", "a x y z c"], ["a c", "a w x y z c"]),
        ("a {0,2} c", ["a c", "a x c", "a a c"], ["a x y z c", "c a"]),
        ("(a|b [c]) d", ["a d", "b d", "b c d"], ["a c d", "c d"]),
        ("a [[b] {1,2}] c", ["a c", "a b x c", "a x y c", "a b c"], ["a b x y z c"]),
        ("a [b|{2,2}] c", ["a c", "a b c", "a x y c"], ["a x c"]),
    ],
)
def test_markup(template, yes, no):
    assert all(accepts(template, t) for t in yes)
    assert not any(accepts(template, t) for t in no)


@pytest.mark.parametrize("template", ["a [b", "a b]", "(a", "a | b", "{2,1} a", "{0,0} a", "[a]", "{0,3}", "MIT", "a {b}", "[a)"])
def test_wrong_markup_is_an_error(template):
    with pytest.raises(ValueError):
        licenses.Scanner({}, {"t": template})

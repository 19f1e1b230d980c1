"""License scans: phrases and license templates found by a token automaton.

A template is text with markup: ``[...]`` is an optional region, ``(a|b)`` a
choice, ``{m,n}`` a replaceable region of m to n words of any kind. All other
words are mandatory and must stand exactly so, one after another. Templates
are compiled into one automaton over words: every word is a state, regions
become jumps to states further on, a replaceable region is a row of states
that take any word. Sets of states are bits of a number; the sets that occur
while texts are read become the states of a deterministic automaton, which is
made step by step and forgotten when it has grown to MAX_STATES. A text is read
once, word by word, from anywhere in it, and each template that ends at a word
is reported there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame

from tapewatch.llm.common import bounded_batches
from tapewatch.llm.divergence import pieces

MAX_STATES = 1 << 14

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The wording of well-known license notices, with markup.
TEMPLATES = {
    "mit-notice": "(released|licensed|distributed|available|provided) under the [terms of the] mit license",
    "mit-text": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including
        without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice
        [including the next paragraph] shall be included in all copies or substantial portions of the software
        [the software is provided as is without warranty of any kind]""",
    "isc-text": """
        permission to use copy modify and [or] distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-text": """
        redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met [1] redistributions of source code must retain the above copyright
        notice this list of conditions and the following disclaimer [2] redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution
        [[3] neither the name of {1,12} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission]""",
    "apache-2-notice": """
        (licensed|released|distributed) under the [terms of the] apache license version 2 [0]
        [the license you may not use {1,4} except in compliance with the license]""",
    "gpl-notice": """
        (licensed|released|distributed) under the [terms of the] gnu [(lesser|affero|library)] general public
        license [as published by the free software foundation] [either] version (1|2|3) [or {0,4} any later version]""",
    "cc-notice": """
        [this work is] licensed under [a|the] [creative commons|cc] {0,2} (by|attribution)
        [(nc|noncommercial)] [(sa|nd|sharealike|noderivatives|noderivs)] (1|2|3|4) (0|5) [international|unported]""",
    "cc0-notice": "to the extent possible under law {1,12} has waived all copyright and related or neighboring rights to {1,12}",
    "all-rights-reserved": "[copyright {0,8}] all rights reserved",
    "public-domain": "[this is free and unencumbered software] released into the public domain",
}

# All bytes but those of letters, digits and characters beyond ASCII become spaces.
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


@dataclass
class Sequence:
    parts: list


@dataclass
class Choice:
    """One of several sequences; an optional region has an empty one too."""

    options: list[Sequence]


@dataclass
class Replaceable:
    least: int
    most: int


_MARKUP = re.compile(r"\{(\d+),(\d+)\}|[\[\]()|]|[^\s\[\](){}|]+|\S")


def parse(template: str) -> Sequence:
    """The tree of a template: words, choices and replaceable regions."""
    opened: list[tuple[str, list[Sequence]]] = [("", [Sequence([])])]
    for m in _MARKUP.finditer(template):
        token, options = m.group(), opened[-1][1]
        if m.group(1) is not None:
            least, most = int(m.group(1)), int(m.group(2))
            if most < max(least, 1):
                raise ValueError(f"{token} takes no word")
            options[-1].parts.append(Replaceable(least, most))
        elif token in "[(":
            opened.append((token, [Sequence([])]))
        elif token in "])":
            kind, options = opened.pop()
            if kind + token not in ("[]", "()"):
                raise ValueError(f"{token} closes nothing in: {template}")
            opened[-1][1][-1].parts.append(Choice(options + [Sequence([])] * (kind == "[")))
        elif token == "|":
            options.append(Sequence([]))
        elif token in "{}":
            raise ValueError(f"a replaceable region is {{m,n}}: {template}")
        elif token.encode("utf-8").translate(_WORDS).split() != [token.encode("utf-8")]:
            raise ValueError(f"no text has the word {token}")
        else:
            options[-1].parts.append(token.encode("utf-8"))
    if len(opened) > 1 or len(opened[0][1]) > 1:
        raise ValueError(f"an open region or a choice without brackets in: {template}")
    return opened[0][1][0]


@dataclass
class Automaton:
    """States are numbered along the templates, one for the place before each
    word and one for the end; jumps only lead to larger numbers."""

    takes: list[bytes | None] = field(default_factory=list)  # the word a state takes, None for any
    jumps: dict[int, list[int]] = field(default_factory=dict)
    starts: int = 0
    ends: dict[int, int] = field(default_factory=dict)  # end state to its template's place

    def add(self, tree: Sequence, place: int) -> None:
        first = len(self.takes)
        self.starts |= 1 << first
        self._sequence(tree)
        self.ends[len(self.takes)] = place
        self.takes.append(b"")  # no word is empty: nothing leads on from an end

    def _sequence(self, tree: Sequence) -> None:
        for part in tree.parts:
            if isinstance(part, bytes):
                self.takes.append(part)
            elif isinstance(part, Replaceable):
                first = len(self.takes)
                self.takes += [None] * part.most
                for state in range(first + part.least, first + part.most):
                    self._jump(state, first + part.most)
            else:
                self._choice(part)

    def _choice(self, choice: Choice) -> None:
        entry = len(self.takes)
        self.takes.append(b"")  # a state of its own that only jumps
        leave = []
        for option in choice.options:
            self._jump(entry, len(self.takes))
            self._sequence(option)
            leave.append(len(self.takes))
            self.takes.append(b"")
        for state in leave:
            self._jump(state, len(self.takes))

    def _jump(self, a: int, b: int) -> None:
        self.jumps.setdefault(a, []).append(b)

    def closed(self, states: int) -> int:
        """The states and all that jumps lead to from them."""
        left, out = states, 0
        while left:
            low = left & -left
            left ^= low
            out |= low
            for b in self.jumps.get(low.bit_length() - 1, ()):
                if not out >> b & 1:
                    left |= 1 << b
        return out


class _State(dict):
    """A set of states: word number to the next set; missing ones are made."""

    __slots__ = ("scanner", "states", "found")

    def __init__(self, scanner: Scanner, states: int):
        super().__init__()
        self.scanner, self.states = scanner, states
        self.found = tuple(place for end, place in scanner.automaton.ends.items() if states >> end & 1)

    def __missing__(self, word: int) -> _State:
        after = self[word] = self.scanner.step(self.states, word)
        return after


class Scanner:
    """The deterministic automaton of phrases and templates, as far as it was
    needed."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.automaton = Automaton()
        self.phrases = len(phrases)
        self.labels = [*phrases.values(), *templates]
        trees = [parse(p) for p in (*phrases, *templates.values())]
        self.lengths = [len(t.parts) for t in trees[: self.phrases]]
        for place, tree in enumerate(trees):
            self.automaton.add(tree, place)
        takes = self.automaton.takes
        words = sorted({w for w in takes if w})
        self.words = {w: i for i, w in enumerate(words, 1)}  # 0 is any other word
        anything = sum(1 << i for i, w in enumerate(takes) if w is None)
        self.masks = [anything] + [anything | sum(1 << i for i, t in enumerate(takes) if t == w) for w in words]
        self.begin = self.automaton.closed(self.automaton.starts)
        if any(self.begin >> end & 1 for end in self.automaton.ends):
            raise ValueError("a template without a mandatory word fits everywhere")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, _State] = {}
        self.start = self._state(self.begin)

    def _state(self, states: int) -> _State:
        found = self.known.get(states)
        if found is None:
            found = self.known[states] = _State(self, states)
        return found

    def step(self, states: int, word: int) -> _State:
        return self._state(self.automaton.closed((states & self.masks[word]) << 1) | self.begin)

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, set[str], set[str]]:
        """(words, places of phrases, first and last word where one starts,
        labels of phrases, labels of templates)."""
        if len(self.known) > MAX_STATES:
            self._forget()
        data = (text or "").encode("utf-8").translate(_WORDS)
        number, state, at = self.words.get, self.start, 0
        n, first, last = 0, None, None
        base: set[str] = set()
        templates: set[str] = set()
        for words in pieces(data):
            for i, word in enumerate(map(number, words, repeat(0)), at):
                state = state[word]
                if state.found:
                    for place in state.found:
                        if place < self.phrases:
                            begun = i + 1 - self.lengths[place]
                            n += 1
                            first = begun if first is None else min(first, begun)
                            last = begun if last is None else max(last, begun)
                            base.add(self.labels[place])
                        else:
                            templates.add(self.labels[place])
            at += len(words)
            if len(self.known) > MAX_STATES:
                states = state.states
                self._forget()
                state = self._state(states)
        return at, n, first, last, base, templates


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    Words are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. ``n_base`` counts all places where a phrase stands, the first
    and last word are where the first and last of these begin (null without
    one). ``labels`` are those of phrases and templates, sorted and joined by
    commas. The score is 1 if a template's whole mandatory wording stands in
    the text, 0.5 if only a phrase does, else 0.

    A null text is empty; null and repeated keys stay; an empty text has no
    words and no labels; long texts are read piece by piece; further columns
    are ignored; an empty table gives no rows. Texts are scanned where they
    lie: no shuffle."""
    bounded_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    fields = docs.select(key).schema
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for name in names:
        fields = fields.add(name, "string" if name.endswith("labels") else "double" if name == "score" else "long")
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            out = []
            for value in batch.column(1):
                words, n, first, last, base, more = scanner.scan(value.as_py())
                score = 1.0 if more else 0.5 if base else 0.0
                out.append((words, n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score))
            columns = list(zip(*out)) or [()] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], fields.names)

    return docs.select(key, text).mapInArrow(run, fields)


def pattern(tree: Sequence) -> str:
    """The template as a regular expression over words each followed by a
    space, to compare the automaton with."""
    out = ""
    for part in tree.parts:
        if isinstance(part, bytes):
            out += part.decode("utf-8") + " "
        elif isinstance(part, Replaceable):
            out += f"(?:[^ ]+ ){{{part.least},{part.most}}}"
        else:
            out += f"(?:{'|'.join(pattern(o) for o in part.options)})"
    return out

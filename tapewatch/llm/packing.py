"""Packing documents into token windows by dynamic programming.

Documents keep their order. A task lays the tokens of its documents end to end
and chooses where windows are cut so that padding plus penalties for cutting
inside a document is least: cuts may fall at document ends (free), at sentence
ends (a small penalty) and, where no sentence ends in a whole window, anywhere
(a large one). The cheapest way to end a window at j is the least of
``cost(i) + i`` over the cuts i in reach, which a monotone queue hands out in
constant time; windows with a power of two of tokens need no padding and are
tried as well.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tapewatch.llm.common import bounded_batches, releasing

WINDOW = 2048
END_ID = 1
SENTENCE_CUT = 4  # tokens of padding that a cut at a sentence end is worth
FORCED_CUT = 64
NEW_WINDOW = 2
SHORT = (256, 512, 1024)  # windows below WINDOW that are worth trying
CHUNK_TOKENS = 1 << 20  # tokens of a task packed at a time
CACHED_WORDS = 1 << 18
CACHED_BYTES = 1 << 24  # of these words

# Characters for which lower-casing, normalisation and word splitting are plain;
# a text with others, or with a special token, goes to the tokenizer whole.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f]*")
LETTERS = "a-z\\u00aa\\u00b5\\u00ba\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
DIGITS = "0-9\\u00b2\\u00b3\\u00b9\\u00bc\\u00bd\\u00be"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")


class _Words(dict):
    """Word to its place in the table; new words are remembered."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class TextTokens:
    """Token ids of texts as the tokenizer file gives them without special
    tokens, with the ids of words seen before taken from a table."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words_only = Tokenizer(self.whole.model)
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        size = max(vocabulary.values()) + 1
        self.sentence_end = np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.sentence_end[i] = bool(re.fullmatch("[.!?]+[\"')]*</w>", token))
        self._clear()

    def _clear(self) -> None:
        self.words = _Words()
        self.bytes = 0
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        if not new:
            return
        self.bytes += sum(map(len, new))
        ids = [e.ids for e in self.words_only.encode_batch_fast(new, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.flat = np.concatenate((self.flat, np.concatenate(ids).astype(np.uint32)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHED_WORDS or self.bytes > CACHED_BYTES:
            self._clear()
        found: list[np.ndarray | None] = []
        for text in texts:
            if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                words = WORD.findall(text.lower())
                found.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
            else:
                found.append(None)
        self._learn()
        return [self._ids(w) if w is not None else self._whole(t) for w, t in zip(found, texts)]

    def _ids(self, words: np.ndarray) -> np.ndarray:
        length = self.length[words]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) - np.repeat(ends - length, length)
        return self.flat[np.repeat(self.start[words], length) + inside]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def cut_candidates(ends: np.ndarray, sentences: np.ndarray, total: int, window: int) -> tuple[list[int], list[int]]:
    """(positions, penalties) where windows may be cut, no two further apart
    than a window."""
    penalty = dict.fromkeys(sentences.tolist(), SENTENCE_CUT)
    penalty.update(dict.fromkeys(ends.tolist(), 0))
    penalty[total] = 0
    at, costs, before = [], [], 0
    for p in sorted(penalty):
        while p - before > window:
            before += window
            at.append(before)
            costs.append(FORCED_CUT)
        if p > 0:
            at.append(p)
            costs.append(penalty[p])
            before = p
    return at, costs


def choose_cuts(at: list[int], penalties: list[int], window: int = WINDOW, last: bool = True) -> list[int]:
    """The cuts, the last candidate among them, with the least padding and
    penalties in total. If the candidates are not the ``last`` ones, the window
    up to the end is no window yet and costs no padding."""
    position, cost, back = [0, *at], [0] * (len(at) + 1), [0] * (len(at) + 1)
    key = [0] * (len(at) + 1)
    queue = deque([0])
    where = {0: 0}
    short = [s for s in SHORT if s < window]
    for j in range(1, len(position)):
        p = position[j]
        while position[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - p
        if not last and j == len(position) - 1:
            i = min(queue, key=lambda k: cost[k])  # in reach; the rest is packed with what follows
            best = cost[i]
        for s in short:
            k = where.get(p - s)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j] = best + penalties[j - 1] + NEW_WINDOW
        back[j] = i
        key[j] = cost[j] + p
        where[p] = j
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(position) - 1
    while j:
        cuts.append(position[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(start: int, end: int, window: int) -> list[int]:
    """Cuts for the rest of a task, which no document follows: powers of two
    as long as padding would cost more than a cut."""
    cuts = []
    while end > start:
        left = end - start
        power = 1 << (left.bit_length() - 1)
        if left == power or window - left <= FORCED_CUT:
            power = left
        start += power
        cuts.append(start)
    return cuts


class _Packer:
    """Packs the documents of one task, a chunk of tokens at a time."""

    def __init__(self, sentence_end: np.ndarray, window: int, with_ids: bool):
        self.sentence_end, self.window, self.with_ids = sentence_end, window, with_ids
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []  # key, tokens of the document, tokens already packed
        self.held = 0
        self.sequences = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((key, len(ids), 0))
        self.held += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        ids = np.concatenate(self.parts)
        lengths = np.array([n - done for _, n, done in self.docs])
        ends = np.cumsum(lengths)
        inside = self.sentence_end[np.minimum(ids, len(self.sentence_end) - 1)]
        at, penalties = cut_candidates(ends, np.flatnonzero(inside) + 1, len(ids), self.window)
        cuts = choose_cuts(at, penalties, self.window, last)
        first = cuts[-2] if len(cuts) > 1 else 0  # start of the last window
        cuts = cuts[:-1] + tail_cuts(first, len(ids), self.window) if last else cuts[:-1]
        out = self._pieces(ids, ends, lengths, cuts)
        packed = cuts[-1] if cuts else 0
        left = int(np.searchsorted(ends, packed, side="right"))
        self.parts, self.held = [ids[packed:]], len(ids) - packed
        self.docs = self.docs[left:]
        if self.docs and packed:
            key, n, done = self.docs[0]
            self.docs[0] = (key, n, done + packed - int(ends[left] - lengths[left]))
        return out

    def _pieces(self, ids, ends, lengths, cuts) -> list[tuple]:
        if not cuts:
            return []
        stops = np.array(cuts)
        marks = np.union1d(stops, ends[ends < stops[-1]])
        starts = np.concatenate(([0], marks[:-1]))
        doc = np.searchsorted(ends, starts, side="right")
        window = np.searchsorted(stops, starts, side="right")
        opened = np.concatenate(([0], stops[:-1]))[window]
        raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
        out = []
        columns = (starts, marks, doc, window, opened, (ends - lengths)[doc])
        for a, b, d, w, o, begun in zip(*[c.tolist() for c in columns]):
            key, n, done = self.docs[d]
            piece = raw[4 * a : 4 * b]
            row = (key, a - begun + done, b - a, zlib.crc32(piece), n, self.sequences + w, a - o)
            out.append((*row, bytes(piece)) if self.with_ids else row)
        self.sequences += len(cuts)
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``with_ids``, ids (little-endian unsigned
    32-bit numbers).

    ``tokenizer`` is a tokenizer file that every executor can read. A null text
    is empty and still has the closing id; repeated rows and null keys are
    packed like any others; further columns are ignored; an empty table gives
    no rows. Documents are packed in the order in which tasks read them,
    without a shuffle: a sequence id is the task's number and a count within
    the task. A task holds CHUNK_TOKENS tokens and its longest document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TextTokens(tokenizer)
        packer = _Packer(tokens.sentence_end, window, with_ids)
        base = TaskContext.get().partitionId() << 33
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts)):
                packer.add(doc, np.concatenate((ids, end)))
                if packer.held >= CHUNK_TOKENS:
                    yield rows(packer.pack(last=False), base)
        yield rows(packer.pack(last=True), base)

    def rows(pieces: list[tuple], base: int) -> pa.RecordBatch:
        columns = list(zip(*pieces)) or [()] * len(types)
        columns[5] = [base + s for s in columns[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    fields = docs.select(key).schema
    types = [to_arrow_type(fields[0].dataType), *[pa.int64()] * 6]
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        fields = fields.add(name, "long")
    if with_ids:
        fields, types = fields.add("ids", "binary"), [*types, pa.binary()]
    names = fields.names
    return docs.select(key, text).mapInArrow(releasing(run), fields)

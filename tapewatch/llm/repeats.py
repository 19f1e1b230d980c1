"""Repeated byte strings across documents, removed from all but the first.

A byte is removed if a string of LENGTH bytes covers it that also starts in a
document with a smaller id. The work runs in four steps.

1. Every window of LENGTH bytes has an anchor, its least hashed ANCHOR bytes
   (a minimizer). Neighbouring windows with one anchor form a stretch. Equal
   windows have equal anchors, so only stretches with one anchor can share
   one. Stretches are packed into byte blocks by anchor range; of equal
   stretches in a task all but those of the smallest id are settled at once.
2. In an anchor range equal stretches are settled against their smallest id.
   Of the rest, those stay that share an anchor with another stretch and the
   bytes on one side of it.
3. The bytes of these stretches are fetched, and each bucket of anchors builds
   the Burrows-Wheeler transform and common prefixes of its stretches column
   by column: a round puts one more symbol in front of every stretch's suffix
   (``collection_order``). Suffixes in a row with common prefixes of LENGTH
   bytes or more hold the same window.
   An anchor of more than HOT such stretches is in no bucket: its windows are
   rows, each hash gets its smallest id by aggregation, and the windows under
   larger ids are joined to it in SALTS parts.
4. Spans meet their documents, which are cut and digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import Scratch, bounded_batches, releasing, releasing_group

LENGTH = 50
ANCHOR = 16
REACH = LENGTH - ANCHOR + 1  # anchors to choose from in a window
SIDE = (LENGTH - ANCHOR) // 2  # a shared window has this much on one side of its anchor at least
PIECE = 1 << 20  # bytes of text looked at at a time
LONG = 60_000  # longer texts come in pieces
RUN = 1 << 19  # stretches of a task that are packed together
TURNS = 4  # parts of an anchor range that are sorted one after the other
RANGE_BYTES = 384 << 20  # text per 16 anchor ranges
BUCKET = 1 << 12  # strings ordered together, more only if they share an anchor
HOT = 1 << 12  # open stretches of an anchor that are ordered in memory
SALTS = 16
CLOSED, OPEN, CROWDED = 0, 1, 2  # kinds of spans
_BASE = 0x9E3779B97F4A7C15 | 1
# What travels of a stretch, those of a document in a row, and of a document's piece.
STRETCH = np.dtype([("anchor", "V5"), ("same", "V6"), ("left", "u1"), ("right", "u1"), ("at", "<u2"), ("more", "u1")])
PART = np.dtype([("id", "<i8"), ("tag", "<u4"), ("piece", "<u2"), ("n", "<u2")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Stretches:
    """Finds the stretches of texts that lie back to back."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        return sums

    def part_hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = self._sums(data)
        return _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def window_hashes(self, data: np.ndarray) -> np.ndarray:
        n = max(len(data) - LENGTH + 1, 0)
        return self.part_hashes(data, np.arange(n), np.arange(n) + LENGTH)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Columns anchor, same, left, right, text, at (in the text), more
        (windows after the first)."""
        n = len(data)
        windows = n - LENGTH + 1
        if windows < 1:
            empty = np.zeros(0, np.uint64)
            return {c: empty for c in ("anchor", "same", "left", "right", "text", "at", "more")}
        sums = self._sums(data)

        def hashed(a, b):
            return _mix((sums[b] - sums[a]) * self.inverse[a])

        grams = n - ANCHOR + 1
        value = _mix((sums[ANCHOR:] - sums[:grams]) * self.inverse[:grams])
        least = (value & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH:
            least = np.minimum(least[: windows], least[REACH - width :][:windows])
        anchor_at = (least[:windows] & np.uint64(0xFFFFFF)).astype(np.int64)
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(sizes)), sizes)[:windows]
        inside = np.arange(windows) + LENGTH <= offsets[1:][text]
        begins = inside.copy()
        begins[1:] &= ~(inside[:-1] & (anchor_at[1:] == anchor_at[:-1]) & (text[1:] == text[:-1]))
        ends = inside.copy()
        ends[:-1] &= begins[1:] | ~inside[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        at, owner = anchor_at[first], text[first]
        start, stop = offsets[:-1][owner], offsets[1:][owner]
        # 0 stands for a side that is cut off by the document's end: it matches nothing
        left = np.where(at - SIDE >= start, 1 + hashed(np.maximum(at - SIDE, 0), at) % np.uint64(255), 0)
        behind = np.minimum(at + ANCHOR + SIDE, n)
        right = np.where(at + ANCHOR + SIDE <= stop, 1 + hashed(at + ANCHOR, behind) % np.uint64(255), 0)
        return {
            "anchor": _mix(value[at] + np.uint64(1)),
            "same": _mix(hashed(first, last + LENGTH) + (last - first).astype(np.uint64)),
            "left": left,
            "right": right,
            "text": owner,
            "at": first - start,
            "more": last - first,
        }


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]
    return np.ascontiguousarray(raw).view(f"V{n}").reshape(-1)


def _from_bytes(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :n] = np.frombuffer(x.tobytes(), np.uint8).reshape(-1, n)
    return out.view("<u8").reshape(-1).astype(np.int64 if n < 8 else np.uint64)


class _Run:
    """The stretches of many documents of one task on their way to anchor ranges."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int, int, int]] = []  # id, tag, number of the piece of the text
        self.columns: list[dict[str, np.ndarray]] = []
        self.held = 0

    def add(self, found: dict[str, np.ndarray], docs: list[tuple[int, int, int]]) -> None:
        self.columns.append(found | {"text": found["text"] + len(self.docs)})
        self.docs += docs
        self.held += len(found["at"])

    def full(self) -> bool:
        return self.held >= RUN

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(range, documents, stretches); settled stretches have anchor 0."""
        if not self.held:
            return
        c = {k: np.concatenate([x[k] for x in self.columns]) for k in self.columns[0]}
        text = c["text"].astype(np.int64)
        docs = np.zeros(len(self.docs), PART)
        for i, name in enumerate(("id", "tag", "piece")):
            docs[name] = [d[i] for d in self.docs]
        ids = docs["id"][text]
        order = np.lexsort((ids, c["same"], c["anchor"]))
        anchor, same = c["anchor"][order], c["same"][order]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (same[1:] != same[:-1])))
        settled = np.zeros(len(order), bool)
        settled[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        low = np.maximum(c["anchor"] & np.uint64((1 << 40) - 1), np.uint64(1))
        out = np.zeros(len(order), STRETCH)
        out["anchor"] = _low_bytes(np.where(settled, np.uint64(0), low), 5)
        out["same"] = _low_bytes(c["same"], 6)
        for name in ("left", "right", "at", "more"):
            out[name] = c[name]
        target = np.where(settled, text.astype(np.uint64), c["anchor"] >> np.uint64(40)) % np.uint64(self.ranges)
        by_range = np.lexsort((text, target))
        out, text = out[by_range], text[by_range]
        edges = np.searchsorted(target[by_range], np.arange(self.ranges + 1))
        for r in range(self.ranges):
            part = out[edges[r] : edges[r + 1]]
            if len(part):
                used, n = np.unique(text[edges[r] : edges[r + 1]], return_counts=True)
                own = docs[used]
                own["n"] = n
                yield r, own.tobytes(), part.tobytes()


def _pieces(texts: pa.Array, ids: list, tags: list) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(bytes, offsets, documents) of at most PIECE bytes; a text above LONG comes
    in pieces that overlap by a window less one byte."""
    column = texts.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        size = int(ends[at + 1] - ends[at])
        if size > LONG:
            for start in range(0, size - LENGTH + 1, LONG):
                own = data[ends[at] + start : ends[at] + min(size, start + LONG + LENGTH - 1)]
                yield own, np.array([0, len(own)]), [(ids[at], tags[at], start // LONG)]
            at += 1
            continue
        upto = at + 1
        while upto < len(column) and ends[upto + 1] - ends[at] <= PIECE and ends[upto + 1] - ends[upto] <= LONG:
            upto += 1
        yield data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at], [(ids[i], tags[i], 0) for i in range(at, upto)]
        at = upto


def _send_stretches(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = Stretches(), _Run(ranges)

        def flush() -> Iterator[pa.RecordBatch]:
            for r, docs, stretches in held.blocks():
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "docs": [docs], "stretches": [stretches]})
            held.clear()

        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for data, offsets, docs in _pieces(batch.column(2), ids, tags):
                held.add(find(data, offsets), docs)
                if held.full():
                    yield from flush()
        yield from flush()

    return run


SPANS = "doc_id long, tag long, kind int, anchors binary, starts binary, ends binary"


def _spans(ids, tags, kinds, anchors, starts, ends) -> pa.Table:
    """One row per document and kind with its spans packed."""
    order = np.lexsort((starts, kinds, tags, ids))
    ids, tags, kinds, anchors, starts, ends = (x[order] for x in (ids, tags, kinds, anchors, starts, ends))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (kinds[1:] != kinds[:-1])
    cuts = np.append(np.flatnonzero(new), len(ids))
    firsts = cuts[:-1]

    def packed(x: np.ndarray, kind: str) -> pa.Array:
        raw = np.ascontiguousarray(x.astype(kind))
        size = raw.itemsize
        return pa.Array.from_buffers(
            pa.large_binary(), len(firsts), [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(raw)]
        ).cast(pa.binary())

    return pa.table({
        "doc_id": pa.array(ids[firsts], pa.int64()),
        "tag": pa.array(tags[firsts], pa.int64()),
        "kind": pa.array(kinds[firsts], pa.int32()),
        "anchors": packed(np.where(kinds, anchors, 0).astype(np.uint64) if len(kinds) else anchors, "<u8"),
        "starts": packed(starts, "<i4"),
        "ends": packed(ends, "<i4"),
    })


def _settle(hot: int):
    """Step 2 for one anchor range, in turns."""

    def run(group: pa.Table) -> pa.Table:
        docs = np.concatenate([np.frombuffer(x.as_buffer(), PART) for x in group.column("docs")])
        s = np.concatenate([np.frombuffer(x.as_buffer(), STRETCH) for x in group.column("stretches")])
        owner = np.repeat(np.arange(len(docs)), docs["n"])
        anchor = _from_bytes(s["anchor"], 5)
        turn = anchor % TURNS
        own = [np.flatnonzero(turn == t) for t in range(TURNS)]
        return pa.concat_tables([_settle_turn(docs[owner[o]], s[o], anchor[o], hot) for o in own if len(o)])

    return run


def _settle_turn(docs: np.ndarray, s: np.ndarray, anchor: np.ndarray, hot: int) -> pa.Table:
    ids, tags = docs["id"], docs["tag"].astype(np.int64)
    starts = docs["piece"].astype(np.int64) * LONG + s["at"]
    ends = starts + s["more"] + LENGTH
    same = _from_bytes(s["same"], 6)
    order = np.lexsort((ids, same, anchor))
    new_anchor = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))
    new = new_anchor | np.concatenate(([True], same[order][1:] != same[order][:-1]))
    group_of = np.cumsum(new) - 1
    covered = np.zeros(len(s), bool)
    covered[order] = ids[order] > ids[order][np.flatnonzero(new)][group_of]
    covered |= anchor == 0
    # one stretch per kind: does another kind of the anchor have the same bytes on a side?
    kinds = order[np.flatnonzero(new)]
    kinds = kinds[anchor[kinds] != 0]
    meets = np.zeros(len(kinds), bool)
    for side in ("left", "right"):
        v = s[side][kinds]
        by = np.lexsort((v, anchor[kinds]))
        a, b = anchor[kinds][by], v[by]
        equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (b[1:] != 0)
        meets[by[1:]] |= equal
        meets[by[:-1]] |= equal
    wanted = np.zeros(int(group_of[-1]) + 1, bool)
    rank = np.zeros(len(s), np.int64)
    rank[order] = group_of
    wanted[rank[kinds[meets]]] = True
    open_ = wanted[rank] & ~covered
    keep = covered | open_
    kind = np.full(len(s), CLOSED)
    _, of, n = np.unique(anchor[open_], return_inverse=True, return_counts=True)
    kind[open_] = np.where(n[of] > hot, CROWDED, OPEN)
    return _spans(ids[keep], tags[keep], kind[keep], anchor[keep], starts[keep], ends[keep])


FETCHED = "bucket int, anchors binary, heads binary, bytes binary, doc_id long, tag long, starts binary, windows binary"
_NO_BUCKET = -1


def _fetch(buckets: int):
    """Step 3, first half: the bytes of open stretches packed by bucket of
    anchors, and the hashed windows of crowded ones packed by document."""
    names = [c.split()[0] for c in FETCHED.split(", ")]

    def joined(parts: list[dict], name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *[np.frombuffer(p[name], kind) for p in parts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Stretches()
        for batch in batches:
            rows = batch.to_pydict()
            found, crowded = [], []
            for doc, tag, text, wanted in zip(*[rows[c] for c in ("doc_id", "tag", "text", "wanted")]):
                raw = text.encode("utf-8")
                parts = [p for p in wanted if p["kind"] == OPEN]
                a, s, e = (joined(parts, *c) for c in (("anchors", "<u8"), ("starts", "<i4"), ("ends", "<i4")))
                found += [(x, doc, tag, b, raw[b:c]) for x, b, c in zip(a.tolist(), s.tolist(), e.tolist())]
                parts = [p for p in wanted if p["kind"] == CROWDED]
                if parts:
                    at, hashed = _windows(find, np.frombuffer(raw, np.uint8), *(joined(parts, c, "<i4") for c in ("starts", "ends")))
                    crowded.append((_NO_BUCKET, None, None, None, doc, tag, at.astype("<i4").tobytes(), hashed.tobytes()))
            out = crowded
            anchors = np.array([f[0] for f in found], np.uint64)
            target = (anchors >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(target, kind="stable")
            edges = np.flatnonzero(np.diff(target[order].astype(np.int64), prepend=-1))
            for own in np.split(order, edges[1:]) if len(order) else []:
                part = [found[i] for i in own]
                heads = np.array([(f[1], f[2], f[3], len(f[4])) for f in part], "<i8")
                packed = (anchors[own].tobytes(), heads.tobytes(), b"".join(f[4] for f in part))
                out.append((int(target[own[0]]), *packed, None, None, None, None))
            if out:
                types = [pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _windows(find: Stretches, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of the stretches of a text."""
    s, e = starts.astype(np.int64), ends.astype(np.int64)
    n = e - s - LENGTH + 1
    at = np.unique(np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum()))
    low = int(at[0])
    return at, find.part_hashes(raw[low : int(at[-1]) + LENGTH], at - low, at - low + LENGTH)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, start, window), one row for each packed window."""
    for batch in batches:
        for doc, tag, starts, windows in zip(*(batch.column(i) for i in range(4))):
            at = np.frombuffer(starts.as_buffer(), "<i4")
            columns = [
                pa.array(np.full(len(at), doc.as_py()), pa.int64()),
                pa.array(np.full(len(at), tag.as_py()), pa.int64()),
                pa.array(at),
                pa.array(np.frombuffer(windows.as_buffer(), np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "start", "window"])


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low:high] for each pair, all of them non-empty."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[low[own]], table[high[own] - width])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def collection_order(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) of all
    suffixes of the strings data[offsets[i]:offsets[i + 1]], in sorted order.

    Column by column: the list starts with the empty suffixes. In each round
    every string puts the next symbol to the left in front of its longest
    suffix. Sorting the suffixes stably by the symbol in front of them (the
    transform) gives the order of the next round; two neighbours there share
    one symbol more than all that lay between their rests."""
    ends = offsets[1:]
    n, sizes = len(ends), np.diff(offsets)
    empty = np.arange(n, dtype=np.int64)
    who, length, prefix = empty, np.zeros(n, np.int64), np.zeros(n, np.uint8)
    for _ in range(int(sizes.max()) if n else 0):
        ahead = np.flatnonzero(length < sizes[who])
        symbol = data[ends[who[ahead]] - length[ahead] - 1]
        by = np.argsort(symbol, kind="stable")
        rest, symbol = ahead[by], symbol[by]
        grown = np.zeros(len(rest), np.uint8)
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        grown[same] = 1 + _range_minimum(prefix, rest[same - 1] + 1, rest[same] + 1)
        who = np.concatenate((empty, who[rest]))
        length = np.concatenate((np.zeros(n, np.int64), length[rest] + 1))
        prefix = np.concatenate((np.zeros(n, np.uint8), grown))
    return who, length, prefix


def _shared_parts(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(string, start, windows, hash) of the runs of windows of the strings
    whose hash occurs under another id. What is no such window needs no order."""
    hashed = Stretches().window_hashes(data)
    string = np.repeat(np.arange(len(ids)), np.diff(offsets))[: len(hashed)]
    at = np.flatnonzero(np.arange(len(hashed)) + LENGTH <= offsets[1:][string])
    h, own = hashed[at], ids[string[at]]
    by = np.lexsort((own, h))
    new = np.concatenate(([True], h[by][1:] != h[by][:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(by)) - 1
    shared = np.zeros(len(hashed), bool)
    shared[at[by]] = (own[by][first] != own[by][last])[np.cumsum(new) - 1]
    begins = shared & ~np.concatenate(([False], shared[:-1] & (string[1:] == string[:-1])))
    stops = shared & ~np.concatenate((shared[1:] & (string[1:] == string[:-1]), [False]))
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    return string[first], first - offsets[:-1][string[first]], last - first + 1, first


def _order_bucket(group: pa.Table) -> pa.Table:
    """Step 3, second half: windows of open stretches with a smaller id elsewhere."""
    anchors = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in group.column("anchors")])
    heads = np.concatenate([np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 4) for x in group.column("heads")])
    data = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("bytes")])
    offsets = np.concatenate(([0], np.cumsum(heads[:, 3])))
    string, start, windows, at = _shared_parts(data, offsets, heads[:, 0])
    ids, sizes = heads[string, 0], windows + LENGTH - 1
    # equal parts of an anchor are one string with the smallest of their ids
    key = Stretches().part_hashes(data, at, at + sizes)
    by = np.lexsort((ids, key, anchors[string]))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (anchors[string][by][1:] != anchors[string][by][:-1])
    kind = np.zeros(len(by), np.int64)
    kind[by] = np.cumsum(new) - 1
    one = by[np.flatnonzero(new)]
    least = np.full(int(windows[one].sum()), np.iinfo(np.int64).max)  # smallest id of each window of each kind
    first_window = np.cumsum(windows[one]) - windows[one]
    a = anchors[string[one]]
    cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else np.zeros(1, int)
    i = 0
    while i < len(cuts) - 1:
        upto = max(i + 1, int(np.searchsorted(cuts, cuts[i] + BUCKET, side="right")) - 1)
        part = np.arange(cuts[i], cuts[upto])
        i = upto
        n = sizes[one[part]]
        edges = np.concatenate(([0], np.cumsum(n)))
        inside = np.arange(edges[-1]) - np.repeat(edges[:-1], n)
        who, length, prefix = collection_order(data[np.repeat(at[one[part]], n) + inside], edges)
        run = np.cumsum((prefix < LENGTH).astype(np.int64))
        whole = np.flatnonzero(length >= LENGTH)
        lowest = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, run[whole], ids[one[part]][who[whole]])
        least[first_window[part][who[whole]] + n[who[whole]] - length[whole]] = lowest[run[whole]]
    member = np.repeat(np.arange(len(string)), windows)
    inside = np.arange(len(member)) - np.repeat(np.cumsum(windows) - windows, windows)
    later = ids[member] > least[first_window[kind[member]] + inside]
    begins = later & ~np.concatenate(([False], later[:-1] & (member[1:] == member[:-1])))[: len(later)]
    stops = later & ~np.concatenate((later[1:] & (member[1:] == member[:-1]), [False]))[: len(later)]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    of = member[first]
    starts = heads[string[of], 2] + start[of] + inside[first]
    none = np.full(len(starts), CLOSED)
    ends = starts + (last - first) + LENGTH
    return _spans(ids[of], heads[string[of], 1], none, none.astype(np.uint64), starts, ends)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(x.as_py(), "<i4") for x in batch.column(2)]
        spans = [merged(np.sort(x), np.sort(x) + LENGTH) for x in found]
        starts, ends = ([x[i].astype("<i4").tobytes() for x in spans] for i in (0, 1))
        arrays = [batch.column(0), batch.column(1), pa.array(starts, pa.binary()), pa.array(ends, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "tag", "starts", "ends"])


def _crowded_spans(packed: DataFrame) -> DataFrame:
    """Step 3 for anchors with many stretches. No group holds them: minima come
    from partial aggregation, and the join deals the windows of a hash out."""
    windows = packed.mapInArrow(releasing(_unpack), "doc_id long, tag long, start int, window long")
    least = windows.groupBy("window").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    least = least.filter("_least < _most").select("window", "_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = windows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    later = dealt.join(least, ["window", "_salt"]).filter("doc_id > _least")
    later = later.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts"))
    return later.mapInArrow(releasing(_packed), "doc_id long, tag long, starts binary, ends binary")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, starts, ends): packed spans, possibly overlapping, of the
    bytes to remove. ``tag`` is the CRC of the text: rows that repeat an id
    with another text are told apart."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    named = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"), F.crc32(F.encode(text, "UTF-8")).alias("tag"), F.col(text).alias("text")
    )
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(16, -(-size // RANGE_BYTES) * 16)
    sent = named.mapInArrow(releasing(_send_stretches(ranges)), "range int, docs binary, stretches binary")
    first = scratch.write(sent.groupBy("range").applyInArrow(releasing_group(_settle(HOT)), SPANS))
    part = F.struct("kind", "anchors", "starts", "ends")
    wanted = first.filter(F.col("kind") != CLOSED).groupBy("doc_id", "tag").agg(F.collect_list(part).alias("wanted"))
    # texts move once for both kinds of stretches
    fetched = scratch.write(named.join(wanted, ["doc_id", "tag"]).mapInArrow(releasing(_fetch(8 * ranges)), FETCHED))
    spans = first.filter(F.col("kind") == CLOSED).select("doc_id", "tag", "starts", "ends")
    opened = fetched.filter(F.col("bucket") != _NO_BUCKET).select("bucket", "anchors", "heads", "bytes")
    ordered = opened.groupBy("bucket").applyInArrow(releasing_group(_order_bucket), SPANS)
    spans = spans.unionByName(scratch.write(ordered).select("doc_id", "tag", "starts", "ends"))
    crowded = fetched.filter(F.col("bucket") == _NO_BUCKET).select("doc_id", "tag", "starts", "windows")
    if not crowded.isEmpty():
        spans = spans.unionByName(scratch.write(_crowded_spans(crowded)))
    return scratch.result(spans)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that overlapping or touching spans cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, with ``kept_text``, the other columns with the text
    cut. What is left may start or end inside a character; such bytes are left
    out of the cut text (not of the digest).

    A null text is empty (and stays null in the cut text). Rows with a null key
    neither lose bytes nor take them; rows that repeat a key do not repeat each
    other. Texts below LENGTH bytes stay whole. An empty table gives no rows."""
    spans = repeated_spans(docs, key, text)
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(
        F.collect_list("starts").alias("_starts"), F.collect_list("ends").alias("_ends")
    )
    made = [f.split()[0] for f in RESULT.split(", ")]
    columns = [c for c in docs.columns if c not in made] if kept_text else [key]
    own = docs.select(*columns, F.col(text).alias("_text"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"))
    joined = own.join(spans, (F.col(key).cast("long") == F.col("_id")) & (F.col("_crc") == F.col("_tag")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = (batch.column(batch.schema.get_field_index(c)) for c in ("_text", "_starts", "_ends"))
            for t, starts, ends in zip(*lists):
                raw = (t.as_py() or "").encode("utf-8")
                if not starts.is_valid:
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), t.as_py()))
                    continue
                s = np.concatenate([np.frombuffer(x, "<i4") for x in starts.as_py()])
                e = np.concatenate([np.frombuffer(x, "<i4") for x in ends.as_py()])
                s, e = merged(s, e)
                edges = zip([0, *e.tolist()], [*s.tolist(), len(raw)])
                kept = b"".join(raw[a:b] for a, b in edges)
                cut = kept.decode("utf-8", "ignore") if kept_text else None
                rows.append((len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), cut))
            n, removed, count, digest, cut = zip(*rows) if rows else [()] * 5
            arrays = [
                pa.array(cut, pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in columns
            ]
            counts = [pa.array(x, pa.int64()) for x in (n, removed, count)]
            yield pa.RecordBatch.from_arrays([*arrays, *counts, pa.array(digest, pa.string())], [*columns, *made])

    fields = docs.select(*columns).schema
    for name, kind in (f.split() for f in RESULT.split(", ")):
        fields = fields.add(name, kind)
    return joined.mapInArrow(releasing(run), fields)

"""Language identification with a string kernel.

Two texts are compared by the blended spectrum they share: the byte n-grams of
one to three bytes present in both, weighted by how few landmarks have them
and normalised by the lengths of the two presence vectors. A bounded sample of
labelled texts serves as Nyström landmarks; one-versus-rest kernel ridge
regression is solved on the kernel between training texts and landmarks. A
batch of texts is scored by one matrix product of its presence matrix with the
landmarks' presence folded into the regression weights. Presence says little
about a text long enough to hold everything, so whole texts are cut into
stretches and their outputs averaged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import bounded_batches, release_memory, releasing

UNKNOWN = "und"
LANDMARKS = 48  # per language, at most
TRAINING = 400  # per language, at most
VOCABULARY = 4096  # n-grams compared
LONGEST_TRAINING_TEXT = 1 << 20  # bytes; longer texts are left out of the sample
WINDOW = 1 << 11  # bytes of a stretch: long texts are compared stretch by stretch, all of them
ROWS = 256  # stretches per matrix product
MERGED = 1 << 20  # n-grams counted at a time
# first code of the n-grams of one, two and three bytes
ONE, TWO, THREE, CODES = 0, 1 << 8, (1 << 8) + (1 << 16), (1 << 8) + (1 << 16) + (1 << 24)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def gram_codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of all n-grams of one to three bytes, by their first position."""
    wide = data.astype(np.int32)
    two = (wide[:-1] << 8) | wide[1:] if len(wide) > 1 else wide[:0]
    three = (two[:-1] << 8) | wide[2:] if len(wide) > 2 else wide[:0]
    return [wide, two + TWO, three + THREE]


def gram_counts(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): the n-grams of the texts, sorted, and how many texts
    have each. The driver holds no cell for an n-gram that no text has."""
    codes, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate([codes[:0], *waiting]), return_counts=True)
        both, at = np.unique(np.concatenate((codes, new)), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        total[at[: len(codes)]] = counts
        total[at[len(codes) :]] += n
        return both, total

    for text in texts:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        waiting += [np.unique(part) for part in gram_codes(data)]
        if sum(map(len, waiting)) >= MERGED:
            codes, counts = merged()
            waiting = []
    return merged()


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes of the vocabulary, sorted
    weights: np.ndarray  # gram by language: landmarks, their scale and the regression folded together
    squares: np.ndarray  # weight of each gram in a text's norm

    def lookup(self) -> np.ndarray:
        """Code to column of the vocabulary; -1 elsewhere."""
        at = np.full(CODES, -1, np.int16)
        at[self.grams] = np.arange(len(self.grams), dtype=np.int16)
        return at


def presence(buffer: np.ndarray, offsets: np.ndarray, lookup: np.ndarray, width: int) -> np.ndarray:
    """Stretch by gram, 1 where the stretch has the gram. Stretches lie back to
    back in ``buffer`` from offset to offset."""
    rows = len(offsets) - 1
    out = np.zeros((rows, width), np.float32)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    left = offsets[1:][owner] - offsets[0] - np.arange(len(owner))
    for n, codes in enumerate(gram_codes(buffer[offsets[0] : offsets[-1]]), 1):
        column = lookup[codes]
        known = np.flatnonzero((column >= 0) & (left[: len(codes)] >= n))
        flat[owner[known] * width + column[known]] = 1.0
    return out


def stretches(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, text of each stretch): every text cut into stretches of
    WINDOW bytes, an empty text being one empty stretch. Null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    pieces = np.maximum(1, -(-np.diff(ends) // WINDOW))
    owner = np.repeat(np.arange(len(column)), pieces)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return data, np.concatenate((ends[:-1][owner] + inside * WINDOW, ends[-1:])), owner


def by_text(values_of, column: pa.Array, width: int, lookup: np.ndarray) -> np.ndarray:
    """Mean over a text's stretches, by bytes, of what ``values_of`` makes of
    their presence rows."""
    data, offsets, owner = stretches(column)
    if not len(column):
        return values_of(np.zeros((0, width), np.float32))
    blocks = [
        values_of(presence(data, offsets[at : at + ROWS + 1], lookup, width)) for at in range(0, len(owner), ROWS)
    ]
    values, size = np.vstack(blocks), np.maximum(np.diff(offsets), 1).astype(np.float64)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.add.reduceat(values * size[:, None], firsts) / np.add.reduceat(size, firsts)[:, None]


def scores(model: Model, lookup: np.ndarray, column: pa.Array) -> np.ndarray:
    """Text by language: the regression's outputs."""

    def outputs(p: np.ndarray) -> np.ndarray:
        return (p @ model.weights) / np.maximum(np.sqrt(p @ model.squares), 1e-6)[:, None]

    return by_text(outputs, column, len(model.grams), lookup)


def sample(docs: DataFrame, text: str, label: str, per_label: int) -> DataFrame:
    """At most about ``per_label`` rows of each label, chosen by a hash of the
    text; repeated texts count once. One row per label is counted first."""
    usable = (
        docs.filter(F.col(label).isNotNull() & has_letter(F.col(text)))
        .filter(F.octet_length(text) <= LONGEST_TRAINING_TEXT)
        .select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(text, F.lit(6)).alias("_h"))
    )
    share = F.least(F.lit(1.0), F.lit(1.3 * per_label) / F.col("_n"))
    counts = usable.groupBy("label").agg(F.count("*").alias("_n")).select("label", share.alias("_share"))
    chosen = usable.join(F.broadcast(counts), "label").filter(
        F.pmod("_h", F.lit(1_000_000)) < F.col("_share") * 1_000_000
    )
    return chosen.select("text", "label", "_h").dropDuplicates(["_h"])


def train(docs: DataFrame, text: str = "text", label: str = "lang", ridge: float = 0.1) -> Model | None:
    """Fits the model on a bounded sample of the labelled rows of ``docs``:
    TRAINING texts per label, LANDMARKS of them as landmarks. None without
    labelled texts. Null labels and texts without letters are not learned."""
    rows = sorted((r["label"], r["_h"], r["text"]) for r in sample(docs, text, label, TRAINING).collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rows = [r for language in languages for r in [x for x in rows if x[0] == language][:TRAINING]]
    rank: dict[str, int] = {}
    chosen = []
    for i, r in enumerate(rows):
        rank[r[0]] = rank.get(r[0], 0) + 1
        if rank[r[0]] <= LANDMARKS:
            chosen.append(i)
    texts = pa.array([r[2].lower() for r in rows], pa.large_string())
    # the grams that most landmarks have, with the weight of a rare one higher
    codes, count = gram_counts(rows[i][2].lower() for i in chosen)
    most = np.sort(np.argsort(-count, kind="stable")[:VOCABULARY])
    grams, count = codes[most], count[most]
    model = Model(languages, grams, np.zeros((len(grams), len(languages)), np.float32), np.zeros(len(grams), np.float32))
    model.squares = np.log((1.0 + len(chosen)) / count).astype(np.float32) + 0.05
    lookup = model.lookup()

    def normed(p: np.ndarray) -> np.ndarray:
        return p / np.maximum(np.sqrt(p @ model.squares), 1e-6)[:, None]

    landmarks = by_text(normed, texts.take(pa.array(chosen)), len(grams), lookup)
    weighted = (landmarks * model.squares).T
    kernel = by_text(lambda p: normed(p) @ weighted, texts, len(grams), lookup)
    own = kernel[chosen]
    target = np.where(np.array([r[0] for r in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # each language weighs the same, whatever its share of the sample
    share = 1.0 / np.array([sum(r[0] == x[0] for r in rows) for x in rows])
    left = (kernel * share[:, None]).T @ kernel + ridge / len(rows) * own + 1e-9 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, (kernel * share[:, None]).T @ target)
    model.weights = (weighted @ alpha).astype(np.float32)
    del rows, texts, lookup, landmarks, weighted, kernel, own, target, left, alpha
    release_memory()  # the driver goes on without the sample
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score``.

    Only the text decides. The score is the winning output mapped from -1..1 to
    0..1. A text that is null or has no letter, or any text without a model, is
    ``und`` with score 0; ties go to the language first in the alphabet. Rows
    are scored where they lie: no shuffle."""
    bounded_batches(docs.sparkSession)
    known = F.lit(model is not None) & has_letter(F.col(text))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    lowered = docs.select(*kept, F.when(known, F.lower(text)).alias("_lowered"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    languages = np.array(model.languages, object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lookup = sent.value, None
        for batch in batches:
            lookup = table.lookup() if lookup is None else lookup
            column = batch.column(batch.schema.get_field_index("_lowered"))
            s = scores(table, lookup, column)
            best = s.argmax(axis=1) if len(s) else np.zeros(0, int)
            value = np.clip((s[np.arange(len(s)), best] + 1) / 2, 0.0, 1.0).astype(np.float64)
            null = np.asarray(column.is_null())
            value[null] = 0.0
            pred = np.where(null, UNKNOWN, languages[best])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(pred, pa.string()), pa.array(value)], [*kept, "lang_pred", "score"]
            )

    fields = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return lowered.mapInArrow(releasing(score), fields)

"""Embedding whitening with covariances by polarisation.

Entries become whole numbers, so all sums are exact. For every dimension and
every sum of two dimensions the squares of the centred values are added up;
half the difference between the variance of a sum and the variances of its
parts is the covariance of the two. The matrix goes through ``eigh`` on the
driver: its size is the number of dimensions squared, whatever the rows.

Values are centred on the whole number nearest their mean before they are
squared, which keeps squares small; what is left of the mean is taken out of
the sums exactly: with z = x - m and r = sum of z, n times the sum of
(x - mean)^2 is n * sum of z^2 - r^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import Scratch, bounded_batches

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 40)  # entries from here on count as not finite: sums of their squares would leave 38 digits
ROWS = 4096  # rows whose squares are added in 64 bits
SUMS = "i int, j int, total decimal(38,0)"


def whole_numbers(vector: str) -> Column:
    """floor(64 c) + 1000000 of every entry; null for a vector that is null,
    empty or has an entry that is null, not finite, or 2^40 and more."""
    values = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (F.size(values) > 0)
    return F.when(usable, F.transform(values, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims).astype(np.int64, copy=False)


def _sum_batch(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.int32()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([int(sums[k]) for k in keys], pa.decimal128(38, 0)),
        ],
        ["i", "j", "total"],
    )


def _exact(fit: DataFrame, add, dims: int) -> dict[tuple[int, int], int]:
    """The sums that ``add(totals, rows)`` makes of a task's rows, added up
    over all tasks. One row per pair of dimensions comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = rows_of(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                add(totals, x[at : at + ROWS])
        yield _sum_batch(totals)

    summed = fit.select("x").mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("total").alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in summed.toLocalIterator()}


def _put(totals: dict, keys: list[tuple[int, int]], values) -> None:
    for k, v in zip(keys, values):
        totals[k] = totals.get(k, 0) + int(v)


def dimension_sums(fit: DataFrame, dims: int) -> list[int]:
    keys = [(i, i) for i in range(dims)]

    def add(totals: dict, x: np.ndarray) -> None:
        big = np.abs(x).max(initial=0) >= 1 << 48
        _put(totals, keys, (x.astype(object) if big else x).sum(axis=0))

    found = _exact(fit, add, dims)
    return [found[k] for k in keys]


def squared_sums(fit: DataFrame, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """Sum of z_i^2 under (i, i) and of (z_i + z_j)^2 under (i, j), i < j, for
    z = x - centre."""
    dims = len(centre)
    rest = [[(i, j) for j in range(i, dims)] for i in range(dims)]

    def add(totals: dict, x: np.ndarray) -> None:
        z = x - centre
        # (2 z)^2 * ROWS has to stay within 64 bits
        if np.abs(z).max(initial=0) >= 1 << 24:
            z = z.astype(object)
        for i in range(dims):
            both = z[:, i : i + 1] + z[:, i:]
            both[:, 0] = z[:, i]
            _put(totals, rest[i], (both * both).sum(axis=0))

    return _exact(fit, add, dims)


def polarised(squares: dict[tuple[int, int], int], r: list[int], n: int) -> np.ndarray:
    """The covariance matrix, each entry rounded once from its exact value."""
    dims = len(r)

    def centred(i: int, j: int) -> int:
        left = r[i] if i == j else r[i] + r[j]
        return n * squares[i, j] - left * left  # n * sum of squares around the mean

    own = [centred(i, i) for i in range(dims)]
    out = np.zeros((dims, dims))
    for i in range(dims):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = (centred(i, j) - own[i] - own[j]) / (2 * n * n)
    return out


@dataclass
class Whitening:
    n: int
    centre: np.ndarray  # whole numbers nearest the means
    rest: list[int]  # sum of x - centre by dimension
    directions: np.ndarray  # dimension by component, divided by the root of the eigenvalue
    explained: np.ndarray
    usable: np.ndarray  # components whose variance is more than rounding

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - np.array([r / self.n for r in self.rest])) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        z = x - self.centre
        about = np.square(self.n * z.astype(float) - np.array(self.rest, float)).sum(axis=1)
        if about.max(initial=0.0) < float(1 << 61):
            return np.square(self.n * z - np.array(self.rest, np.int64)).sum(axis=1).tolist()
        exact = (sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest)) for row in z)
        return [d if d < 1 << 63 else None for d in exact]


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Fits on every row of ``fit`` (column x). None without rows."""
    n = fit.count()
    if not n:
        return None
    sums = dimension_sums(fit, dims)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    squares = squared_sums(fit, np.array(centre, np.int64))
    rest = [s - n * m for s, m in zip(sums, centre)]
    covariance = polarised(squares, rest, n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    usable = values > dims * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
    scale = np.where(usable, 1.0 / np.sqrt(np.where(usable, values, 1.0)), 0.0)
    explained = np.where(usable, values, 0.0) / trace if trace > 0 else np.full(len(values), np.nan)
    return Whitening(n, np.array(centre, np.int64), rest, vectors * scale, explained, usable)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over
    the usable components."""
    dims, k = len(model.rest), len(model.usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.apply(rows_of(batch.column(0), dims))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.divmod(np.arange(total.size), k)
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1, k))
    for r in parts.collect():  # one row per pair of components
        total[r["i"], r["j"]] = r["total"]
    mean = total[k] / model.n
    error = np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(model.usable, model.usable)]
    return float(error.max()) if error.size else None


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """One row per row of ``vectors`` and component: key, component, n,
    deviation, whitened, explained, identity_error.

    Entries are taken in steps of 1/64. Rows whose vector is null, empty or has
    a null or non-finite entry are left out, as are vectors that are not as
    long as most (of lengths equally frequent the largest counts); entries of
    2^40 and more count as not finite. Each distinct vector counts once in the
    fit, however often it is repeated; null and repeated keys stay. A component
    without variance has ``explained`` 0 and a null ``whitened`` (all are such
    if there is one distinct vector; then ``explained`` is null as well).
    ``deviation`` is null where it leaves 64 bits. Further columns are ignored;
    an empty table gives no rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    fields = vectors.select(key).schema
    for name in ("component", "n", "deviation", "whitened", "explained", "identity_error"):
        fields = fields.add(name, "integer" if name == "component" else "long" if name in ("n", "deviation") else "double")
    rows = vectors.select(F.col(key).alias("key"), whole_numbers(vector).alias("x")).filter("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], fields)
    dims = usual["d"]
    rows = rows.filter(F.size("x") == dims)
    scratch = Scratch(spark)
    fit = scratch.write(rows.select("x").distinct())
    model = fit_whitening(fit, dims, components)
    error = identity_error(fit, model)
    scratch.drop(fit)
    from pyspark.sql.pandas.types import to_arrow_type

    key_type, k = to_arrow_type(fields[0].dataType), len(model.usable)
    explained = [None if np.isnan(e) else float(e) for e in model.explained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), dims)
            count = len(x)
            place = np.repeat(np.arange(count), k)
            whitened = pa.array(model.apply(x).ravel(), mask=np.tile(~model.usable, count))
            deviation = pa.array(model.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place)).cast(key_type),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, model.n, np.int64)),
                    deviation.take(pa.array(place)),
                    whitened,
                    pa.array(explained * count, pa.float64()),
                    pa.array([error] * (count * k), pa.float64()),
                ],
                fields.names,
            )

    return rows.select("key", "x").mapInArrow(run, fields)

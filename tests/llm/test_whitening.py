"""Whitening against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tapewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n int"


def plain(rows, components=16):
    """(x by row place, n, sums, exact covariance, eigenvalues, vectors)."""
    kept = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            kept[i] = tuple(math.floor(64 * c) + 1_000_000 for c in v)
    fit = sorted(set(kept.values()))
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(dims)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(dims):
            covariance[i, j] = Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    return kept, n, sums, covariance, values[order], vectors[:, order]


def check(got, rows, dims, components=16):
    kept, n, sums, covariance, values, vectors = plain(rows, components)
    k = min(components, dims)
    assert len(got) == len(kept) * k and {r.n for r in got} == {n}
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = np.zeros(k)
    for i, x in kept.items():
        rows_of_key = by_key[rows[i][0]]
        assert sorted(rows_of_key) == list(range(1, k + 1))
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        centred = np.array([float(Fraction(n * v - s, n)) for v, s in zip(x, sums)])
        for c in range(k):
            expected = float(centred @ vectors[:, c] / np.sqrt(values[c]))
            near = [r for r in rows_of_key[c + 1] if r.deviation == deviation and abs(abs(r.whitened) - abs(expected)) < 1e-7]
            assert near
            if abs(expected) > 1e-3 and len(rows_of_key[c + 1]) == 1:
                sign = np.sign(near[0].whitened * expected)
                assert signs[c] in (0, sign)
                signs[c] = sign
            assert near[0].explained == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
    assert {r.identity_error for r in got if r.identity_error is not None} == {got[0].identity_error}
    assert got[0].identity_error < 1e-9


def vectors(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(0, 0.3, (n, dims)) @ rng.normal(0, 1, (dims, dims))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], SCHEMA)


@pytest.mark.parametrize("dims, components", [(5, 16), (24, 16), (7, 3)])
def test_whitening_against_fractions(spark, monkeypatch, dims, components):
    monkeypatch.setattr(whitening, "ROWS", 13)
    rows = vectors(150, dims)
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(1, rows[9][1]), (None, rows[8][1])]
    rows += [(-1, None), (-2, [None] * dims), (-3, [float("nan")] * dims), (-4, [float("inf")] + [0.0] * (dims - 1)), (-5, [])]
    got = whitening.whiten(frame(spark, rows).repartition(5), components=components).collect()
    check(got, rows, dims, components)


def test_table_against_numpy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    check(whitening.whiten(table).collect(), rows, 64)


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e11 + i * 1e9, -5e8 * (i % 7), float(i)]) for i in range(40)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept, n, sums, covariance, values, _ = plain(rows)
    got = whitening.whiten(wide).collect()
    assert {r.n for r in got} == {n}
    for i, x in kept.items():
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        assert {r.deviation for r in got if r.vec_id == i} == {deviation if deviation < 2**63 else None}
    assert got[0].explained == pytest.approx(values[0] / np.trace(covariance), rel=1e-9)


def test_polarised_entries_are_the_exact_covariance():
    rng = np.random.default_rng(5)
    x = rng.integers(10**6 - 500, 10**6 + 500, (31, 6))
    n, centre = len(x), [(2 * int(s) + 31) // 62 for s in x.sum(axis=0)]
    z = x - np.array(centre)
    squares = {(i, j): int(((z[:, i] + z[:, j]) ** 2).sum()) if i < j else int((z[:, i] ** 2).sum()) for i in range(6) for j in range(i, 6)}
    found = whitening.polarised(squares, [int(v) for v in z.sum(axis=0)], n)
    sums = [int(s) for s in x.sum(axis=0)]
    for i in range(6):
        for j in range(6):
            exact = Fraction(sum((n * int(a) - sums[i]) * (n * int(b) - sums[j]) for a, b in x[:, [i, j]]), n**3)
            assert found[i, j] == float(exact)


def test_without_variance_and_without_rows(spark):
    same = whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0]) for i in range(5)])).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: r.component)] == [False] * 5 + [True] * 5
    assert {r.explained for r in flat if r.component == 2} == {0.0}
    odd = whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0])])).collect()
    assert {r.vec_id for r in odd} == {2, 3}
    for empty in ([], [(1, None)]):
        assert whitening.whiten(frame(spark, empty)).collect() == []

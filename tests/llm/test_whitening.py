"""Whitening against exact sums and a dense solver."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from lotwise.llm import sums, whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n int, y int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 7, 1) for i, v in vectors], SCHEMA)


def made(n=300, dim=20, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) + rng.normal(size=dim) * 3).astype(np.float32)
    x[40:60] = x[7]
    return [(3 * i, [float(v) for v in x[i]]) for i in range(n)]


ODD = [None, [], [None] + [1.0] * 19, [float("nan")] * 20, [float("inf")] + [1.0] * 19, [1.0, 2.0], [5.0] * 21]


def check(rows, got, k):
    good = [(i, v) for i, v in rows if v is not None and len(v) == len(rows[0][1]) and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, [floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(x) for _, x in xs})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s)] for x in fit])
    v = centred.T @ centred / n
    e = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == k * len(good)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for i, x in xs:
        assert all(int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s)) and r.n == n for r in by[i])
        assert sorted(r.component for r in by[i]) == sorted(list(range(1, k + 1)) * (len(by[i]) // k))
    where = {tuple(x): i for i, x in xs}
    w = np.array([[{r.component: r.whitened for r in by[where[x]]}[c] for c in range(1, k + 1)] for x in fit])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-10
    # each column is a unit vector of the covariance: its projections give it back
    for c in range(k):
        vector = centred.T @ w[:, c] / n / np.sqrt(e[c])
        assert abs(np.linalg.norm(vector) - 1) < 1e-10
        assert np.abs(v @ vector - e[c] * vector).max() < 1e-10 * e[0]
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[c] for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9, atol=0)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-10


def test_matches_exact_sums(spark):
    rows = made() + [(1000 + i, v) for i, v in enumerate(ODD)] + [made()[5], made()[5], (None, [1.0] * 20)]
    check(rows, wh.whiten(table(spark, rows)).collect(), 16)


def test_fewer_dimensions_than_components(spark):
    rows = made(dim=3)
    check(rows, wh.whiten(table(spark, rows)).collect(), 3)


def test_no_variance_no_rows(spark):
    names = wh.whiten(table(spark, made(n=20))).columns
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = wh.whiten(table(spark, rows))
        assert out.collect() == [] and out.columns == names


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(2 * a), 5.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, (80, 2)))]
    check(rows, wh.whiten(table(spark, rows)).collect(), 2)


def test_too_large_components_say_so(spark):
    with pytest.raises(Exception, match="too large to whiten"):
        wh.whiten(table(spark, [(1, [1e30, 0.0]), (2, [1.0, 2.0])])).collect()


def test_exact_deviations_beyond_64_bits():
    model = wh.Whitening(2, 3_000_000_000, [5, -7], np.eye(2), np.ones(2), 1.0)
    y = np.array([[40, -3], [0, 2_000_000]])
    want = [sum((model.n * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in y]
    assert [int(v) for v in model.deviation(y).to_pylist()] == want
    assert np.allclose(model.centred(y), y, rtol=1e-8)


@pytest.mark.parametrize("spectrum", [
    [5, 4, 3, 2, 1], [2, 2, 2, 1, 1], [1, 1 + 1e-9, 1 - 1e-9, 0.5, 0.5 + 1e-13], [1e12, 1e3, 1, 1e-3, 0], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]])
def test_eigenvectors_to_double_precision(spectrum):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    a = (q * np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    values, vectors = wh.eigenvectors(a)
    size = max(1e-300, np.abs(a).max())
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * size
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=0, atol=1e-14 * size)


def test_separated_vectors_are_better_than_float32():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    a = (q * np.linspace(1, 40, 40)) @ q.T
    values, vectors = wh.eigenvectors((a + a.T) / 2)
    assert np.abs(np.abs((vectors[:, ::-1] * q).sum(axis=0)) - 1).max() < 1e-13
    assert np.abs(vectors[:, ::-1] * np.sign((vectors[:, ::-1] * q).sum(axis=0)) - q).max() < 1e-12


def test_merged_sums_many_parts(spark):
    import pyarrow as pa

    def part(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([np.array([i, 1], "<i8").tobytes()], pa.binary())], names=["part"])

    old, sums.TAKEN = sums.TAKEN, 64
    try:
        assert sums.merged(spark.range(100).mapInArrow(part, "part binary"), "<i8", 2).tolist() == [4950, 100]
        assert sums.merged(spark.range(0).mapInArrow(part, "part binary"), "<i8", 2).tolist() == [0, 0]
    finally:
        sums.TAKEN = old

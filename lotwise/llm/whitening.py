"""Whitening of embeddings: principal components in double precision from float32 eigenvectors, corrected by iteration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.llm.blocks import finite
from lotwise.llm.sums import merged
from lotwise.scale import settle

# A component c becomes the whole number floor(SCALE * c) + OFFSET; fixed values.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
# Whole numbers below this size are summed and squared exactly.
LARGEST = 1 << 31
# Steps of the correction at most, and the change from which on it is done.
STEPS, DONE = 30, 1e-15


def whole(vector: Column) -> Column:
    """floor(SCALE * c) of each component, as int; a component too large for that is an error that says so."""
    def one(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(c.cast("double") * SCALE) < LARGEST, scaled.cast("int")).otherwise(
            F.raise_error(F.lit(f"components of {LARGEST // SCALE} and more are too large to whiten exactly")).cast("int"))

    return F.transform(vector, one)


def clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of two or more neighbours in `values` (falling) that are less than `gap` apart."""
    edge = np.flatnonzero(np.concatenate([[True], values[:-1] - values[1:] >= gap, [True]]))
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:]) if b - a > 1]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, in double precision.

    float32 eigenvectors come first. Each step of the correction (Ogita and Aishima 2018) is four matrix products in the
    widest floating type at hand: with R = I - X'X and S = X'AX, the eigenvalues are S_ii / (1 - R_ii), and X moves by
    X E, E_ij = (S_ij + l_j R_ij) / (l_j - l_i). Eigenvalues closer than the error of S can't be parted that way; there
    E_ij = R_ij / 2 keeps the vectors orthogonal, and the cluster is solved by itself: the eigenvectors of its small block
    X_c'(A - mu)X_c, less the middle mu so that no digit is lost, turn its vectors (Ogita and Aishima 2019).
    """
    size = float(np.abs(a).max()) if a.size else 0.0
    if size == 0 or not np.isfinite(size):
        return np.zeros(len(a)), np.eye(len(a))
    wide = np.asarray(a, np.longdouble) / size
    values, x = np.linalg.eigh((np.asarray(a, float) / size).astype(np.float32))
    values, x = values[::-1].astype(np.longdouble), x[:, ::-1].astype(np.longdouble)
    unit = np.eye(len(a), dtype=np.longdouble)
    for _ in range(STEPS):
        r, s = unit - x.T @ x, x.T @ (wide @ x)
        values = s.diagonal() / (1 - r.diagonal())
        order = np.argsort(-values, kind="stable")
        values, x, r, s = values[order], x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        error = 2 * (np.linalg.norm(off.astype(float)) + np.abs(values).max() * np.linalg.norm(r.astype(float)))
        # what the products round is no gap
        error = max(error, 64 * len(a) * np.finfo(np.longdouble).eps * np.abs(values).max())
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= error
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        for c in clusters(values, error):
            x[:, c] = _turned(wide, x[:, c])
        if np.abs(e).max() < DONE:
            break
    for _ in range(2):
        x = x @ (3 * unit - x.T @ x) / 2
    values = ((x * (wide @ x)).sum(axis=0) / (x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * size).astype(float), x.astype(float)


def _turned(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The vectors `x` of a cluster, turned to the eigenvectors of their own small block of `a`."""
    for _ in range(3):
        middle = ((x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)).mean()
        block = x.T @ (a @ x - middle * x)
        block = (block + block.T) / 2
        spread = float(np.abs(block).max())
        if spread == 0:
            return x
        _, turn = np.linalg.eigh((block / spread).astype(float))
        turn = turn[:, ::-1].astype(np.longdouble)
        # the turn itself to the wide type: one step towards an orthogonal matrix
        turn = turn + turn @ (np.eye(len(turn), dtype=np.longdouble) - turn.T @ turn) / 2
        x = x @ turn
    return x


@dataclass
class Whitening:
    """What `fit` learned: n distinct vectors with per-dimension sums (of the whole numbers without OFFSET), and the
    components with their eigenvalues."""

    dim: int
    n: int
    sums: list[int]
    components: np.ndarray  # dim x k
    eigenvalues: np.ndarray  # k
    trace: float
    identity_error: float = 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        """y - sums / n, each to the last bit: the whole part of the mean is taken off before the fraction."""
        low, rest = self._mean()
        return (y - low).astype(float) - rest / max(self.n, 1)

    def deviation(self, y: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * y - sums)^2, exact."""
        low, rest = self._mean()
        off = y - low
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * max(self.dim, 1) < 1 << 63:
            return pa.array(((self.n * off - rest) ** 2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest.tolist())) for row in off.tolist()]
        return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.components / np.sqrt(self.eigenvalues)

    def _mean(self) -> tuple[np.ndarray, np.ndarray]:
        low = [s // max(self.n, 1) for s in self.sums]
        return np.array(low, np.int64), np.array([s - q * self.n for s, q in zip(self.sums, low)], np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _gram(distinct: DataFrame, dim: int, size: int, project) -> np.ndarray:
    """Sum over the vectors of p p', p = project(vector): each task adds up its own, the tasks' sums are merged."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            p = project(_matrix(batch.column(0), dim))
            total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return merged(distinct.mapInArrow(partial, "part binary"), "<f8", size * size).reshape(size, size)


def _sums(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their sum per dimension, exact."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            y = _matrix(batch.column(0), dim)
            n, total = n + len(y), [a + b for a, b in zip(total, y.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
            names=["place", "n", "total"])

    tasks = distinct.mapInArrow(partial, "place int, n bigint, total decimal(38,0)")
    rows = tasks.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("place").collect()
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [0] * dim)


def fit(numbers: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Learn from `numbers` (y array<int>, all of one length), each distinct vector once. The driver holds matrices of
    dimensions x dimensions, whatever the number of vectors."""
    distinct = settle(numbers.select("y").distinct())
    first = distinct.first()
    dim = len(first.y) if first else 0
    if not dim:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = _sums(distinct, dim)
    model = Whitening(dim, n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    covariance = _gram(distinct, dim, dim, model.centred) / n
    values, vectors = eigenvectors(covariance)
    # directions in which the vectors don't differ have no scale to divide by
    k = min(components, int((values > max(values[0], 0) * dim * 1e-15).sum()))
    model.components, model.eigenvalues, model.trace = vectors[:, :k], values[:k], float(np.trace(covariance))
    if k:
        unit = _gram(distinct, dim, k, model.whitened) / n
        model.identity_error = float(np.abs(unit - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component from 1, n, deviation decimal, whitened, explained, identity_error) for each row of `vectors` and
    each of the first `components` components; see the fields of Whitening.

    Rows whose vector is null, empty, or holds nulls, NaN or infinities are left out, and so are vectors whose length is
    not the most frequent one (the larger of equally frequent). Repeated rows count once in the fit and each get their
    own rows; a null key is kept. Components without variance are left out, so equal vectors give no rows, and neither
    does an empty table. `deviation` is null from 10^38 on. Other columns play no part.
    """
    rows = vectors.where(finite(F.col(vector))).select(F.col(key).alias("key"), whole(F.col(vector)).alias("y"))
    length = rows.groupBy(F.size("y").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    rows = rows.where(F.size("y") == (length.dim if length else 0))
    model = fit(rows, components)
    k = len(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column("y"), model.dim)
            flat = pa.array(model.whitened(y).ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(y) + 1, k), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), model.deviation(y), lists], names=["key", "deviation", "whitened"])

    key_type = vectors.schema[key].dataType.simpleString()
    if not k:
        return vectors.sparkSession.createDataFrame(
            [], f"`{key}` {key_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    found = rows.mapInArrow(project, f"key {key_type}, deviation decimal(38,0), whitened array<double>")
    return found.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))

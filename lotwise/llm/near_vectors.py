"""Near-duplicate vectors: all pairs by int8 tile products, the doubtful ones in full precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lotwise.llm.blocks import finite, in_blocks, unpack
from lotwise.llm.graph import components
from lotwise.scale import settle

THRESHOLD = 0.95
ROWS_IN_BLOCK = 4096
# Pairs that are recomputed at a time, and dimensions whose int8 products add up exactly in float32.
PAIRS_AT_ONCE, EXACT_DIMS = 200_000, 1024
# More than all rounding errors of a dot product of unit vectors in double precision.
ROUNDING = 1e-12


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the rows of x as int8 q with a scale each, and error bounds: |u - scale * q| <= error."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(u - scale[:, None] * q, axis=1) + ROUNDING
    return q, scale, error


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of int8 matrices: float32 holds every partial sum of up to EXACT_DIMS products."""
    total = 0
    for at in range(0, a.shape[1], EXACT_DIMS):
        total = total + (a[:, at:at + EXACT_DIMS].astype(np.float32) @ b[:, at:at + EXACT_DIMS].astype(np.float32).T)
        total = total.astype(np.float64) if a.shape[1] > EXACT_DIMS else total
    return total


def doubtful(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of quantised rows whose cosine may reach the threshold.

    With u = s q + e and v = t r + f, u.v = s t q.r + e.v + s q.f. As |v| = 1 and |s q| <= 1 + |e|, the int8 product is
    off by |e| + (1 + |e|) |f| at most. The largest |f| of the block stands for all of them.
    """
    (q, s, e), (r, t, f) = a, b
    off = e + (1 + e) * f.max()
    least = ((threshold - off) / s - ROUNDING).astype(np.float64)
    products = int8_products(q, r)
    # one more float32 rounding in the scaled product
    close = products * t[None, :].astype(products.dtype) >= (least - np.abs(least) * 1e-6)[:, None].astype(products.dtype)
    return np.nonzero(close)


def linked(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) have a cosine of at least the threshold, in double precision."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    found = np.empty(len(i), bool)
    for at in range(0, len(i), PAIRS_AT_ONCE):
        a, b = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
        found[at:at + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return found


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links (a, b) among n nodes, the smallest node of each one's component."""
    label = np.arange(n)
    while (label[a] != label[b]).any():
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): n_links, the number of other rows whose cosine with it is at
    least `threshold` in double precision; component_id, the smallest vec_id reachable by links; kept.

    Equal vectors are one class, so copies cost no pairs. Classes stand in blocks of bounded size; a task multiplies
    two blocks as int8 and recomputes only the pairs that the error bounds leave open. It returns a row per linked
    vector, not per pair: the number of links, and a link to the smallest vector of its component in the tile. All
    blocks meet all blocks: the work grows with the square of the classes, the memory of a task does not.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without
    vec_id (their component_id is null). Vectors of different dimensions do not meet. Repeated rows link with each
    other. Other columns are left out; no rows give no rows.
    """
    x = F.col("embedding")
    usable = finite(x) & F.exists(x, lambda c: c != 0) & F.col("vec_id").isNotNull()
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("id"), F.when(usable, x.cast("array<double>")).alias("vector"))
    classes = settle(
        rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("vector")))
    n_blocks = -(-classes.count() // ROWS_IN_BLOCK) or 1
    # the number of copies rides along as a last component
    carried = F.concat("vector", F.array(F.col("copies").cast("double")))
    blocks = settle(in_blocks(classes.select("id", "dim", carried.alias("vector")), F.col("id"), n_blocks))

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, data = unpack(row.ids, row.data)
                x, copies = data[:, :-1], data[:, -1]
                other_ids, data = unpack(row.other_ids, row.other_data)
                y, other_copies = data[:, :-1], data[:, -1]
                i, j = doubtful(quantise(x), quantise(y), threshold)
                if row.block == row.other:
                    i, j = i[i < j], j[i < j]
                sure = linked(x, y, i, j, threshold)
                i, j = i[sure], j[sure]
                if row.block == row.other:
                    both, k = ids, j
                else:
                    both, k = np.concatenate([ids, other_ids]), j + len(ids)
                links = np.zeros(len(both))
                np.add.at(links, i, other_copies[j])
                np.add.at(links, k, copies[i])
                order = np.argsort(both)
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                root = both[order][roots(len(both), place[i], place[k])[place]]
                has = links > 0
                yield pd.DataFrame({"id": both[has], "links": links[has].astype(np.int64), "root": root[has]})

    pairs = blocks.select(
        "dim", "block", "ids", "data", F.explode(F.sequence("block", F.lit(n_blocks - 1))).alias("other"))
    others = blocks.select("dim", F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("data").alias("other_data"))
    tiles = pairs.join(others, ["dim", "other"]).select("block", "other", "ids", "data", "other_ids", "other_data")
    found = settle(tiles.mapInPandas(tile, "id bigint, links bigint, root bigint"))
    near = components(found.where("id <> root").select("id", "root"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("vector", "id", "copies").join(links, "id", "left")
        .join(near, F.col("id") == F.col("node"), "left")
        .select(
            "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"))
    )
    return rows.join(of_class, "vector", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))

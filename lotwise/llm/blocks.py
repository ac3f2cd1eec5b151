"""Vectors in blocks: a row holds the numbers and components of up to some thousand vectors as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """True for vectors with at least one component, none of them null, NaN or infinite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def in_blocks(vectors: DataFrame, key: Column, n_blocks: int) -> DataFrame:
    """`vectors` (id bigint, dim int, vector array<double>) dealt to `n_blocks` blocks per dimension by the hash of
    `key`: rows (dim, block, n, ids binary, data binary), ids ascending, data float64 by rows."""
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (dim, block), rows in _runs(batches):
            data = np.stack(rows.vector.to_numpy()).astype("<f8", copy=False)
            yield pd.DataFrame({
                "dim": [dim], "block": [block], "n": [len(rows)],
                "ids": [rows.id.to_numpy("<i8").tobytes()], "data": [data.tobytes()]})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int"))
    together = dealt.select("dim", "block", "id", "vector").repartition("dim", "block").sortWithinPartitions("dim", "block", "id")
    return together.mapInPandas(join, "dim int, block int, n int, ids binary, data binary")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """Consecutive rows of one block, also across batches."""
    held: list[pd.DataFrame] = []
    name = None
    for batch in batches:
        for key, rows in batch.groupby(["dim", "block"], sort=True):
            if key != name and held:
                yield name, pd.concat(held)
                held = []
            name = key
            held.append(rows)
    if held:
        yield name, pd.concat(held)


def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(data, "<f8").reshape(len(numbers), -1)

"""Arrays that tasks add up, merged as a tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.scale import settle

# So many partial arrays are merged by one task; so many bytes of them at most are taken to the driver, or one array.
MERGED, TAKEN = 8, 1 << 24


def merged(parts: DataFrame, dtype: str, size: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
    """The sum (or what else `add` does) of the arrays in `parts` (part binary: `size` items of `dtype`), zeros if there
    are none. A task holds MERGED arrays at a time and the driver gets TAKEN bytes, whatever the number of tasks."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for part in batch.column(0):
                total = add(total, np.frombuffer(part.as_buffer(), dtype))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts, total_bytes = settle(parts), size * np.dtype(dtype).itemsize
    n = parts.count()
    while n > max(1, TAKEN // max(total_bytes, 1)):
        parts = settle(parts.repartition(math.ceil(n / MERGED)).mapInArrow(join, "part binary"))
        n = parts.count()
    total = np.zeros(size, dtype)
    for row in parts.collect():
        total = add(total, np.frombuffer(row.part, dtype))
    return total

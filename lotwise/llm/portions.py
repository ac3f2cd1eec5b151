"""Arrow batches cut and joined to portions of about so many bytes, so that tasks use bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PORTION = 8 << 20
# Rows of an Arrow batch of texts, which is held several times over on its way to Python, and Spark's own number.
ROWS_IN_BATCH, USUAL = 1_000, "10000"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ROWS_IN_BATCH rows, unless the session was set to a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == USUAL:
        spark.conf.set(name, ROWS_IN_BATCH)


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = PORTION) -> Iterator[pa.Table]:
    """The rows of `batches` in order, in tables whose strings in `column` have `most` bytes at most, or in one row."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            # as many rows as fit, one at least
            to = max(int(np.searchsorted(ends, before + most - size, side="right")), at)
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
            if at < len(batch):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

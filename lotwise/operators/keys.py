"""Helpers for grouping keys: null-safe joins and hash buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet null keys, as they do in a grouping.

    Keeps the left key columns. No side is broadcast by hint: the planner does
    so by size and AQE splits a hot key of the larger side. Without keys, the
    right side is one row.
    """
    if not keys:
        return with_one_row(left, right)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row frame beside every row, by a scalar subquery."""
    packed = one.select(F.struct(*[F.col(c) for c in one.columns])).scalar()
    return df.withColumn("__one", packed).select(
        *df.columns, *[F.col("__one").getField(c).alias(c) for c in one.columns]
    )


def hash_bucket(keys: Sequence[str], n: int, seed: int = 0) -> Column:
    """Seeded bucket 0..n-1 of a row's key; the same on every run and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(n)).cast("int")


def total_order(df: DataFrame, first: Sequence[Column]) -> list[Column]:
    """`first`, then every column: equal rows apart, no ties are left."""
    return [*first, *[F.col(c).asc_nulls_first() for c in df.columns]]

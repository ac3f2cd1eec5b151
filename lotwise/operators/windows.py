"""Ranking inside keys: latest row, best source, first of a key, arg-min and arg-max.

Each keeps the first row of a key only, so Spark cuts every map task down to one
row per key before the shuffle (WindowGroupLimit); a hot key costs no more than
one row per task. Ties end in an order over all columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.operators.keys import total_order
from lotwise.operators.quantiles import quantile_table


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*total_order(df, order))
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def latest_per_key(df: DataFrame, key: str | Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Newest row per key, unknown times last; rows without a key count as one key."""
    keys = [key] if isinstance(key, str) else list(key)
    return first_per_key(df, keys, [F.desc_nulls_last(ts), *[F.asc(t) for t in tie]])


def best_source(df: DataFrame, key: str | Sequence[str], rank: str, tie: Sequence[str] = ()) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return first_per_key(df, keys, [F.desc_nulls_last(rank), *[F.asc(t) for t in tie]])


def dedup_subset(df: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    return first_per_key(df, keys, [F.asc(t) for t in tie])


def arg_row(
    df: DataFrame, keys: Sequence[str], col: str, kind: str = "min", tie: Sequence[str] = ()
) -> DataFrame:
    """The row holding the smallest or largest known value of each group."""
    known = df.where(F.col(col).isNotNull())
    first = F.asc(col) if kind == "min" else F.desc(col)
    return first_per_key(known, keys, [first, *[F.asc(t) for t in tie]])


def rank_within(
    df: DataFrame, parent: str, child: str, col: str, min_n: int = 1, *, strategy: str | None = None
) -> DataFrame:
    """Dense rank of each child in its parent by median; children below `min_n` rows are left out."""
    medians = quantile_table(
        df, [parent, child], {"median": (col, 0.5)}, aggs=[F.count(F.lit(1)).alias("n")], strategy=strategy
    ).where(F.col("n") >= min_n)
    order = Window.partitionBy(parent).orderBy("median")
    return medians.withColumn("rank", F.dense_rank().over(order))

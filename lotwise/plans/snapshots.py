"""Merging market snapshots and measuring what changed between them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from lotwise.operators.match import pair_snapshots
from lotwise.operators.quality import near_dup_audit, pair_drift, segment_drift
from lotwise.operators.stats import n_rows
from lotwise.operators.windows import best_source, dedup_subset, latest_per_key
from lotwise.scale import settle
from lotwise.sources.files import tag_snapshot, union_all


# Rows that a task sorts or counts by key at a time, about.
ROWS_IN_PART = 500_000


def by_key(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt by key to as many parts as its rows need, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(1, math.ceil(df.count() / ROWS_IN_PART)), key)


def dedup_latest(df: DataFrame, key: str = "url", ts: str = "index_date") -> DataFrame:
    """One row per key inside a snapshot: the newest."""
    return latest_per_key(by_key(df, key), key, ts)


def merge_snapshots(snapshots: Mapping[str, DataFrame], key: str = "url") -> DataFrame:
    """One row per key over all snapshots (given oldest first); the newest snapshot wins."""
    ranked = [
        tag_snapshot(df, name).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(snapshots.items())
    ]
    return best_source(by_key(settle(union_all(*ranked)), key), key, "_rank").drop("_rank")


def overlap_accounting(snapshots: Mapping[str, DataFrame], key: str = "url") -> DataFrame:
    """Rows per snapshot, rows of the union, keys seen more than once, and who survives.

    Works on (key, snapshot) pairs; newest snapshot = largest rank.
    """
    names = list(snapshots)
    pairs = union_all(*[df.select(key).withColumn("_rank", F.lit(i)) for i, df in enumerate(snapshots.values())])
    per_key = by_key(pairs, key).distinct().groupBy(key).agg(n_rows("_n"), F.max("_rank").alias("_best"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_listed"), n_rows("n_union"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("n_overlap"),
        *[F.count_if(F.col("_best") == i).alias(f"kept_{name}") for i, name in enumerate(names)],
    )


def snapshot_profile(snapshots: Mapping[str, DataFrame], key: str = "url") -> DataFrame:
    """Rows, distinct keys and repeated rows of each snapshot."""
    out = None
    for name, df in snapshots.items():
        row = df.groupBy(key).agg(n_rows("_n")).agg(
            F.lit(name).alias("snapshot"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
            n_rows("n_unique"),
        ).withColumn("n_duplicate", F.col("n_rows") - F.col("n_unique"))
        out = row if out is None else out.unionByName(row)
    return out


def collapse_exact(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per natural key, so that a random split cannot leak copies."""
    return dedup_subset(df, keys)


def merge_report(
    old: DataFrame, new: DataFrame, key: str, natural_key: Sequence[str], segment: Sequence[str], measure: str,
    min_n: int = 30,
) -> dict[str, DataFrame]:
    """Everything known about two snapshots: merged rows, overlap, drift and copies."""
    a, b = dedup_latest(old, key), dedup_latest(new, key)
    merged = merge_snapshots({"old": a, "new": b}, key)
    return {
        "merged": merged,
        "overlap": overlap_accounting({"old": a, "new": b}, key),
        "pair_drift": pair_drift(pair_snapshots(a, b, key, measure), measure),
        "segment_drift": segment_drift(a, b, segment, measure, min_n),
        "near_duplicates": near_dup_audit(merged, natural_key, key),
    }

"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotwise.scale import settle

# Nodes a task holds before it passes on what it has joined.
NODES_AT_ONCE = 50_000
ROUNDS = 60


def stars(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """For links held in memory: each node that has a smaller one in its component -> the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent) if root(x) != x}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, replaced by fewer ones that join the same nodes."""
    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        found = stars(iter(links))
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["u", "v"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) > NODES_AT_ONCE:
            yield out(held)
            held = []
    yield out(held)


def components(links: DataFrame) -> DataFrame:
    """`links` has two bigint columns, in any order of the ends; returns (node, component) for every node of a link
    that is not the smallest of its component.

    Links are first joined inside tasks, then by alternating large-star and small-star rounds: every node takes over
    the smallest neighbour of its neighbours, until all components are stars. Each round is settled in the shared
    folder. Only sums of the links come to the driver. Null ends and loops are ignored; an empty table gives none.
    """
    a, b = links.columns
    edges = (
        links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
        .mapInArrow(_joined, "u bigint, v bigint")
    )
    edges = settle(edges.distinct())
    state = _state(edges)
    for _ in range(ROUNDS):
        # every larger neighbour of a node links to the smallest of the node's neighbours
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node and its smaller neighbours link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        )
        edges = settle(small.distinct())
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of links apart."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(
        F.count("*"), F.sum(mixed.cast("decimal(20,0)")), F.sum(F.shiftright(mixed, 7).cast("decimal(20,0)"))).first())

"""Exact top-k search by inner product: tiles of queries and candidates, merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lotwise.llm.blocks import finite, in_blocks, unpack

QUERIES_IN_BLOCK, ROWS_IN_SHARD = 1024, 8192
# Lists that are merged at a time.
FAN_IN = 16
SCALE = 64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for matrices of whole numbers, as int64: in float32 or float64 where every partial sum is exact in it."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest scores of each row, ties to smaller columns."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    above, equal = scores > bound[:, None], scores == bound[:, None]
    room = k - above.sum(axis=1)
    return np.nonzero(above | equal & (np.cumsum(equal, axis=1) <= room[:, None]))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """For each query among `vectors` (vec_id, embedding) the k rows with the highest inner product of the components
    floor(scale * x): (query_id, rank, vec_id, score), ties to the smaller vec_id; never the query itself.

    Queries and candidates stand in blocks of bounded size; a task multiplies a query block by a shard of candidates and
    keeps k rows per query. Lists are then merged FAN_IN shards at a time, so that no task sees all lists of a query.
    All queries meet all candidates: the work grows as their product, the memory of a task does not.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id. Rows
    of different dimensions do not meet. Repeated rows are a candidate each, but ask once; a query meets no row of its
    own vec_id. Scores must fit into 64 bits. Other columns are left out; no rows give no rows.
    """
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("double"))
    rows = vectors.where(finite(x) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("id"), F.size(x).alias("dim"), whole.alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_shards, n_blocks = -(-n // ROWS_IN_SHARD) or 1, -(-asked // QUERIES_IN_BLOCK) or 1
    key = F.struct("id", "vector")
    shards = in_blocks(rows.select("id", "dim", "vector"), key, n_shards)
    asking = in_blocks(rows.where("asks").select("id", "dim", "vector").distinct(), key, n_blocks).select(
        "dim", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("block"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                query_ids, queries = unpack(row.query_ids, row.query_data)
                ids, candidates = unpack(row.ids, row.data)
                scores = products(queries, candidates)
                least = np.iinfo(np.int64).min
                scores[query_ids[:, None] == ids[None, :]] = least
                i, j = best(scores, k)
                score = scores[i, j]
                keep = score > least
                yield pd.DataFrame({
                    "query_id": query_ids[i][keep], "shard": row.block, "vec_id": ids[j][keep], "score": score[keep]})

    tiles = asking.join(shards, ["dim", "block"])
    lists = tiles.select("block", "query_ids", "query_data", "ids", "data").mapInPandas(
        search, "query_id bigint, shard int, vec_id bigint, score bigint")
    order = (F.col("score").desc(), F.col("vec_id"))
    while n_shards > FAN_IN:
        n_shards = -(-n_shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        rank = F.row_number().over(W.partitionBy("query_id", "shard").orderBy(*order))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

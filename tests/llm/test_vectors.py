"""Vector search and near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import blocks, near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, n_links int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 7) for i, v in vectors], SCHEMA)


def made(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[10:50] + rng.normal(size=(40, dim)) * rng.uniform(0.05, 0.5, (40, 1))
    x[100:130] = x[100] + rng.normal(size=(30, dim)) * 0.02
    x[140:150] = x[140]
    rows = [(int(3 * i), [float(v) for v in x[i]]) for i in range(n)]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    return rows + [(1 + 3 * i, v) for i, v in enumerate(odd)] + [rows[5], rows[5]]


def good(v):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)


@pytest.mark.parametrize("rows_in_block", [17, 4096])
def test_near_vectors(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(near_vectors, "ROWS_IN_BLOCK", rows_in_block)
    rows = made()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(table(spark, rows)).collect())
    links = {k: [] for k in range(len(rows))}
    for a, (_, v) in enumerate(rows):
        for b, (_, w) in enumerate(rows[:a]):
            if good(v) and good(w) and len(v) == len(w) and any(v) and any(w):
                v_, w_ = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if v_ @ w_ / (np.linalg.norm(v_) * np.linalg.norm(w_)) >= 0.95:
                    links[a].append(b)
                    links[b].append(a)
    want = []
    for a in links:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(rows[b][0] for b in seen)
        want.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    assert got == sorted(want)
    assert sum(w[1] for w in want) > 500


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (3, 64, 1500):
        x = rng.normal(size=(200, dim)) * rng.uniform(1e-3, 1e3, (200, 1))
        y = np.concatenate([x[:100] + rng.normal(size=(100, dim)) * np.abs(x[:100]).mean() * 0.45, rng.normal(size=(50, dim))])
        cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        for threshold in (0.5, 0.9, 0.95):
            open_pairs = set(zip(*near_vectors.doubtful(near_vectors.quantise(x), near_vectors.quantise(y), threshold), strict=True))
            sure = set(zip(*np.nonzero(cos >= threshold), strict=True))
            assert sure <= open_pairs
            if dim > 3:
                assert len(open_pairs) < len(sure) + 0.1 * cos.size


@pytest.mark.parametrize(("shard", "fan"), [(7, 2), (8192, 16)])
def test_top_k(spark, monkeypatch, shard, fan):
    monkeypatch.setattr(topk, "ROWS_IN_SHARD", shard)
    monkeypatch.setattr(topk, "FAN_IN", fan)
    rows = made(160)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table(spark, rows), F.col("vec_id") % 20 == 0).collect())
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in rows if good(v)]
    want = []
    for q, x in {q: x for q, x in whole if q % 20 == 0}.items():
        found = sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:20]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    assert got == sorted(want)


def test_ties_go_to_smaller_numbers(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21))


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for size in (50, 10**6, 10**8):
        a, b = rng.integers(-size, size, (5, 70)), rng.integers(-size, size, (6, 70))
        assert (topk.products(a.astype(float), b.astype(float)) == a @ b.T).all()


def test_empty(spark):
    empty = table(spark, [])
    assert near_vectors.near_vectors(empty).count() == 0 and topk.top_k(empty, F.lit(True)).count() == 0
    assert blocks.in_blocks(empty.selectExpr("vec_id as id", "1 as dim", "cast(embedding as array<double>) as vector"), F.col("id"), 3).count() == 0

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lotwise.operators import quantiles as qt

SPEC = {"lo": ("v", 0.15), "mid": ("v", 0.5), "hi": ("v", 0.85), "other": ("w", 0.9)}


def expected(rows, spec):
    groups = {}
    for k, v, w in rows:
        groups.setdefault(k, []).append({"v": v, "w": w})
    out = {}
    for k, members in groups.items():
        out[k] = []
        for column, q in spec.values():
            values = [m[column] for m in members if m[column] is not None]
            out[k].append(float(np.quantile(values, q)) if values else None)
    return out


def same(found, wanted):
    assert set(found) == set(wanted)
    for k in wanted:
        for a, b in zip(found[k], wanted[k]):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


def run(df, strategy, **options):
    table = qt.quantile_table(df, ["k"], SPEC, strategy=strategy, **options)
    return {r["k"]: [r[name] for name in SPEC] for r in table.collect()}


@pytest.fixture(scope="module")
def skewed():
    """One key holds a third of the rows, another only nulls, and the null key counts as a key."""
    rng = random.Random(7)
    rows = [("hot", rng.gauss(100, 30), float(rng.randint(0, 5))) for _ in range(4000)]
    rows += [(f"k{rng.randint(0, 60)}", rng.gauss(10, 3), rng.random() if rng.random() < 0.9 else None) for _ in range(8000)]
    rows += [(None, 1.0, 2.0), (None, 3.0, None), ("empty", None, None), ("one", 5.0, 5.0)]
    return rows


@pytest.mark.parametrize("strategy", ["plain", "ranked"])
def test_equals_numpy(spark, skewed, strategy):
    df = spark.createDataFrame(skewed, "k string, v double, w double").repartition(7)
    same(run(df, strategy), expected(skewed, SPEC))


@pytest.mark.parametrize("strategy", ["plain", "ranked"])
def test_weights_count_as_repeated_rows(spark, strategy):
    rows = [("a", 1.0, 0.0, 3), ("a", 5.0, 1.0, 1), ("a", 2.0, 0.0, 4), ("b", 7.0, 1.0, 2)]
    df = spark.createDataFrame(rows, "k string, v double, w double, n int")
    repeated = [(k, v, w) for k, v, w, n in rows for _ in range(n)]
    same(run(df, strategy, weight="n"), expected(repeated, SPEC))


def test_aggregates_beside_quantiles(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v double, w double")
    for strategy in ("plain", "ranked", "approx"):
        table = qt.quantile_table(df, ["k"], SPEC, aggs=[F.count(F.lit(1)).alias("n")], strategy=strategy)
        assert table.columns == ["k", "n", *SPEC]
        assert {r["k"]: r["n"] for r in table.collect()}["hot"] == 4000


def test_whole_table_is_one_group(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v double, w double")
    values = [v for _, v, _ in skewed if v is not None]
    for strategy in ("plain", "ranked"):
        found = qt.quantiles(df, "v", [0.0, 0.25, 1.0], strategy=strategy).collect()
        assert [r["value"] for r in found] == pytest.approx([np.quantile(values, q) for q in (0, 0.25, 1)])


def test_many_equal_values(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") % 3).cast("double").alias("v"), F.lit(1.0).alias("w"))
    assert run(df, "ranked") == run(df, "plain")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(-1e6, 1e6)),
                          st.one_of(st.none(), st.integers(-3, 3).map(float))), min_size=1, max_size=40))
def test_ranked_property(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double, w double")
    found, wanted = run(df, "ranked"), expected(rows, SPEC)
    assert set(found) == set(wanted)
    for k in wanted:
        for a, b in zip(found[k], wanted[k]):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-6)


def test_one_way_for_every_number_of_partitions_and_cell_size(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed, "k string, v double, w double")
    whole = run(df.repartition(2), None)
    assert run(df.repartition(60), None) == whole
    monkeypatch.setattr(qt, "ROWS_IN_CELL", 5)
    monkeypatch.setattr(qt, "PARTS", 3)
    assert run(df.repartition(7), None) == whole


def test_no_sorted_cell_is_large(spark, monkeypatch):
    """Values close together all lie in one cell at first."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), (1000 + F.col("id") / 1e6).alias("v"), F.rand(1).alias("w"))
    monkeypatch.setattr(qt, "ROWS_IN_CELL", 1_000)
    seen = []
    monkeypatch.setattr(qt, "settle", lambda frame, real=qt.settle: seen.append(real(frame)) or seen[-1])
    table = qt.quantile_table(df, ["k"], {"m": ("v", 0.3)}).collect()
    assert table[0]["m"] == pytest.approx(np.quantile(1000 + np.arange(200_000) / 1e6, 0.3), abs=1e-9)
    assert seen[0].agg(F.max("__rows")).first()[0] > 50_000 and seen[-1].count() <= 1_000


def test_odd_values(spark):
    values = [0.0, -0.0, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), 1e-9, -1e-9, 7.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    spec = {f"q{i}": ("v", i / 9) for i in range(10)}
    row = qt.quantile_table(df, ["k"], spec).first()
    order = sorted(values)
    for i in range(1, 9):
        assert row[f"q{i}"] == pytest.approx(order[i], abs=1e-300)


def test_pooled_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), 2000 + rng.randint(0, 6), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "b string, y int, v double")
    for strategy in ("plain", "ranked"):
        table = qt.pooled_quantiles(df, ["b"], "y", {"m": ("v", 0.5)}, strategy=strategy).collect()
        assert len(table) == len({(b, y) for b, y, _ in rows})
        for r in table:
            pool = [v for b, y, v in rows if b == r["b"] and abs(y - r["y"]) <= 1]
            assert r["n_pool"] == len(pool) and r["m"] == pytest.approx(np.median(pool))


def test_rollup_equals_brute_force(spark, monkeypatch):
    """Groups of several levels from one table of counts, with nulls, stats and a choice of groups."""
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice("xy"), rng.choice([1.0, rng.gauss(0, 5), None]), rng.gauss(3, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "b string, m string, v double, w double").repartition(4)
    none = F.lit(None).cast("string")
    groups = F.array(*[
        F.struct(F.lit(i).alias("level"), b.alias("gb"), m.alias("gm"))
        for i, (b, m) in enumerate([(F.col("b"), F.col("m")), (F.col("b"), none), (none, none)])])
    spec, stats = {"lo": ("v", 0.15), "hi": ("v", 0.9)}, {"mean": ("mean", "w"), "std": ("std", "v"), "known": ("count", "v")}
    for cell_rows in (200_000, 7):
        monkeypatch.setattr(qt, "ROWS_IN_CELL", cell_rows)
        found = {(r.level, r.gb, r.gm): r for r in qt.rollup_quantiles(df, ["b", "m"], groups, spec, stats=stats).collect()}
        want = {}
        for b, m, v, w in rows:
            for key in ((0, b, m), (1, b, None), (2, None, None)):
                want.setdefault(key, []).append((v, w))
        assert set(found) == set(want)
        for key, members in want.items():
            r, known = found[key], [v for v, _ in members if v is not None]
            assert (r.n, r.known) == (len(members), len(known))
            assert (r.lo, r.hi) == pytest.approx((np.quantile(known, 0.15), np.quantile(known, 0.9)), abs=1e-9)
            assert (r.mean, r.std) == pytest.approx((np.mean([w for _, w in members]), np.std(known)), abs=1e-9)
    chosen = spark.createDataFrame([(0, "a", "x"), (2, None, None)], "level int, gb string, gm string")
    some = qt.rollup_quantiles(df, ["b", "m"], groups, spec, wanted=chosen).collect()
    assert {(r.level, r.gb, r.gm) for r in some} == {(0, "a", "x"), (2, None, None)}


def test_group_size_decides_for_each_group(spark, skewed, monkeypatch):
    """One large group among small ones: both ways in one table, equal to one way for all."""
    df = spark.createDataFrame(skewed, "k string, v double, w double")
    whole = run(df, "plain")
    monkeypatch.setattr(qt, "ROWS_IN_CELL", 1_000)
    assert run(df, None) == whole

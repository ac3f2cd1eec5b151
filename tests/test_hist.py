"""Boosted trees over bins against dense versions, in one block and in many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lotwise.learning import evaluate as ev, hist
from lotwise.learning.hist import Spec


def made(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 15, n).astype(float), rng.normal(size=n).round(2), rng.uniform(size=n).round(2)], axis=1)
    y = 0.3 * x[:, 0] + np.sin(2 * x[:, 1]) + rng.normal(size=n) * (0.1 + x[:, 2])
    y[:50] = y[0]
    return x, y


def table(spark, x, y, **more):
    frame = pd.DataFrame({**{f"x{i}": x[:, i] for i in range(x.shape[1])}, "y": y, **more})
    return spark.createDataFrame(frame).withColumn("x", F.array(*[f"x{i}" for i in range(x.shape[1])]))


def dense(x, y, cuts, spec, rounds, rows=None):
    """The same trees, by sorting and counting everything."""
    b = hist.binned(x, cuts)
    rows = np.arange(len(y)) if rows is None else rows
    value_of = (lambda r: float(r.mean())) if spec.alpha is None else (lambda r: float(np.quantile(r, spec.alpha)))
    f = np.full(len(y), value_of(y[rows]))
    for _ in range(rounds):
        r = y - f
        g = r if spec.alpha is None else np.where(r < 0, spec.alpha - 1, spec.alpha)

        def grow(mine, level):
            best, where = hist.LEAST_GAIN * max(1.0, len(mine)), None
            if level < spec.depth:
                total, found = g[mine].sum(), []
                for c in spec.columns:
                    for cut in range(len(cuts[c])):
                        left = mine[b[c][mine] <= cut]
                        if min(len(left), len(mine) - len(left)) >= spec.min_rows:
                            gl = g[left].sum()
                            found.append((gl ** 2 / len(left) + (total - gl) ** 2 / (len(mine) - len(left)) - total ** 2 / len(mine), c, cut))
                top = max((q[0] for q in found), default=0)
                if top > best:
                    where = next(q for q in found if q[0] >= top - 1e-9 * top)
            if where is None:
                return lambda everyone: everyone, [(mine, value_of(r[mine]))], None
            _, c, cut = where
            return c, cut, (grow(mine[b[c][mine] <= cut], level + 1), grow(mine[b[c][mine] > cut], level + 1))

        def add(tree, everyone):
            if tree[2] is None:
                f[everyone] += spec.step * tree[1][0][1]
                return
            c, cut, (left, right) = tree
            add(left, everyone[b[c][everyone] <= cut])
            add(right, everyone[b[c][everyone] > cut])

        add(grow(rows, 0), np.arange(len(y)))
    return f


@pytest.mark.parametrize("block_rows,tasks", [(1 << 14, 64), (211, 2)])
def test_trees_equal_dense_ones(spark, monkeypatch, block_rows, tasks):
    monkeypatch.setattr(hist, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(hist, "MERGED", tasks)
    monkeypatch.setattr(hist, "SETTLED", 2)
    x, y = made()
    fold = np.arange(len(y)) % 3
    specs = [Spec(0.85, (0, 1, 2), 0.5, 3, 3), Spec(None, (0, 1), 0.5, 3, 2), Spec(0.3, (1, 2), 0.5, 2, 2, fold=1)]
    df = table(spark, x, y, fold=fold).repartition(5)
    models = hist.train(df, "x", 3, "y", specs, fold="fold", settled=2)
    for model, spec in zip(models, specs):
        rows = None if spec.fold is None else np.flatnonzero(fold != spec.fold)
        assert len(model.trees) == spec.rounds
        assert np.allclose(model.on_bins(hist.binned(x, model.cuts)), dense(x, y, model.cuts, spec, spec.rounds, rows), atol=1e-9)


def test_leaves_without_the_last_look_are_near(spark):
    x, y = made()
    specs = [Spec(0.85, (0, 1, 2), 0.5, 4, 3)]
    near, sure = (hist.train(table(spark, x, y), "x", 3, "y", specs, exact=e)[0] for e in (False, True))
    bins = hist.binned(x, sure.cuts)
    assert np.abs(near.on_bins(bins) - sure.on_bins(bins)).mean() < 0.02


def test_monotone_models_are_never_out_of_order(spark):
    x, y = made()
    up, down = {0: 1, 1: 1}, {0: -1}
    specs = [Spec(0.5, (0, 1, 2), 0.5, 5, 3, monotone=up), Spec(None, (0, 1, 2), 0.5, 5, 3, monotone=up), Spec(0.5, (0, 1, 2), 0.5, 5, 3, monotone=down)]
    models = hist.train(table(spark, x, y), "x", 3, "y", specs)
    for model, spec in zip(models, specs):
        for column, sign in spec.monotone.items():
            grid = np.repeat(x[:200, None, :], 40, axis=1)
            grid[:, :, column] = np.linspace(x[:, column].min() - 1, x[:, column].max() + 1, 40)
            p = model.on_bins(hist.binned(grid.reshape(-1, 3), model.cuts)).reshape(200, 40)
            assert (sign * np.diff(p, axis=1) >= -1e-12).all()
    # the free direction still helps
    p = models[0].on_bins(hist.binned(x, models[0].cuts))
    assert np.abs(y - p).mean() < 0.8 * np.abs(y - np.median(y)).mean()


def test_contributions_are_shapley_values(spark):
    x, y = made(600)
    model = hist.train(table(spark, x, y), "x", 3, "y", [Spec(None, (0, 1, 2), 0.7, 2, 3)])[0]
    bins = hist.binned(x[:40], model.cuts)
    got = hist.contributions_on_bins(model, bins)
    assert np.allclose(got.sum(axis=0) + hist.expected_value(model), model.on_bins(bins), atol=1e-12)

    def value(tree, row, known, node=0):
        """Expected leaf of a row of which only some features are known."""
        inner = len(tree.feature)
        if node >= inner or tree.feature[node] < 0:
            while node < inner:
                node = 2 * node + 1
            return tree.value[node - inner]
        left, right = 2 * node + 1, 2 * node + 2
        if tree.feature[node] in known:
            return value(tree, row, known, right if row[tree.feature[node]] > tree.cut[node] else left)
        return (tree.rows[left] * value(tree, row, known, left) + tree.rows[right] * value(tree, row, known, right)) / tree.rows[node]

    for i in range(40):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = 0.0
            for size, weight in ((0, 1 / 3), (1, 1 / 6), (2, 1 / 3)):
                for s in ([()] if size == 0 else [(o,) for o in others] if size == 1 else [tuple(others)]):
                    want += weight * sum(value(t, bins[:, i], {*s, j}) - value(t, bins[:, i], set(s)) for t in model.trees)
            assert got[j, i] == pytest.approx(want, abs=1e-12)


def test_scores_by_spark_and_saved_models(spark):
    x, y = made(500)
    df = table(spark, x, y)
    models = hist.train(df, "x", 3, "y", [Spec(0.5, (0, 1), 0.5, 3, 2), Spec(None, (2,), 0.5, 2, 2)])
    again = [hist.HistModel.from_json(m.to_json()) for m in models]
    rows = df.select("x", hist.predict(F.col("x"), again).alias("p")).collect()
    for r in rows:
        bins = hist.binned(np.array([r.x]), models[0].cuts)
        assert r.p == [m.on_bins(bins)[0] for m in models]
    assert sum(models[0].importances()) == pytest.approx(1) and models[0].importances()[2] == 0
    assert len(models[0].first(1).trees) == 1


def test_odd_tables(spark):
    schema = "x array<double>, y double"
    specs = [Spec(0.5, (0,), 0.5, 3, 2), Spec(None, (0,), 0.5, 3, 2)]
    for rows in ([], [([1.0], None)], [([1.0], 2.0)], [([1.0], 5.0)] * 100, [([float("nan")], 1.0), ([2.0], 3.0)] * 30):
        models = hist.train(spark.createDataFrame(rows, schema), "x", 1, "y", specs)
        known = [y for _, y in rows if y is not None]
        for model in models:
            assert model.start == pytest.approx(np.median(known) if known else 0.0)


def test_blocks_are_small_whatever_their_number_of_models(spark):
    x, y = made(5000)
    cuts = [[3.0, 7.0], [0.0], [0.5]]
    held = table(spark, x, y, fold=np.arange(len(y)) % 3, held=np.arange(len(y)) % 7 == 0).repartition(2)
    packed = hist.blocks(held, "x", "y", cuts, 15, fold="fold", held="held")
    sizes = packed.select(sum(F.octet_length(c) for c in packed.columns).alias("size"), F.octet_length("y").alias("y"))
    most, rows = sizes.agg(F.max("size"), F.sum("y") / 8).first()
    assert most <= hist.BLOCK_BYTES and rows == 5000


def test_settled_blocks_are_small(spark):
    x, y = made(4000)
    specs = [Spec(a, (0, 1, 2), 0.5, 3, 2) for a in (0.15, 0.5, 0.85)]
    done = hist.Trainer(table(spark, x, y).repartition(2), "x", 3, "y", specs, settled=2).fit()
    sizes = done.data.select(sum(F.octet_length(c) for c in done.data.columns).alias("size"), F.octet_length("f").alias("f"))
    most, values = sizes.agg(F.max("size"), F.sum("f") / 8).first()
    assert most <= hist.BLOCK_BYTES and values == 3 * 4000


def test_large_sums_are_merged_before_they_are_collected(spark, monkeypatch):
    x, y = made(1000)
    df, collected = table(spark, x, y).repartition(6), []
    plain = hist.train(df, "x", 3, "y", [Spec(0.5, (0, 1, 2), 0.5, 2, 2)])[0]
    monkeypatch.setattr(hist, "COLLECTED", 1)
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: collected.append(collect(df)) or collected[-1])
    merged = hist.train(df, "x", 3, "y", [Spec(0.5, (0, 1, 2), 0.5, 2, 2)])[0]
    assert merged == plain
    assert all(len(rows) == 1 for rows in collected if rows and "added" in rows[0] and len(rows[0].added) > 100)


def test_exact_leaves_are_looked_at_in_one_pass_more(spark):
    """A pass per level, one that counts residuals in cells and one that takes the values around the rank: no refinement."""
    x, y = made(3000)
    y = np.concatenate([y, 3 + np.arange(600) * 1e-7])
    x = np.concatenate([x, np.tile([20.0, 0.0, 0.0], (600, 1))])
    done = hist.Trainer(table(spark, x, y), "x", 3, "y", [Spec(0.5, (0, 1, 2), 0.5, 2, 2)]).fit()
    assert done.passes <= 3 + 2 * 4
    want = dense(x, y, done.cuts, done.specs[0], 2)
    model = hist.HistModel(done.cuts, done.starts[0], done.trees[0])
    assert np.allclose(model.on_bins(hist.binned(x, model.cuts)), want, atol=1e-9)


def random_tree(rng, depth, features):
    tree = hist.empty_tree(depth)
    for node in range(len(tree.feature)):
        if rng.random() < 0.7:
            tree.feature[node], tree.cut[node] = int(rng.integers(features)), int(rng.integers(255))
    tree.value = rng.normal(size=1 << depth).tolist()
    return tree


def test_nodes_against_a_walk():
    rng = np.random.default_rng(5)
    for depth in (0, 1, 2, 3, 5):
        tree, x = random_tree(rng, depth, 4), rng.integers(0, 256, (4, 300)).astype(np.uint8)
        for level in range(depth + 1):
            want = []
            for row in x.T:
                place = 0
                for k in range(level):
                    node = (1 << k) - 1 + place
                    place = 2 * place + int(tree.feature[node] >= 0 and row[tree.feature[node]] > tree.cut[node])
                want.append(place)
            assert hist.nodes_at(tree, x, level).tolist() == want


def test_stages_of_a_model_cost_each_tree_once(monkeypatch):
    rng = np.random.default_rng(6)
    trees, x = [random_tree(rng, 3, 4) for _ in range(12)], rng.integers(0, 256, (4, 50)).astype(np.uint8)
    whole, other = hist.HistModel([[]] * 4, 0.5, trees), hist.HistModel([[]] * 4, 0.5, [random_tree(rng, 3, 4), *trees[1:]])
    models = [whole.first(3), other.first(5), whole, whole.first(0), other, hist.HistModel(whole.cuts, 0.25, trees[:4])]
    want, seen, nodes_at = [m.on_bins(x) for m in models], [], hist.nodes_at
    monkeypatch.setattr(hist, "nodes_at", lambda *a: seen.append(1) or nodes_at(*a))
    found = ev._stages(models, x)
    assert [f.tolist() for f in found] == [f.tolist() for f in want]
    assert len(seen) == 12 + 12 + 4


def test_models_of_a_fold_share_its_rows():
    rng = np.random.default_rng(7)
    n, tree = 500, random_tree(rng, 2, 3)
    tree.feature[:] = [0, 1, 2]
    x, y, fold = rng.integers(0, 256, (n, 3)).astype(np.uint8), rng.normal(size=n), rng.integers(0, 3, n).astype("<i4")
    block = hist._Block(x, y, None, fold, None, None)
    specs = [hist.Spec(a, (0, 1, 2), fold=1) for a in (0.15, 0.5, 0.85)]
    assert len({id(block.training(s)) for s in specs}) == 1
    for spec in specs:
        for level, wanted in ((0, [0]), (1, [2])):
            start = float(np.quantile(y, spec.alpha))
            sums, _ = hist._histograms({0: tree}, {0: wanted}, level)(0, spec, block, lambda part: part.predictions(0, [start], {0: []}))
            got = hist._three(sums[5:].reshape(1, 3, 256, -1), spec)[0]
            rows = (fold != 1) & ((x[:, 0] > tree.cut[0]) if level else True)
            for c in range(3):
                g = np.where(y[rows] < start, spec.alpha - 1, spec.alpha)
                assert np.allclose(got[c, :, 0], np.bincount(x[rows, c], g, minlength=256))
                assert got[c, :, 2].tolist() == np.bincount(x[rows, c], minlength=256).tolist()

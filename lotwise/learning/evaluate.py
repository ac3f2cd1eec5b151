"""Splits, cross validation, grids, feature sets and permutation importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.config import AGE_BUCKETS, EncoderConfig, QUANTILES
from lotwise.functions.features import age_bucket
from lotwise.learning import hist
from lotwise.learning.boost import fit_quantiles, predict_quantiles
from lotwise.learning.encode import PriceEncoder, assemble
from lotwise.operators.keys import hash_bucket
from lotwise.operators.metrics import (
    ape, bucket_metrics, coverage, median_errors, pinball, regression_metrics,
)
from lotwise.operators.quantiles import quantile_table
from lotwise.operators.stats import best_row, n_rows
from lotwise.scale import settle
from lotwise.sources.files import union_all


def split(df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """`is_test` by seeded hash of the key: copies of a key stay on one side."""
    return df.withColumn("is_test", hash_bucket(key, 1000, seed) < round(test * 1000))


def with_fold(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", hash_bucket(key, k, seed))


def with_es_slice(df: DataFrame, key: Sequence[str], frac: float = 0.1, seed: int = 43) -> DataFrame:
    """Mark a share of the training rows to watch for early stopping."""
    return df.withColumn("is_es", hash_bucket(key, 1000, seed) < round(frac * 1000))


FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def boosted_fit_predict(
    features: Sequence[str], config: EncoderConfig = EncoderConfig(), qs: Mapping[str, float] = QUANTILES,
    key: Sequence[str] = ("url",), es_frac: float | None = None, **params,
) -> FitPredict:
    """Encoder and quantile models fitted on the training rows given, nothing else."""
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        rows = train
        if es_frac:
            rows = with_es_slice(train, key, es_frac)
        learn = rows.where("not is_es") if es_frac else rows
        encoder = PriceEncoder(config).fit(learn)
        encoded = assemble(encoder.transform(rows).withColumn("log_price", F.ln("price")), features)
        extra = {"validation_col": "is_es"} if es_frac else {}
        models = fit_quantiles(encoded, qs, **extra, **params)
        return predict_quantiles(assemble(encoder.transform(test), features), models)

    return run


def fold_metrics(scored: DataFrame, y: str = "price", by: Sequence[str] = ()) -> DataFrame:
    """Losses, coverage, median % error and mean error of a scored frame: one row, or one per group of `by`."""
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-6)))
    rows = scored.dropna(subset=[y, *QUANTILES])
    losses = []
    for name, alpha in QUANTILES.items():
        e = log(y) - log(name)
        losses.append(F.avg(F.when(e >= 0, e * alpha).otherwise(e * (alpha - 1))).alias(f"pinball_{name}"))
    return quantile_table(
        rows.withColumn("_ape", ape(y, "q50")), list(by), {"median_ape": ("_ape", 0.5)},
        aggs=[
            n_rows("n_val"), *losses,
            (F.avg(F.col(y).between(F.col("q15"), F.col("q85")).cast("int")) * 100).alias("coverage"),
            F.avg(F.abs(F.col(y) - F.col("q50"))).alias("mae"),
        ],
    )


def cross_validate(
    df: DataFrame, fit_predict: FitPredict, k: int = 5, key: Sequence[str] = ("url",), seed: int = 42,
    metrics: Callable[[DataFrame], DataFrame] = fold_metrics,
) -> DataFrame:
    """Metric rows per fold. State is refitted on each fold's training rows.

    The driver loops over k folds; each is a set of Spark jobs, and only metric
    rows are kept.
    """
    rows = settle(with_fold(df, key, k, seed))
    results = []
    for fold in range(k):
        scored = fit_predict(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold))
        results.append(settle(metrics(scored).withColumn("fold", F.lit(fold))))
    return union_all(*results)


def bucket_fold_metrics(scored: DataFrame, age: str = "car_age", min_n: int = 50) -> DataFrame:
    return bucket_metrics(scored, "price", "q15", "q50", "q85", age, AGE_BUCKETS, min_n)


def grid_search(
    df: DataFrame, make: Callable[..., FitPredict], grid: Mapping[str, Sequence], k: int = 3,
    key: Sequence[str] = ("url",), metric: str = "mae", seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(all results, the best one) over the product of the grid, judged by mean CV metric."""
    results = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        folds = cross_validate(df, make(**params), k, key, seed)
        row = folds.agg(F.avg(metric).alias(f"mean_{metric}"), F.stddev_samp(metric).alias(f"std_{metric}"))
        results.append(settle(row.select(
            *[F.lit(v).alias(name) for name, v in params.items()], f"mean_{metric}", f"std_{metric}"
        )))
    table = union_all(*results)
    return table, best_row(table, f"mean_{metric}")


def compare_specs(
    train: DataFrame, test: DataFrame, specs: Mapping[str, Sequence[str]],
    make: Callable[[Sequence[str]], FitPredict], metrics: Callable[[DataFrame], DataFrame] = fold_metrics,
) -> DataFrame:
    """Metric row per named feature list, all scored on the same test rows."""
    return union_all(*[
        settle(metrics(make(features)(train, test)).withColumn("spec", F.lit(name)))
        for name, features in specs.items()
    ])


@dataclass(frozen=True)
class Point:
    """One setting of boosted models: step, rounds, depth and the features it may use (None: all)."""

    step: float = 0.1
    rounds: int = 50
    depth: int = 4
    min_rows: int = 20
    features: tuple[str, ...] | None = None

    @property
    def sequence(self) -> tuple:
        """Points that differ in rounds only are stages of the same model."""
        return self.step, self.depth, self.min_rows, self.features


def _train_points(
    rows: DataFrame, features: Sequence[str], points: Mapping[str, Point], qs: Mapping[str, float], folds: Sequence[int | None],
    **how,
) -> dict[str, list[list[hist.HistModel]]]:
    """Models per point, as [fold][level]. All sequences, levels and folds are trained in the same passes; column
    i * len(features) + j of the array `x` is feature j as the i-th fold's encoder gives it."""
    longest: dict[tuple, int] = {}
    for p in points.values():
        longest[p.sequence] = max(longest.get(p.sequence, 0), p.rounds)
    where, specs = {}, []
    for (step, depth, min_rows, wanted), rounds in longest.items():
        for i, fold in enumerate(folds):
            columns = tuple(i * len(features) + j for j, f in enumerate(features) if wanted is None or f in wanted)
            for name, alpha in qs.items():
                where[(step, depth, min_rows, wanted), i, name] = len(specs)
                specs.append(hist.Spec(alpha, columns, step, rounds, depth, min_rows, fold=fold))
    fold_of = [fold for fold in folds for _ in features]
    models = hist.train(rows, "x", len(fold_of), "log_price", specs, fold_of=fold_of, **how)
    return {
        name: [[models[where[p.sequence, i, q]].first(p.rounds) for q in qs] for i in range(len(folds))]
        for name, p in points.items()}


def _stages(models: Sequence[hist.HistModel], x: np.ndarray) -> list[np.ndarray]:
    """The predictions of each model; one whose first trees are another's goes on from there."""
    out: list[np.ndarray] = [np.empty(0)] * len(models)
    known: list[tuple[hist.HistModel, np.ndarray]] = []
    for i in sorted(range(len(models)), key=lambda i: len(models[i].trees)):
        model = models[i]
        start, f = hist.HistModel(model.cuts, model.start, []), None
        for other, values in known:
            n = len(other.trees)
            if other.start == model.start and n >= len(start.trees) and all(a is b for a, b in zip(other.trees, model.trees, strict=False)):
                start, f = other, values
        f = np.full(x.shape[1], model.start) if f is None else f.copy()
        out[i] = hist.add_trees(f, model.trees[len(start.trees):], x)
        known.append((model, out[i]))
    return out


def _scores(x: Column, fold: Column, models: Sequence[Sequence[Sequence[hist.HistModel]]]) -> Column:
    """Per row the predictions of the models of its fold: an array of the points' arrays of levels."""
    width, n_points, n_levels = len(models[0][0][0].cuts), len(models), len(models[0][0])

    @F.arrow_udf("array<array<double>>")
    def score(values: pa.Array, folds: pa.Array) -> pa.Array:
        bins = hist.binned(hist._lists(values, width), models[0][0][0].cuts)
        own = folds.to_numpy(zero_copy_only=False)
        out = np.empty((len(own), n_points * n_levels))
        for i in np.unique(own):
            rows = np.flatnonzero(own == i)
            part = np.ascontiguousarray(bins[:, rows])
            for at, f in enumerate(_stages([m for point in models for m in point[int(i)]], part)):
                out[rows, at] = f
        levels = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n_levels, dtype=np.int32)), pa.array(out.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(levels) + 1, n_points, dtype=np.int32)), levels)

    return score(x, fold)


def _by_point(scored: DataFrame, points: Sequence[str], qs: Mapping[str, float], keep: Sequence[str]) -> DataFrame:
    """A row per scored row and point, with the levels as columns."""
    each = scored.select(*keep, F.posexplode("_scores").alias("_p", "_levels"))
    name = F.get(F.array(*[F.lit(p) for p in points]), F.col("_p")).alias("point")
    return each.select(*keep, name, *[F.exp(F.get("_levels", F.lit(j))).alias(q) for j, q in enumerate(qs)])


def fold_matrix(
    df: DataFrame, features: Sequence[str], config: EncoderConfig = EncoderConfig(), k: int = 5, key: Sequence[str] = ("url",),
    seed: int = 42,
) -> DataFrame:
    """(fold, price, log_price, car_age, x): x holds the features k times over, as each fold's encoder gives them. The k
    encoders come from one table of counts, and the rows are read once for all of them."""
    rows = settle(with_fold(df, key, k, seed))
    names, out = rows.columns, rows
    for i, encoder in enumerate(PriceEncoder(config).fit_folds(rows, "fold", k)):
        encoded = encoder.transform(out)
        values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
        out = encoded.select(*names, *[f"_x{j}" for j in range(i)], values.alias(f"_x{i}"))
    age = [F.col("car_age")] if "car_age" in names else [(F.lit(config.current_year) - F.col("year")).alias("car_age")]
    return settle(out.where(F.col("price") > 0).select(
        "fold", "price", F.ln("price").alias("log_price"), *age, F.concat(*[f"_x{i}" for i in range(k)]).alias("x")))


def cross_validate_boosted(
    df: DataFrame, features: Sequence[str], points: Mapping[str, Point], config: EncoderConfig = EncoderConfig(), k: int = 5,
    key: Sequence[str] = ("url",), qs: Mapping[str, float] = QUANTILES, seed: int = 42, exact: bool = False,
) -> DataFrame:
    """Metric rows per (point, fold), every row scored by models that saw neither it nor its fold in any state.

    All points, folds and levels are trained in the same passes over binned rows; see `_train_points`.
    """
    rows = fold_matrix(df, features, config, k, key, seed)
    models = _train_points(rows, features, points, qs, list(range(k)), fold="fold", exact=exact)
    scored = rows.select("fold", "price", "car_age", _scores(F.col("x"), F.col("fold"), list(models.values())).alias("_scores"))
    return fold_metrics(_by_point(scored, list(models), qs, ["fold", "price", "car_age"]), by=["point", "fold"])


def grid_search_boosted(
    df: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence], config: EncoderConfig = EncoderConfig(), k: int = 3,
    key: Sequence[str] = ("url",), metric: str = "mae", seed: int = 42, exact: bool = False, **fixed,
) -> tuple[DataFrame, DataFrame]:
    """(all points with mean and spread of the metric over the folds, the best one) over the whole product of the grid,
    whose names are fields of Point."""
    points = {}
    for values in product(*grid.values()):
        point = Point(**dict(zip(grid, values)), **fixed)
        points[", ".join(f"{name}={v}" for name, v in zip(grid, values))] = point
    folds = cross_validate_boosted(df, features, points, config, k, key, seed=seed, exact=exact)
    named = F.create_map(*[
        x for name, p in points.items()
        for x in (F.lit(name), F.struct(*[F.lit(getattr(p, f)).alias(f) for f in grid]))])
    table = settle(folds.groupBy("point").agg(
        F.sum("n_val").alias("n_val"), F.avg(metric).alias(f"mean_{metric}"), F.stddev_samp(metric).alias(f"std_{metric}")
    ).withColumn("_p", F.element_at(named, F.col("point"))).select("_p.*", "n_val", f"mean_{metric}", f"std_{metric}"))
    return table, best_row(table, f"mean_{metric}")


def compare_specs_boosted(
    train: DataFrame, test: DataFrame, specs: Mapping[str, Sequence[str]], config: EncoderConfig = EncoderConfig(),
    point: Point = Point(), qs: Mapping[str, float] = QUANTILES, exact: bool = False,
) -> DataFrame:
    """Metric row per named feature list, all trained in the same passes and scored on the same test rows."""
    features = list(dict.fromkeys(f for names in specs.values() for f in names))
    encoder = PriceEncoder(config).fit(train)

    def ready(df: DataFrame) -> DataFrame:
        values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
        return encoder.transform(df).where(F.col("price") > 0).select("price", F.ln("price").alias("log_price"), values.alias("x"))

    rows = settle(ready(train))
    points = {name: Point(point.step, point.rounds, point.depth, point.min_rows, tuple(names)) for name, names in specs.items()}
    models = _train_points(rows, features, points, qs, [None], exact=exact)
    scored = settle(ready(test)).select("price", _scores(F.col("x"), F.lit(0), list(models.values())).alias("_scores"))
    return fold_metrics(_by_point(scored, list(models), qs, ["price"]), by=["point"]).withColumnRenamed("point", "spec")


def permutation_importance(
    predict: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str],
    loss: Callable[[DataFrame], DataFrame], seed: int = 42, rows_in_bucket: int = 100_000,
) -> DataFrame:
    """Rise of the loss when one feature's values are exchanged between rows.

    A row's bucket and its place there come from a hash of its values, so they
    do not depend on how the rows are spread. In a bucket every row takes the
    features of the row after it; one shuffle serves all features. There are as
    many buckets as keep one, which a task sorts, at about `rows_in_bucket`.
    """
    buckets = max(1, math.ceil(df.count() / rows_in_bucket))
    place = F.xxhash64(F.lit(seed), *df.columns)
    placed = df.withColumns({"_u": place, "_b": F.pmod(F.xxhash64(place), F.lit(buckets))})
    around = Window.partitionBy("_b").orderBy("_u")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = F.struct(*features)
    swapped = settle(
        placed.withColumn("_other", F.coalesce(F.lead(values).over(around), F.first(values).over(whole)))
        .drop("_u", "_b")
    )
    base = loss(predict(swapped)).first()[0]
    rows = []
    for f in features:
        moved = loss(predict(swapped.withColumn(f, F.col(f"_other.{f}")))).first()[0]
        rows.append((f, float(base), float(moved), float(moved - base)))
    return df.sparkSession.createDataFrame(
        rows, "feature string, base_loss double, permuted_loss double, delta_loss double"
    ).orderBy(F.desc("delta_loss"), "feature")


def pinball_loss(y: str, pred: str, alpha: float) -> Callable[[DataFrame], DataFrame]:
    return lambda scored: pinball(scored, y, pred, alpha)


def holdout_report(scored: DataFrame, y: str = "price") -> dict[str, DataFrame]:
    """Held-out quality in one place: errors, medians, coverage and age buckets."""
    label, order = age_bucket("car_age")
    return {
        "errors": regression_metrics(scored, y, "q50"),
        "medians": median_errors(scored, y, "q50"),
        "coverage": coverage(scored, y, "q15", "q85"),
        "by_age": coverage(scored.withColumns({"age_bucket": label, "_o": order}), y, "q15", "q85", ["age_bucket"]),
    }

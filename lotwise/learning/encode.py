"""Fitted feature engineering. State is learned from the frame given to `fit` alone.

The state lives in small tables (one row per brand or model), settled when
fitted, and is joined to the rows in `transform`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace
from importlib import import_module

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lotwise.config import (
    EncoderConfig, FUEL_KEYWORDS, LEAN_FEATURES, NORMAL_IQR, NORMAL_P25, NORMAL_P75, NORMAL_P90,
)
from lotwise.functions import features as fx
from lotwise.functions.parse import keyword_flags
from lotwise.operators.keys import join_on, with_one_row
from lotwise.operators.quantiles import quantile_table, rollup_quantiles
from lotwise.operators.rows import align
from lotwise.operators.stats import n_rows, price_cv
from lotwise.scale import settle
from lotwise.sources.files import add_block

KM_CUTS = {"km_p25": 0.25, "km_p50": 0.5, "km_p75": 0.75, "km_p90": 0.9}
FLAGS = ("top25", "bottom25", "top5")


def _ln(df: DataFrame, price: str) -> DataFrame:
    return df.where(F.col(price) > 0).withColumn("_lp", F.ln(price))


def global_stats(df: DataFrame, price: str = "price", km: str = "km", age: str = "car_age", *, strategy=None) -> DataFrame:
    """One row: mean, median and population spread of ln(price); mean km and age."""
    return quantile_table(
        _ln(df, price), [], {"global_median": ("_lp", 0.5)},
        aggs=[
            F.avg("_lp").alias("global_mean"), F.stddev_pop("_lp").alias("global_std"),
            F.avg(km).alias("global_km_mean"), F.avg(age).alias("global_age_mean"),
        ],
        strategy=strategy,
    )


def km_percentiles(df: DataFrame, km: str = "km", *, strategy=None) -> DataFrame:
    return quantile_table(df, [], {name: (km, q) for name, q in KM_CUTS.items()}, strategy=strategy)


def entity_stats(
    df: DataFrame, key: str | Sequence[str], km: str = "km", age: str = "car_age", *, strategy=None
) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return quantile_table(
        df, keys, {"median_km": (km, 0.5), "median_age": (age, 0.5)},
        aggs=[n_rows(), F.avg(km).alias("avg_km"), F.avg(age).alias("avg_age")], strategy=strategy,
    )


def target_encoding(
    df: DataFrame, key: str | Sequence[str], price: str = "price", min_samples: int = 5, *, strategy=None
) -> DataFrame:
    """Mean, median and population spread of ln(price) for keys with enough rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return quantile_table(
        _ln(df, price), keys, {"median_log_price": ("_lp", 0.5)},
        aggs=[n_rows(), F.avg("_lp").alias("mean_log_price"), F.stddev_pop("_lp").alias("std_log_price")],
        strategy=strategy,
    ).where(F.col("n") >= min_samples)


def popularity(df: DataFrame, model_key: Sequence[str] = ("model",), brand: str = "brand") -> DataFrame:
    """(brand, model key, model_count, ratio): rows of the model over rows of the brand."""
    models = df.groupBy(*model_key).agg(n_rows("model_count"))
    brands = df.groupBy(brand).agg(n_rows("_bn"))
    combos = df.select(brand, *[k for k in model_key if k != brand]).distinct()
    return (
        join_on(join_on(combos, models, list(model_key), "left"), brands, [brand], "left")
        .withColumn("model_popularity_ratio", F.try_divide("model_count", "_bn")).drop("_bn")
    )


def _flag_columns(median: str, cuts: Mapping[str, str], prefix: str) -> dict[str, Column]:
    m = F.col(median)
    return {
        f"{prefix}_top25_price": (m >= F.col(cuts["q75"])).cast("int"),
        f"{prefix}_bottom25_price": (m <= F.col(cuts["q25"])).cast("int"),
        f"{prefix}_top5_price": (m >= F.col(cuts["q95"])).cast("int"),
    }


def flag_entities(medians: DataFrame, median: str, prefix: str) -> DataFrame:
    """0/1 flags of each entity's median against the quantiles of all entity medians."""
    cuts = quantile_table(medians, [], {"_q25": (median, 0.25), "_q75": (median, 0.75), "_q95": (median, 0.95)})
    names = {"q25": "_q25", "q75": "_q75", "q95": "_q95"}
    return (
        with_one_row(medians, cuts)
        .withColumns(_flag_columns(median, names, prefix)).drop(*names.values())
    )


def quantile_flags(
    df: DataFrame, key: str | Sequence[str], price: str = "price", min_samples: int = 5, prefix: str = "entity", *, strategy=None
) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    medians = target_encoding(df, keys, price, min_samples, strategy=strategy).select(*keys, "median_log_price")
    return flag_entities(medians, "median_log_price", prefix)


def model_rank(
    df: DataFrame, brand: str = "brand", model: str = "model", price: str = "price", min_samples: int = 5, *, strategy=None
) -> DataFrame:
    """Dense rank of each model in its brand by median ln(price), cheapest first."""
    medians = target_encoding(df, [brand, model], price, min_samples, strategy=strategy)
    order = Window.partitionBy(brand).orderBy("median_log_price")
    return medians.select(brand, model, F.dense_rank().over(order).alias("model_rank_within_brand"))


def distribution_features(
    df: DataFrame, key: str | Sequence[str], price: str = "price", min_samples: int = 5, *, strategy=None
) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return (
        quantile_table(
            _ln(df, price), keys,
            {"p25": ("_lp", 0.25), "p75": ("_lp", 0.75), "p90": ("_lp", 0.9)}, aggs=[n_rows()], strategy=strategy,
        )
        .where(F.col("n") >= min_samples)
        .withColumn("iqr", F.col("p75") - F.col("p25"))
    )


def _state_spec(prefix: str) -> dict[str, tuple[str, float]]:
    return {
        f"{prefix}_median_km": ("km", 0.5), f"{prefix}_median_age": ("car_age", 0.5),
        f"{prefix}_median_log_price": ("_lp", 0.5), f"{prefix}_p25_log_price": ("_lp", 0.25),
        f"{prefix}_p75_log_price": ("_lp", 0.75), f"{prefix}_p90_log_price": ("_lp", 0.9),
    }


STATE_KEYS = ("_kind", "_view", "_k0", "_k1", "_k2")


def _rollup_state(rows: DataFrame, model_key: Sequence[str], views: Column | None) -> DataFrame:
    """One row per group of every kind (brand, model key, pair of brand and model, all) and view, from one table of counts.

    `views` is an array of the views that a row's fold is training data of; without it there is one view.
    """
    finest = list(dict.fromkeys(["brand", "model", *model_key]))
    text = lambda c: F.col(c).cast("string")

    def group(kind: str, view: Column, keys: Sequence[str]) -> Column:
        full = [text(k) for k in keys] + [F.lit(None).cast("string")] * (3 - len(keys))
        return F.struct(F.lit(kind).alias("_kind"), view.alias("_view"), *[c.alias(f"_k{i}") for i, c in enumerate(full)])

    pairs = [] if list(model_key) == ["brand", "model"] else [("pairs", ["brand", "model"])]
    kinds = [("brands", ["brand"]), ("models", list(model_key)), *pairs, ("globals", [])]
    views = F.array(F.lit(0)) if views is None else views
    groups = F.flatten(F.transform(views, lambda v: F.array(*[group(kind, v, keys) for kind, keys in kinds])))
    keys = [*finest, *(["_fold"] if "_fold" in rows.columns else [])]
    spec = {**_state_spec("e"), **{k: ("km", q) for k, q in KM_CUTS.items()}}
    stats = {
        "_np": ("count", "_lp"), "e_avg_km": ("mean", "km"), "e_avg_age": ("mean", "car_age"),
        "e_mean_log_price": ("mean", "_lp"), "e_std_log_price": ("std", "_lp")}
    return settle(rollup_quantiles(rows, keys, groups, spec, n="e_count", stats=stats))


def _entity_state(table: DataFrame, keys: Sequence[str], types: Mapping[str, T.DataType], prefix: str, min_samples: int) -> DataFrame:
    """State of one kind of entity, per view: statistics of the log price need `min_samples` rows; flags compare its median
    with those of all entities of the view."""
    named = {c: f"{prefix}{c[1:]}" for c in table.columns if c.startswith("e_")}
    state = table.withColumnsRenamed(named).withColumn(
        f"{prefix}_iqr_log_price", F.col(f"{prefix}_p75_log_price") - F.col(f"{prefix}_p25_log_price"))
    enough = F.col("_np") >= min_samples
    state = state.withColumns({c: F.when(enough, F.col(c)) for c in state.columns if c.endswith("_log_price")})
    state = state.withColumns({k: F.col(f"_k{i}").cast(types[k]) for i, k in enumerate(keys)})
    median = f"{prefix}_median_log_price"
    cuts = settle(quantile_table(
        state.where(F.col(median).isNotNull()), ["_view"],
        {"_q25": (median, 0.25), "_q75": (median, 0.75), "_q95": (median, 0.95)}))
    flagged = join_on(state, cuts, ["_view"], "left").withColumns(
        _flag_columns(median, {"q25": "_q25", "q75": "_q75", "q95": "_q95"}, prefix))
    own = [
        f"{prefix}_count", f"{prefix}_avg_km", f"{prefix}_avg_age", f"{prefix}_mean_log_price", f"{prefix}_std_log_price",
        *_state_spec(prefix), f"{prefix}_iqr_log_price", *[f"{prefix}_{f}_price" for f in FLAGS]]
    return flagged.select("_view", *keys, *own)


def _states(rows: DataFrame, config: EncoderConfig, views: Column | None) -> dict[str, DataFrame]:
    """The tables of the encoder's state, each with a column _view; see _rollup_state."""
    types = {f.name: f.dataType for f in rows.schema}
    table = _rollup_state(rows, config.model_key, views)
    of = lambda kind: table.where(F.col("_kind") == kind)
    entity = lambda kind, keys, prefix: _entity_state(
        of(kind).drop("_kind", *KM_CUTS), keys, types, prefix, config.min_samples)
    models = list(config.model_key)
    pairs = of("models" if models == ["brand", "model"] else "pairs").where(F.col("_np") >= config.min_samples)
    order = Window.partitionBy("_view", "_k0").orderBy("e_median_log_price")
    state = {
        "brands": entity("brands", ["brand"], "brand"),
        "models": entity("models", models, "model"),
        "ranks": pairs.select(
            "_view", F.col("_k0").cast(types["brand"]).alias("brand"), F.col("_k1").cast(types["model"]).alias("model"),
            F.dense_rank().over(order).alias("model_rank_within_brand")),
        "globals": of("globals").select(
            "_view", *KM_CUTS, F.col("e_median_log_price").alias("global_median"), F.col("e_mean_log_price").alias("global_mean"),
            F.col("e_std_log_price").alias("global_std"), F.col("e_avg_km").alias("global_km_mean"), F.col("e_avg_age").alias("global_age_mean")),
    }
    return {name: settle(df) for name, df in state.items()}


class PriceEncoder(Estimator):
    """Learns brand, model and mileage statistics from training rows."""

    def __init__(self, config: EncoderConfig = EncoderConfig(), price: str = "price"):
        super().__init__()
        self.config, self.price = config, price

    def _prepared(self, dataset: DataFrame, *more: Column) -> DataFrame:
        c = self.config
        rows = (
            dataset.withColumn("car_age", fx.car_age("year", c.current_year))
            .withColumn("_lp", F.when(F.col(self.price) > 0, F.ln(self.price)))
        )
        return settle(rows.select(*dict.fromkeys(["brand", "model", *c.model_key, "km", "car_age", "_lp"]), *more))

    def _blocks(self, dataset: DataFrame) -> list["OneHotModel"]:
        c = self.config
        return [
            OneHot(col, prefix).fit(dataset)
            for col, prefix, wanted in (
                ("brand", "ohe_brand", c.brand_onehot),
                ("energie", "energie", c.fuel_onehot and "energie" in dataset.columns),
            ) if wanted
        ]

    def _fit(self, dataset: DataFrame) -> "PriceEncoderModel":
        """All state from one table of counts per (brand, model); see `_rollup_state`."""
        states = _states(self._prepared(dataset), self.config, None)
        return PriceEncoderModel(self.config, {n: df.drop("_view") for n, df in states.items()}, self._blocks(dataset))

    def fit_folds(self, dataset: DataFrame, fold: str, k: int) -> list["PriceEncoderModel"]:
        """k models, the i-th learned from all rows but those of fold i, and all from one table of counts: rows are counted
        per fold, and a model's state adds up the folds it may see. Levels of one-hot columns come from all rows."""
        rows = self._prepared(dataset, F.col(fold).cast("int").alias("_fold"))
        views = F.array_except(F.array(*[F.lit(i) for i in range(k)]), F.array(F.col("_fold")))
        states, blocks = _states(rows, self.config, views), self._blocks(dataset)
        return [
            PriceEncoderModel(self.config, {n: df.where(F.col("_view") == i).drop("_view") for n, df in states.items()}, blocks)
            for i in range(k)]


class PriceEncoderModel(Model):
    """Applies learned statistics; unseen brands and models get the global ones."""

    def __init__(self, config: EncoderConfig, state: Mapping[str, DataFrame], blocks: Sequence["OneHotModel"] = ()):
        super().__init__()
        self.config, self.state, self.blocks = config, dict(state), list(blocks)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = self.config
        year = c.current_year
        age = fx.car_age("year", year)
        out = dataset.withColumn("car_age", age).withColumns({
            "decade": fx.decade("year"), "is_almost_new": F.col("year") >= year - 1,
            "km_per_year": fx.km_per_year("km", age),
        })
        out = with_one_row(out, self.state["globals"])
        out = add_block(out, fx.mileage_flags("km", "km_p75"))
        if c.categories:
            out = out.withColumns({
                "age_category": fx.age_category("year", year),
                "mileage_category": fx.mileage_category("km", *KM_CUTS),
            })
        if c.logs:
            out = add_block(out, fx.log_features("km", "km_per_year"))
        if c.polynomials:
            out = add_block(out, fx.polynomials("car_age", "km"))
        out = self._entities(out)
        if c.interactions:
            out = add_block(out, fx.interactions("car_age", "km"))
            out = add_block(out, fx.usage_flags("car_age", "km"))
        if c.horsepower:
            out = fx.hp_features(out)
        for block in self.blocks:
            out = block.transform(out)
        return out.drop(*self.state["globals"].columns)

    def _entities(self, df: DataFrame) -> DataFrame:
        c = self.config
        out = join_on(df, self.state["brands"], ["brand"], "left")
        out = join_on(out, self.state["models"].drop("model_avg_km", "model_median_km", "model_avg_age", "model_median_age"),
                      list(c.model_key), "left")
        out = join_on(out, self.state["ranks"], ["brand", "model"], "left")
        g_mean, g_std = F.col("global_mean"), F.col("global_std")
        filled = {
            "brand_avg_km": F.coalesce("brand_avg_km", "global_km_mean"),
            "brand_median_km": F.coalesce("brand_median_km", "global_km_mean"),
            "brand_avg_age": F.coalesce("brand_avg_age", "global_age_mean"),
            "brand_median_age": F.coalesce("brand_median_age", "global_age_mean"),
            "model_count": F.coalesce("model_count", F.lit(0)),
            "model_popularity_ratio":
                F.coalesce("model_count", F.lit(0)) / F.coalesce("brand_count", F.lit(1)),
            "model_rank_within_brand": F.coalesce("model_rank_within_brand", F.lit(0)),
        }
        for e in ("brand", "model"):
            filled |= {f"{e}_{flag}_price": F.coalesce(f"{e}_{flag}_price", F.lit(0)) for flag in FLAGS}
            if c.target_encoding:
                filled |= {
                    f"{e}_mean_log_price": F.coalesce(f"{e}_mean_log_price", g_mean),
                    f"{e}_median_log_price": F.coalesce(f"{e}_median_log_price", "global_median"),
                    f"{e}_std_log_price": F.coalesce(f"{e}_std_log_price", g_std),
                }
            if c.quantile_features:
                filled |= {
                    f"{e}_p25_log_price": F.coalesce(f"{e}_p25_log_price", g_mean + NORMAL_P25 * g_std),
                    f"{e}_p75_log_price": F.coalesce(f"{e}_p75_log_price", g_mean + NORMAL_P75 * g_std),
                    f"{e}_p90_log_price": F.coalesce(f"{e}_p90_log_price", g_mean + NORMAL_P90 * g_std),
                    f"{e}_iqr_log_price": F.coalesce(f"{e}_iqr_log_price", NORMAL_IQR * g_std),
                }
        unused = ["brand_count"]
        if not c.target_encoding:
            unused += [f"{e}_{s}_log_price" for e in ("brand", "model") for s in ("mean", "median", "std")]
        if not c.quantile_features:
            unused += [f"{e}_{s}_log_price" for e in ("brand", "model") for s in ("p25", "p75", "p90", "iqr")]
        return out.withColumns(filled).drop(*unused)

    def save(self, path: str) -> None:
        for name, df in self.state.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.state["globals"].sparkSession
        config = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self.config).items()}
        spark.createDataFrame([config]).write.mode("overwrite").json(f"{path}/config")
        blocks = [(b.col, b.prefix, b.levels, b.drop_input) for b in self.blocks]
        spark.createDataFrame(
            blocks, "col string, prefix string, levels array<string>, drop_input boolean"
        ).write.mode("overwrite").parquet(f"{path}/blocks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PriceEncoderModel":
        row = spark.read.json(f"{path}/config").first().asDict()
        config = replace(EncoderConfig(), **{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})
        state = {n: spark.read.parquet(f"{path}/{n}") for n in ("brands", "models", "ranks", "globals")}
        blocks = [
            OneHotModel(r["col"], r["prefix"], r["levels"], r["drop_input"])
            for r in spark.read.parquet(f"{path}/blocks").collect()
        ]
        return cls(config, state, blocks)


class OneHot(Estimator):
    """0/1 columns per level in alphabetical order; the first level is left out."""

    def __init__(
        self, col: str, prefix: str | None = None, drop_first: bool = True, drop_input: bool = False,
        max_levels: int = 5000,
    ):
        super().__init__()
        self.col, self.prefix, self.drop_first, self.drop_input = col, prefix or col, drop_first, drop_input
        self.max_levels = max_levels

    def _fit(self, dataset: DataFrame) -> "OneHotModel":
        levels = [
            r[0] for r in
            dataset.select(F.col(self.col).cast("string")).where(F.col(self.col).isNotNull())
            .distinct().orderBy(self.col).take(self.max_levels + 1)
        ]
        if len(levels) > self.max_levels:
            raise ValueError(f"{self.col} has more than {self.max_levels} levels: use sparse_onehot")
        return OneHotModel(self.col, self.prefix, levels[1:] if self.drop_first else levels, self.drop_input)


class OneHotModel(Model):
    def __init__(self, col: str, prefix: str, levels: Sequence[str], drop_input: bool = False):
        super().__init__()
        self.col, self.prefix, self.levels, self.drop_input = col, prefix, list(levels), drop_input

    @property
    def columns(self) -> list[str]:
        return [f"{self.prefix}_{level}" for level in self.levels]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = F.col(self.col).cast("string")
        out = dataset.withColumns({
            name: F.coalesce(text == level, F.lit(False)).cast("int")
            for name, level in zip(self.columns, self.levels)
        })
        return out.drop(self.col) if self.drop_input else out


def sparse_onehot(col: str, out: str, df: DataFrame) -> Pipeline:
    """Sparse one-hot for thousands of levels: first level left out, unseen levels all zero.

    Indexes run backwards through the alphabet, so the level to leave out is the last one.
    """
    index = f"_{col}_index"
    n = df.select(col).where(F.col(col).isNotNull()).distinct().count()
    return Pipeline(stages=[
        StringIndexer(inputCol=col, outputCol=index, stringOrderType="alphabetDesc", handleInvalid="keep"),
        OneHotEncoder(inputCol=index, outputCol=f"_{col}_all", dropLast=True),
        VectorSlicer(inputCol=f"_{col}_all", outputCol=out, indices=list(range(n - 1))),
    ])


class Standardize(Estimator):
    """(x - mean) / population spread for every numeric column but the excluded ones."""

    def __init__(self, exclude: Sequence[str] = ("price", "log_price", "id", "car_id", "listing_id", "year")):
        super().__init__()
        self.exclude = tuple(exclude)

    def _fit(self, dataset: DataFrame) -> "StandardizeModel":
        cols = [
            f.name for f in dataset.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in self.exclude
        ]
        aggs = [F.avg(c).alias(f"m_{c}") for c in cols] + [F.stddev_pop(c).alias(f"s_{c}") for c in cols]
        row = dataset.agg(*aggs).first()
        return StandardizeModel({c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols})


class StandardizeModel(Model):
    def __init__(self, moments: Mapping[str, tuple[float, float]]):
        super().__init__()
        self.moments = dict(moments)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.moments.items() if m is not None})


class CvEncoder(Estimator):
    """Coefficient of variation of the price per key, learned from training rows."""

    def __init__(self, keys: Sequence[str] = ("brand", "model"), price: str = "price", *, eager: bool = True):
        super().__init__()
        self.keys, self.price, self.eager = tuple(keys), price, eager

    def _fit(self, dataset: DataFrame) -> "CvEncoderModel":
        tables = {}
        for k in self.keys:
            table = price_cv(dataset, [k], self.price).withColumnRenamed("cv", f"{k}_price_cv")
            tables[k] = settle(table) if self.eager else table
        return CvEncoderModel(tables)


class CvEncoderModel(Model):
    def __init__(self, tables: Mapping[str, DataFrame]):
        super().__init__()
        self.tables = dict(tables)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for key, table in self.tables.items():
            out = join_on(out, table, [key], "left").withColumn(
                f"{key}_price_cv", F.coalesce(f"{key}_price_cv", F.lit(0.0))
            )
        return out


class CategoryCodes(Estimator):
    """Whole-number codes of text columns, reused at scoring; unseen values get the next code."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, dataset: DataFrame):
        return StringIndexer(
            inputCols=self.cols, outputCols=[f"{c}_code" for c in self.cols],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ).fit(dataset)


class FuelFlags(Transformer):
    """Stateless fuel keyword flags and their premium variants."""

    def __init__(self, col: str = "energie", top: str = "brand_top25_price"):
        super().__init__()
        self.col, self.top = col, top

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = add_block(dataset, keyword_flags(self.col, FUEL_KEYWORDS))
        return fx.premium_flags(out, ["is_ev", "is_traditional_fuel"], self.top)


def lean_matrix(df: DataFrame, features: Sequence[str] = LEAN_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    return align(df, features, 0.0, keep)


def expanded_pipeline(config: EncoderConfig = EncoderConfig(horsepower=True, brand_onehot=True)) -> Pipeline:
    """Encoder, fuel flags, power and spread features: refit it on the training rows of each fold."""
    return Pipeline(stages=[PriceEncoder(config), FuelFlags(), CvEncoder()])


def save_pipeline(fitted: PipelineModel, spark: SparkSession, path: str) -> None:
    """The stages of a fitted pipeline as one folder: a line per stage, and the tables and Spark stages beside it."""
    lines = []
    for i, stage in enumerate(fitted.stages):
        at, kind, values = f"{path}/stage_{i}", type(stage).__name__, None
        if isinstance(stage, PriceEncoderModel):
            stage.save(at)
        elif isinstance(stage, CvEncoderModel):
            values = list(stage.tables)
            for key, table in stage.tables.items():
                table.write.mode("overwrite").parquet(f"{at}/{key}")
        elif isinstance(stage, OneHotModel):
            values = [stage.col, stage.prefix, stage.levels, stage.drop_input]
        elif isinstance(stage, StandardizeModel):
            values = [[c, m, s] for c, (m, s) in stage.moments.items()]
        elif isinstance(stage, FuelFlags):
            values = [stage.col, stage.top]
        else:
            kind, values = "spark", f"{type(stage).__module__}.{type(stage).__qualname__}"
            stage.write().overwrite().save(at)
        lines.append((i, kind, json.dumps(values)))
    spark.createDataFrame(lines, "place int, kind string, value string").write.mode("overwrite").parquet(f"{path}/stages")


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    """What `save_pipeline` wrote."""
    def read(place: int, kind: str, value: str):
        at, values = f"{path}/stage_{place}", json.loads(value)
        if kind == "PriceEncoderModel":
            return PriceEncoderModel.load(spark, at)
        if kind == "CvEncoderModel":
            return CvEncoderModel({key: spark.read.parquet(f"{at}/{key}") for key in values})
        if kind == "OneHotModel":
            return OneHotModel(*values)
        if kind == "StandardizeModel":
            return StandardizeModel({c: (m, s) for c, m, s in values})
        if kind == "FuelFlags":
            return FuelFlags(*values)
        module, name = values.rsplit(".", 1)
        return getattr(import_module(module), name).load(at)

    rows = spark.read.parquet(f"{path}/stages").orderBy("place").collect()
    return PipelineModel([read(r.place, r.kind, r.value) for r in rows])


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one vector, nulls as 0."""
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(filled)

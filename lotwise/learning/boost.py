"""Linear and boosted models of prices; see `hist` for how boosted trees are trained.

Quantile models are boosted trees whose leaves hold the wanted quantile of the residuals that fall into them (Friedman
2001). All levels of one call are trained in the same passes over the rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lotwise.config import QUANTILES
from lotwise.learning import hist
from lotwise.scale import settle


def linear_price(df: DataFrame, features: Sequence[str], label: str = "log_price"):
    """Pipeline-ready linear model of the log price over named feature columns."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    return LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction").fit(rows)


def boosted_price(
    df: DataFrame, features: Sequence[str], label: str = "log_price",
    rounds: int = 20, depth: int = 5, step: float = 0.1, loss: str = "squared", min_rows: int = 1,
) -> "QuantileBoostModel":
    """Boosted trees for the mean (`loss` = squared) or the median (absolute) of a label."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    alpha = {"squared": None, "absolute": 0.5}[loss]
    return QuantileBoost(alpha, rounds=rounds, depth=depth, step=step, label=label, min_rows=min_rows).fit(rows)


def feature_array(df: DataFrame, features: str) -> Column:
    """A vector or array column as an array of doubles."""
    column = F.col(features)
    return vector_to_array(column) if isinstance(df.schema[features].dataType, VectorUDT) else column.cast("array<double>")


class QuantileBoost(Estimator):
    """Boosted trees for one quantile level of `label`, or its mean if `alpha` is None.

    `validation_col` marks rows kept out of training; boosting stops after
    `patience` rounds without a lower loss on them, and the model keeps the
    rounds up to the best one. `weight_col` weighs rows in growing the trees.
    `monotone` maps places in the feature vector to 1 (the prediction never
    falls with the feature) or -1 (never rises). Without `exact`, leaf values
    are interpolated in cells of 1/2048 of the residuals' range, which saves a
    pass over the rows per round.
    """

    def __init__(
        self, alpha: float | None = 0.5, rounds: int = 20, step: float = 0.3, depth: int = 4,
        features: str = "features", label: str = "log_price", prediction: str = "prediction",
        validation_col: str | None = None, patience: int = 50, settle_every: int = hist.SETTLED,
        weight_col: str | None = None, min_rows: int = 20, monotone: Mapping[int, int] | None = None, exact: bool = True,
    ):
        super().__init__()
        self.alpha, self.rounds, self.step, self.depth = alpha, rounds, step, depth
        self.features, self.label, self.prediction = features, label, prediction
        self.validation_col, self.patience, self.settle_every = validation_col, patience, settle_every
        self.weight_col, self.min_rows, self.monotone, self.exact = weight_col, min_rows, dict(monotone or {}), exact

    def _fit(self, dataset: DataFrame) -> "QuantileBoostModel":
        return fit_together(dataset, {self.prediction: self})[self.prediction]


def fit_together(df: DataFrame, models: Mapping[str, QuantileBoost]) -> dict[str, "QuantileBoostModel"]:
    """Fit models of the same rows, features and label in the same passes."""
    one = next(iter(models.values()))
    rows = settle(df.select(
        feature_array(df, one.features).alias("x"), F.col(one.label).cast("double").alias("y"),
        (F.col(one.weight_col).cast("double") if one.weight_col else F.lit(1.0)).alias("w"),
        (F.coalesce(F.col(one.validation_col), F.lit(False)) if one.validation_col else F.lit(False)).cast("boolean").alias("held")))
    first = rows.first()
    width = len(first.x) if first else 0
    specs = [
        hist.Spec(m.alpha, tuple(range(width)), m.step, m.rounds, m.depth, m.min_rows, monotone=m.monotone, patience=m.patience)
        for m in models.values()]
    fitted = hist.train(rows, "x", width, "y", specs, held="held", weight="w", settled=one.settle_every, exact=one.exact)
    return {name: QuantileBoostModel(f, m.features, m.prediction) for (name, m), f in zip(models.items(), fitted)}


class QuantileBoostModel(Model):
    def __init__(self, fitted: hist.HistModel, features: str = "features", prediction: str = "prediction"):
        super().__init__()
        self.fitted, self.features, self.prediction = fitted, features, prediction

    @property
    def best_iteration(self) -> int:
        return len(self.fitted.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scores = hist.predict(feature_array(dataset, self.features), [self.fitted])
        return dataset.withColumn(self.prediction, F.get(scores, F.lit(0)))

    def feature_importances(self, n_features: int) -> list[float]:
        """Share of each feature in the gain of all splits."""
        shares = self.fitted.importances()
        return shares + [0.0] * (n_features - len(shares))

    def explain(self, dataset: DataFrame, contributions: str = "contributions", base: str = "base_value") -> DataFrame:
        """`dataset` with what each feature adds to the prediction of each row (an array in the order of the features) and
        the base value: together they are the prediction."""
        return dataset.withColumns({
            contributions: hist.contributions(feature_array(dataset, self.features), self.fitted),
            base: F.lit(hist.expected_value(self.fitted))})

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"features": self.features, "prediction": self.prediction, **self.fitted.to_json()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantileBoostModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return cls(hist.HistModel.from_json(meta), meta["features"], meta["prediction"])


def fit_quantiles(df: DataFrame, qs: Mapping[str, float] = QUANTILES, **params) -> dict[str, QuantileBoostModel]:
    """One boosted model per named level, each predicting into '<name>_log'; all are trained in the same passes."""
    return fit_together(df, {name: QuantileBoost(alpha=alpha, prediction=f"{name}_log", **params) for name, alpha in qs.items()})


def predict_quantiles(df: DataFrame, models: Mapping[str, QuantileBoostModel]) -> DataFrame:
    """Score all models in one pass and take the logarithm back."""
    features = next(iter(models.values())).features
    out = df.withColumn("__scores", hist.predict(feature_array(df, features), [m.fitted for m in models.values()]))
    for i, (name, model) in enumerate(models.items()):
        out = out.withColumn(model.prediction, F.get("__scores", F.lit(i))).withColumn(name, F.exp(model.prediction))
    return out.drop("__scores")


def importances(values: Sequence[float], features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance), most important first."""
    schema = T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType()),
    ])
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], schema
    ).orderBy(F.desc("importance"), "feature")


def save_bundle(spark: SparkSession, path: str, encoder, models: Mapping[str, QuantileBoostModel], features: Sequence[str]) -> None:
    """Encoder, models and the feature order, as one folder."""
    encoder.save(f"{path}/encoder")
    for name, model in models.items():
        model.save(spark, f"{path}/model_{name}")
    spark.createDataFrame(
        [(json.dumps({"features": list(features), "models": list(models)}),)], "value string"
    ).write.mode("overwrite").text(f"{path}/bundle")


def load_bundle(spark: SparkSession, path: str):
    from lotwise.learning.encode import PriceEncoderModel

    meta = json.loads(spark.read.text(f"{path}/bundle").first()["value"])
    models = {name: QuantileBoostModel.load(spark, f"{path}/model_{name}") for name in meta["models"]}
    return PriceEncoderModel.load(spark, f"{path}/encoder"), models, meta["features"]

"""Error, interval and calibration metrics: aggregates over a scored frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.config import AGE_BUCKETS
from lotwise.functions.features import age_bucket
from lotwise.operators.keys import join_on
from lotwise.operators.quantiles import quantile_table
from lotwise.operators.stats import bin_label, describe, mean_std, n_rows


def ape(y: str, pred: str) -> Column:
    """|error| in % of the actual value, which counts as at least 1."""
    return F.abs(F.col(y) - F.col(pred)) * 100 / F.greatest(F.col(y), F.lit(1.0))


def _core(y: str, pred: str) -> list[Column]:
    a, p = F.col(y).cast("double"), F.col(pred).cast("double")
    e = a - p
    sse, sst = F.sum(e * e), F.var_pop(a) * F.count(a)
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(sse, sst)).alias("r2"),
        (F.avg(F.try_divide(F.abs(e), F.abs(a))) * 100).alias("mape"),
    ]


def _scored(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return _scored(df, y, pred).groupBy(*by).agg(n_rows(), *_core(y, pred))


def median_errors(df: DataFrame, y: str, pred: str, by: Sequence[str] = (), *, strategy=None) -> DataFrame:
    errors = _scored(df, y, pred).withColumns({
        "_ae": F.abs(F.col(y) - F.col(pred)), "_ape": ape(y, pred),
    })
    return quantile_table(errors, by, {"medae": ("_ae", 0.5), "median_ape": ("_ape", 0.5)}, strategy=strategy)


def adjusted_r2(metrics: DataFrame, p: int, n: str = "n", r2: str = "r2") -> DataFrame:
    return metrics.withColumn(
        "adjusted_r2", 1 - F.try_divide((1 - F.col(r2)) * (F.col(n) - 1), F.col(n) - p - 1)
    )


def pinball_of(y: Column, pred: Column, alpha: float) -> Column:
    e = y - pred
    return F.when(e >= 0, e * alpha).otherwise(e * (alpha - 1))


def pinball(df: DataFrame, y: str, pred: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean pinball loss of ln(pred) against ln(y), both clipped away from zero."""
    log = lambda c: F.ln(F.greatest(F.col(c).cast("double"), F.lit(1e-6)))
    return _scored(df, y, pred).groupBy(*by).agg(F.avg(pinball_of(log(y), log(pred), alpha)).alias("pinball"))


def coverage(df: DataFrame, y: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    v, a, b = F.col(y), F.col(lo), F.col(hi)
    pct = lambda c: F.avg(c.cast("int")) * 100
    return _scored(df, y, lo, hi).groupBy(*by).agg(
        n_rows(), pct(v.between(a, b)).alias("coverage_pct"),
        pct(v < a).alias("below_pct"), pct(v > b).alias("above_pct"),
    )


def interval_width(df: DataFrame, lo: str, hi: str, y: str, by: Sequence[str] = (), *, strategy=None) -> DataFrame:
    w = F.col("_w")
    rows = _scored(df, lo, hi, y).withColumn("_w", F.col(hi) - F.col(lo)).withColumn(
        "_rel", w * 100 / F.greatest(F.col(y), F.lit(1.0))
    )
    return quantile_table(
        rows, by, {"median_width": ("_w", 0.5)},
        aggs=[
            F.avg(w).alias("mean_width"), F.stddev_samp(w).alias("std_width"),
            F.min(w).alias("min_width"), F.max(w).alias("max_width"),
            F.avg("_rel").alias("mean_relative_width"),
        ],
        strategy=strategy,
    )


def crossings(df: DataFrame, q_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(summary, the rows whose quantiles are out of order, with what is wrong)."""
    low, mid, high = (F.col(c) for c in q_cols)
    first, second = low > mid, mid > high
    issue = (
        F.when(first & second, "both").when(first, f"{q_cols[0]} > {q_cols[1]}")
        .when(second, f"{q_cols[1]} > {q_cols[2]}")
    )
    labelled = _scored(df, *q_cols).withColumn("issue", issue)
    summary = labelled.agg(
        n_rows(), F.count_if(F.col("issue").isNotNull()).alias("n_crossings"),
        F.count_if(low > high).alias("n_negative_width"),
        (F.avg(F.col("issue").isNotNull().cast("int")) * 100).alias("crossing_pct"),
    )
    return summary, labelled.where("issue is not null")


def calibration(df: DataFrame, y: str, cols: Mapping[float, str], by: Sequence[str] = ()) -> DataFrame:
    """Per nominal level: share of actual values at or below the quantile, and its error."""
    one = _scored(df, y, *cols.values()).groupBy(*by).agg(
        *[F.avg((F.col(y) <= F.col(c)).cast("int")).alias(f"_s{i}") for i, c in enumerate(cols.values())]
    )
    rows = F.array(*[
        F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_s{i}").alias("share_below")) for i, a in enumerate(cols)
    ])
    return one.select(*by, F.inline(rows)).withColumn(
        "abs_error", F.abs(F.col("share_below") - F.col("alpha"))
    )


def accuracy_bands(df: DataFrame, y: str, pred: str, bands: Sequence[float] = (5, 10, 15, 20, 25)) -> DataFrame:
    error = F.abs(F.try_divide((F.col(pred) - F.col(y)) * 100, F.col(y)))
    one = _scored(df, y, pred).agg(
        *[(F.avg((error <= b).cast("int")) * 100).alias(f"_b{i}") for i, b in enumerate(bands)]
    )
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("band"), F.col(f"_b{i}").alias("within_pct")) for i, b in enumerate(bands)
    ])
    return one.select(F.inline(rows))


def metrics_by(df: DataFrame, key: str | Sequence[str], y: str, pred: str, min_n: int = 10) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return regression_metrics(df, y, pred, keys).where(F.col("n") >= min_n)


def year_metrics(
    df: DataFrame, y: str, q15: str, q50: str, q85: str, min_n: int = 3, by: str | Sequence[str] = "year",
    *, strategy=None,
) -> DataFrame:
    """Error profile per group: primary metric is the median absolute % error."""
    keys = [by] if isinstance(by, str) else list(by)
    floor = F.greatest(F.col(y), F.lit(1.0))
    rows = _scored(df, y, q15, q50, q85).withColumns({
        "_ape": ape(y, q50), "_signed": (F.col(q50) - F.col(y)) * 100 / floor,
    })
    return quantile_table(
        rows, keys,
        {"median_price": (y, 0.5), "median_ape": ("_ape", 0.5), "median_signed_pct": ("_signed", 0.5)},
        aggs=[
            n_rows(), F.avg(F.abs(F.col(y) - F.col(q50))).alias("mae"), F.avg("_ape").alias("mape"),
            F.avg(F.col(y).between(F.col(q15), F.col(q85)).cast("int")).alias("coverage"),
        ],
        strategy=strategy,
    ).where(F.col("n") >= min_n)


def bucket_metrics(
    df: DataFrame, y: str, q15: str, q50: str, q85: str, age: str = "car_age",
    buckets: Sequence[tuple[int, int, str]] = AGE_BUCKETS, min_n: int = 3, *, strategy=None,
) -> DataFrame:
    label, order = age_bucket(age, buckets)
    rows = df.withColumns({"age_bucket": label, "bucket_order": order}).where("age_bucket is not null")
    return year_metrics(
        rows, y, q15, q50, q85, min_n, by=["age_bucket", "bucket_order"], strategy=strategy
    ).orderBy("bucket_order")


def error_over_median(df: DataFrame, key: str, y: str, pred: str, *, strategy=None) -> DataFrame:
    """Mean |error| of each group in % of its median actual value.

    The median is the same for all rows of a group, so the mean error is taken
    first and divided once; rows are not joined back.
    """
    rows = _scored(df, y, pred)
    return quantile_table(
        rows, [key], {"group_median": (y, 0.5)},
        aggs=[n_rows(), F.avg(F.abs(F.col(y) - F.col(pred))).alias("_mae")], strategy=strategy,
    ).select(
        key, "n", "group_median",
        F.try_divide(F.col("_mae") * 100, F.col("group_median")).alias("pct_error_over_median"),
    )


def mae_by(df: DataFrame, key: str, y: str, pred: str) -> DataFrame:
    return _scored(df, y, pred).groupBy(key).agg(
        n_rows(), F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae")
    )


def metrics_by_range(
    df: DataFrame, y: str, pred: str, lo: str, hi: str, edges: Sequence[float], labels: Sequence[str]
) -> DataFrame:
    """Errors, coverage and crossings by range of the actual value."""
    crossed = (F.col(lo) > F.col(pred)) | (F.col(pred) > F.col(hi))
    return (
        _scored(df, y, pred, lo, hi)
        .withColumn("range", bin_label(F.col(y), edges, labels)).where("range is not null")
        .groupBy("range").agg(
            n_rows(), *_core(y, pred)[:2], F.avg(ape(y, pred)).alias("mape_floor1"),
            (F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("int")) * 100).alias("coverage_pct"),
            F.avg(F.col(hi) - F.col(lo)).alias("mean_width"),
            F.count_if(crossed).alias("n_crossings"),
        )
    )


def compare_models(
    df: DataFrame, y: str, a: Sequence[str], b: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Model b against a, each given as (q15, q50, q85) columns of one frame."""
    ya = F.col(y)
    ea, eb = F.abs(ya - F.col(a[1])), F.abs(ya - F.col(b[1]))
    wa, wb = F.col(a[2]) - F.col(a[0]), F.col(b[2]) - F.col(b[0])
    return _scored(df, y, *a, *b).groupBy(*by).agg(
        n_rows(), F.avg(ea).alias("mae_a"), F.avg(eb).alias("mae_b"),
        F.sqrt(F.avg(ea * ea)).alias("rmse_a"), F.sqrt(F.avg(eb * eb)).alias("rmse_b"),
        F.count_if(wb < wa).alias("n_narrower"), F.count_if(wb > wa).alias("n_wider"),
        F.count_if(wb == wa).alias("n_same"),
        F.avg(wa).alias("width_a"), F.avg(wb).alias("width_b"),
    ).withColumns({
        "mae_improvement_pct": F.try_divide((F.col("mae_a") - F.col("mae_b")) * 100, F.col("mae_a")),
        "width_reduction_pct": F.try_divide((F.col("width_a") - F.col("width_b")) * 100, F.col("width_a")),
    })


def train_test_delta(train: DataFrame, test: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Train rows, test rows and test-minus-train rows of a metric table."""
    values = [c for c in train.columns if c not in by]
    both = train.select(*by, *[F.col(v).alias(f"_a_{v}") for v in values]).join(
        test.select(*by, *[F.col(v).alias(f"_b_{v}") for v in values]), list(by)
    )

    def line(name, pick):
        return F.struct(F.lit(name).alias("dataset"), *[pick(v).cast("double").alias(v) for v in values])

    rows = F.array(
        line("train", lambda v: F.col(f"_a_{v}")), line("test", lambda v: F.col(f"_b_{v}")),
        line("test-train", lambda v: F.col(f"_b_{v}") - F.col(f"_a_{v}")),
    )
    return both.select(*by, F.inline(rows))


def trimmed_residuals(
    df: DataFrame, y: str, preds: Mapping[str, str], lo: float = 0.025, hi: float = 0.975, *, strategy=None
) -> DataFrame:
    """Summary of each prediction's residuals between two of their own quantiles."""
    long = _scored(df, y, *preds.values()).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("model_name"), (F.col(y) - F.col(c)).alias("residual"))
        for name, c in preds.items()
    ])))
    cuts = quantile_table(long, ["model_name"], {"_lo": ("residual", lo), "_hi": ("residual", hi)}, strategy=strategy)
    inner = join_on(long, cuts, ["model_name"]).where(F.col("residual").between(F.col("_lo"), F.col("_hi")))
    return describe(inner, ["residual"], by=["model_name"], strategy=strategy).drop("column")


def fold_stability(metrics: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return mean_std(metrics, by, cols)


def quantile_metric_table(
    df: DataFrame, y: str, variants: Mapping[str, Mapping[float, str]], *, strategy=None
) -> DataFrame:
    """MAE, RMSE, R², median APE and pinball per (variant, quantile), from one melted frame."""
    lines = [
        F.struct(F.lit(v).alias("variant"), F.lit(float(alpha)).alias("alpha"), F.col(c).cast("double").alias("pred"))
        for v, cols in variants.items() for alpha, c in cols.items()
    ]
    long = (
        df.select(F.col(y).cast("double").alias("y"), F.inline(F.array(*lines))).dropna()
        .withColumn("_ape", ape("y", "pred"))
    )
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-6)))
    e = log("y") - log("pred")
    loss = F.when(e >= 0, e * F.col("alpha")).otherwise(e * (F.col("alpha") - 1))
    return quantile_table(
        long, ["variant", "alpha"], {"median_ape": ("_ape", 0.5)},
        aggs=[n_rows(), *_core("y", "pred")[:3], F.avg(loss).alias("pinball")], strategy=strategy,
    )

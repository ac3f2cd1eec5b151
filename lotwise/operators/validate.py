"""Declared values against the market."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from lotwise.config import SUPPORT_EDGES, SUPPORT_LABELS, XAF_TO_EUR
from lotwise.functions.features import gap_pct
from lotwise.functions.parse import convert, crosswalk, std_key, year_of_text
from lotwise.operators.keys import with_one_row
from lotwise.operators.match import band_join, coverage, exact_reference, match_counts
from lotwise.operators.metrics import _core
from lotwise.operators.quantiles import quantile_table
from lotwise.operators.stats import bin_label, describe, keep_top_groups, label_order, n_rows, pivot

MARKET_QUANTILES = {
    "train_p10": 0.10, "train_q15": 0.15, "train_q50": 0.50, "train_q85": 0.85, "train_p90": 0.90,
}
SECOND_QUANTILES = {"p10": 0.10, "p50": 0.50, "p90": 0.90}
COVERAGE_CATEGORIES = ("below_q15", "within_interval", "above_q85")
TIERS = ("GREEN", "ORANGE", "RED")


def normalize_declarations(
    df: DataFrame, country: str, brand: str, model: str, year: str, value: str,
    brand_map: Mapping[str, str] | DataFrame | None = None,
    model_map: Mapping[str, str] | DataFrame | None = None,
    rate: float = XAF_TO_EUR, km: float = 100_000.0, keep: Sequence[str] = (),
) -> DataFrame:
    """One schema for every country: country, brand, model, year, actual_price_eur, km."""
    out = df.select(
        F.lit(country).alias("country"),
        std_key(brand).alias("brand"), std_key(model).alias("model"),
        year_of_text(F.col(year).cast("string")).alias("year"),
        convert(F.col(value).cast("double"), rate).alias("actual_price_eur"),
        F.lit(km).alias("km"), *keep,
    )
    if brand_map is not None:
        out = crosswalk(out, "brand", brand_map)
    return crosswalk(out, "model", model_map) if model_map is not None else out


def market_reference(
    decl: DataFrame, market: DataFrame, year_flex: int = 3, price: str = "price",
    eq: Sequence[str] = ("brand", "model"), year: str = "year",
    qs: Mapping[str, float] = MARKET_QUANTILES, *, strategy=None,
) -> DataFrame:
    """Declarations with the quantiles and number of market rows of the same key within ±year_flex."""
    spec = {name: (price, q) for name, q in qs.items()}
    return band_join(decl, market, eq, year, year_flex, spec, "training_sample_size", strategy=strategy)


def market_range(
    decl: DataFrame, market: DataFrame, year_flex: int = 3, price: str = "price",
    eq: Sequence[str] = ("brand", "model"), year: str = "year",
) -> DataFrame:
    """Declarations with the lowest and highest market price within ±year_flex."""
    spec = {"train_min": (price, 0.0), "train_max": (price, 1.0)}
    return band_join(decl, market, eq, year, year_flex, spec, "training_sample_size")


def assign_tier(
    df: DataFrame, declared: str = "declared_price", q15: str = "pred_q15", q50: str = "pred_q50",
    q85: str = "pred_q85", range: str = "p10_p90", n: str = "training_sample_size",
) -> DataFrame:
    """GREEN inside the predicted interval, ORANGE inside the market range, RED otherwise."""
    columns = {"p10_p90": ("train_p10", "train_p90"), "min_max": ("train_min", "train_max")}
    low, high = columns[range]
    value = F.col(declared)
    green = value.between(F.col(q15), F.col(q85))
    orange = (F.col(n) > 0) & value.between(F.col(low), F.col(high))
    return df.withColumns({
        "gap_pct": gap_pct(q50, declared),
        "color_tier": F.when(green, "GREEN").when(orange, "ORANGE").otherwise("RED"),
    })


def validate(
    decl: DataFrame, market: DataFrame, second: DataFrame, year_flex: int = 3, price: str = "price",
    declared: str = "declared_price", eq: Sequence[str] = ("brand", "model"), year: str = "year",
    *, strategy=None,
) -> DataFrame:
    """Tier of each declaration, with a second market matched on the exact year."""
    matched = market_reference(decl, market, year_flex, price, eq, year, strategy=strategy)
    both = exact_reference(matched, second, [*eq, year], price, SECOND_QUANTILES)
    return assign_tier(both, declared)


def second_market_coverage(
    decl: DataFrame, second: DataFrame, keys: Sequence[str] = ("brand", "model", "year")
) -> DataFrame:
    """Declared combinations: how many, and how many the second market knows."""
    flagged, _ = coverage(decl.select(*keys).distinct(), second, keys)
    return flagged.agg(
        n_rows("n_combinations"), F.count_if("has_match").alias("n_matched"),
        (F.avg(F.col("has_match").cast("int")) * 100).alias("matched_pct"),
    )


def match_support(
    decl: DataFrame, market: DataFrame, k: int, eq: Sequence[str] = ("brand", "model"), year: str = "year",
    edges: Sequence[float] = SUPPORT_EDGES, labels: Sequence[str] = SUPPORT_LABELS, which: str = "n_band",
) -> DataFrame:
    """Declarations per range of their number of market matches."""
    counted = match_counts(decl, market, eq, year, k)
    per_range = counted.groupBy(bin_label(F.col(which), edges, labels).alias("support")).agg(n_rows())
    total = per_range.agg(F.sum("n").alias("_t"))
    return with_one_row(per_range, total).select(
        "support", label_order("support", labels).alias("support_order"), "n",
        (F.col("n") * 100.0 / F.col("_t")).alias("pct"),
    )


def coverage_category(df: DataFrame, y: str, lo: str, mid: str, hi: str) -> DataFrame:
    """Where the value lies, and four measures of how far off it is."""
    v, a, m, b = (F.col(c) for c in (y, lo, mid, hi))
    return df.withColumns({
        "coverage_category": F.when(v < a, "below_q15").when(v > b, "above_q85").otherwise("within_interval"),
        "absolute_deviation": F.abs(v - m),
        "percentage_deviation": F.try_divide(F.abs(v - m) * 100, m),
        "below_q15_pct": F.try_divide((a - v) * 100, a),
        "above_q85_pct": F.try_divide((v - b) * 100, b),
    })


def deviation_summary(df: DataFrame, high: float = 30.0, by: Sequence[str] = (), *, strategy=None) -> DataFrame:
    spec = {
        f"{q}_{short}": (col, p)
        for short, col in (("abs", "absolute_deviation"), ("pct", "percentage_deviation"))
        for q, p in (("median", 0.5), ("p90", 0.9))
    }
    return quantile_table(
        df, by, spec,
        aggs=[
            n_rows(), F.avg("absolute_deviation").alias("mean_abs"),
            F.avg("percentage_deviation").alias("mean_pct"),
            F.count_if(F.col("percentage_deviation") > high).alias("n_high"),
            *[F.count_if(F.col("coverage_category") == c).alias(f"n_{c}") for c in COVERAGE_CATEGORIES],
        ],
        strategy=strategy,
    )


def coverage_by_top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Coverage categories of the n most declared keys, side by side."""
    counts = pivot(
        keep_top_groups(df, key, n), key, "coverage_category", COVERAGE_CATEGORIES, F.count(F.lit(1))
    )
    return counts.fillna(0, list(COVERAGE_CATEGORIES))


def high_risk(df: DataFrame, threshold: float = 20.0, tie: Sequence[str] = ()) -> DataFrame:
    """Values far outside the interval on either side, worst first."""
    worst = F.greatest(F.col("below_q15_pct"), F.col("above_q85_pct"))
    return df.where(worst > threshold).withColumn("excess_pct", worst).orderBy(F.desc("excess_pct"), *tie)


def coverage_by(df: DataFrame, key: str, y: str, lo: str, hi: str) -> DataFrame:
    inside = F.col(y).between(F.col(lo), F.col(hi))
    return df.groupBy(key).agg(
        n_rows(), F.count_if(inside).alias("n_inside"),
        F.count_if(F.col(y) < F.col(lo)).alias("n_below"), F.count_if(F.col(y) > F.col(hi)).alias("n_above"),
        (F.avg(inside.cast("int")) * 100).alias("coverage_pct"),
    )


def metrics_side_by_side(
    df: DataFrame, key: str, values: Sequence[str], y: str, q15: str, q50: str, q85: str
) -> DataFrame:
    """One row per metric, one column per listed value of the key."""
    inside = F.col(y).between(F.col(q15), F.col(q85)).cast("int")
    names = ("mae", "rmse", "r2", "mape", "coverage_pct", "mean_width")
    per_key = df.groupBy(key).agg(
        *_core(y, q50), (F.avg(inside) * 100).alias("coverage_pct"),
        F.avg(F.col(q85) - F.col(q15)).alias("mean_width"),
    )
    long = per_key.select(key, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names
    ])))
    return pivot(long, "metric", key, values, F.first("value"))


def _gaps(df: DataFrame, declared: str, q15: str, q50: str) -> DataFrame:
    rows = [
        F.struct(
            F.lit(name).alias("reference"), (F.col(q) - F.col(declared)).alias("gap_eur"),
            F.try_divide((F.col(q) - F.col(declared)) * 100, F.col(q)).alias("gap_pct"),
        )
        for name, q in (("q50", q50), ("q15", q15))
    ]
    return df.select(F.inline(F.array(*rows)))


def undervaluation_stats(
    df: DataFrame, declared: str = "declared_price", q15: str = "pred_q15", q50: str = "pred_q50", *, strategy=None
) -> DataFrame:
    """Gap of the declared value below the median and the lower prediction, in € and %."""
    return quantile_table(
        _gaps(df, declared, q15, q50), ["reference"],
        {"median_eur": ("gap_eur", 0.5), "median_pct": ("gap_pct", 0.5)},
        aggs=[
            F.avg("gap_eur").alias("mean_eur"), F.stddev_samp("gap_eur").alias("std_eur"),
            F.min("gap_eur").alias("min_eur"), F.max("gap_eur").alias("max_eur"),
            F.avg("gap_pct").alias("mean_pct"),
        ],
        strategy=strategy,
    )


def severity_zones(
    df: DataFrame, declared: str = "declared_price", q15: str = "pred_q15", q50: str = "pred_q50", q85: str = "pred_q85"
) -> DataFrame:
    """Rows per zone; all four zones are listed even when empty."""
    v = F.col(declared)
    zones = {
        "below_q15": v < F.col(q15),
        "q15_q50": (v >= F.col(q15)) & (v < F.col(q50)),
        "q50_q85": (v >= F.col(q50)) & (v <= F.col(q85)),
        "above_q85": v > F.col(q85),
    }
    one = df.agg(n_rows("_n"), *[F.count_if(c).alias(z) for z, c in zones.items()])
    rows = F.array(*[F.struct(F.lit(z).alias("zone"), F.col(z).alias("n")) for z in zones])
    return one.select("_n", F.inline(rows)).select("zone", "n", F.try_divide(F.col("n") * 100.0, "_n").alias("pct"))


def gap_by_year(df: DataFrame, year: str = "year", gap: str = "gap_pct", declared: str = "declared_price", pred: str = "pred_q50") -> DataFrame:
    return quantile_table(
        df, [year],
        {"median_gap_pct": (gap, 0.5), "median_declared": (declared, 0.5), "median_predicted": (pred, 0.5)},
        aggs=[n_rows(), F.avg(gap).alias("mean_gap_pct")],
    )


def tier_counts(
    df: DataFrame, by: str, groups: Mapping[str, str] | None = None, declared: str = "declared_price"
) -> DataFrame:
    """Declarations per tier, and the median declared value, per country or brand group."""
    rows = crosswalk(df, by, groups) if groups else df
    return quantile_table(
        rows, [by], {"median_declared": (declared, 0.5)},
        aggs=[n_rows(), *[F.count_if(F.col("color_tier") == t).alias(t.lower()) for t in TIERS]],
    )


def price_stats(df: DataFrame, key: str, price: str, values: Sequence[str] | None = None, *, strategy=None) -> DataFrame:
    """Descriptive statistics per key; with `values`, one column per key value."""
    table = describe(df, [price], by=[key], strategy=strategy).drop("column", "n_null")
    if values is None:
        return table
    names = [c for c in table.columns if c != key]
    long = table.select(key, F.inline(F.array(*[
        F.struct(F.lit(m).alias("statistic"), F.col(m).cast("double").alias("value")) for m in names
    ])))
    return pivot(long, "statistic", key, values, F.first("value"))

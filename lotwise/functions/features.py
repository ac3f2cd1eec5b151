"""Stateless feature expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.config import AGE_BUCKETS
from lotwise.functions.parse import Col, _c


def car_age(year: Col, current_year: int) -> Column:
    return F.lit(current_year) - _c(year)


def decade(year: Col) -> Column:
    return (F.floor(_c(year) / 10) * 10).cast("int")


def newness_flags(year: Col, current_year: int) -> list[Column]:
    age = car_age(year, current_year)
    return [
        (age <= 1).alias("is_almost_new"),
        (age < 2).alias("is_new_car"),
        (age > 15).alias("is_old_car"),
    ]


def _first_match(cases: Iterable[tuple[Column, str]], otherwise: Column) -> Column:
    chain = None
    for condition, label in cases:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain.otherwise(otherwise)


def age_category(year: Col, current_year: int) -> Column:
    # Largest age of each category and its label.
    limits = (
        (2, "new_0-2yr"), (5, "recent_3-5yr"), (10, "mid_age_6-10yr"), (15, "older_11-15yr"),
    )
    age = car_age(year, current_year)
    return _first_match([(age <= top, label) for top, label in limits], F.lit("very_old_16+yr"))


def age_bucket(age: Col, buckets: Sequence[tuple[int, int, str]] = AGE_BUCKETS) -> tuple[Column, Column]:
    """(label, order): closed ranges; ages outside all of them give null."""
    a = _c(age)
    label = _first_match([(a.between(lo, hi), name) for lo, hi, name in buckets], F.lit(None))
    order = None
    for i, (lo, hi, _) in enumerate(buckets):
        order = F.when(a.between(lo, hi), i) if order is None else order.when(a.between(lo, hi), i)
    return label, order


def km_per_year(km: Col, age: Col, variant: str = "guard") -> Column:
    """'guard': km/age, or km where age <= 0; 'plus_one': km/(age+1)."""
    k, a = _c(km), _c(age)
    if variant == "plus_one":
        return F.try_divide(k, a + 1)
    if variant != "guard":
        raise ValueError(f"unknown variant {variant!r}")
    return F.when(a > 0, F.try_divide(k, a)).otherwise(k)


def mileage_flags(km: Col, p75: Col) -> list[Column]:
    k = _c(km)
    return [
        (k < 50_000).alias("is_low_mileage"),
        (k > _c(p75)).alias("is_high_mileage"),
        (k < 10_000).alias("is_nearly_new_mileage"),
    ]


def mileage_category(km: Col, p25: Col, p50: Col, p75: Col, p90: Col) -> Column:
    k = _c(km)
    limits = ((p25, "very_low"), (p50, "low"), (p75, "medium"), (p90, "high"))
    return _first_match([(k < _c(p), label) for p, label in limits], F.lit("very_high"))


def log_features(km: Col, per_year: Col) -> list[Column]:
    return [F.log1p(_c(km)).alias("log_km"), F.log1p(_c(per_year)).alias("log_km_per_year")]


def polynomials(age: Col, km: Col) -> list[Column]:
    a, k = _c(age).cast("double"), _c(km).cast("double")
    return [
        k.alias("mileage"),
        F.pow(a, F.lit(2.0)).alias("age_squared"),
        F.pow(a, F.lit(3.0)).alias("age_cubed"),
        F.pow(k, F.lit(2.0)).alias("mileage_squared"),
        F.pow(k, F.lit(3.0)).alias("mileage_cubed"),
        F.sqrt(F.greatest(k, F.lit(0.0))).alias("sqrt_km"),
        F.sqrt(F.greatest(a, F.lit(0.0))).alias("sqrt_age"),
    ]


def interactions(age: Col, km: Col) -> list[Column]:
    a, k = _c(age).cast("double"), _c(km).cast("double")
    return [
        (a * k).alias("age_mileage"),
        (a * a * k).alias("age_squared_mileage"),
        (a * k * k).alias("age_mileage_squared"),
        (a * k / 1000).alias("age_km_interaction"),
    ]


def usage_flags(age: Col, km: Col) -> list[Column]:
    a, k = _c(age), _c(km)
    return [
        ((a < 5) & (k < 50_000)).alias("is_low_use_recent"),
        ((a < 3) & (k > 150_000)).alias("is_high_use_new"),
        ((a > 15) & (k < 50_000)).alias("is_garage_queen"),
    ]


def hp_features(df: DataFrame, col: str = "horsepower") -> DataFrame:
    """Power and its square, cube and root; a frame without the column passes unchanged."""
    if col not in df.columns:
        return df
    hp = F.col(col).cast("double")
    return df.withColumns({
        "hp": hp, "hp_squared": hp * hp, "hp_cubed": hp * hp * hp,
        "sqrt_hp": F.sqrt(F.greatest(hp, F.lit(0.0))),
    })


def premium_flags(df: DataFrame, flags: Sequence[str], top_col: str) -> DataFrame:
    """flag AND top-brand for each flag, as 0/1."""
    return df.withColumns({
        f"{flag}_premium": ((F.col(flag) == 1) & (F.col(top_col) == 1)).cast("int") for flag in flags
    })


def log_target(df: DataFrame, col: str = "price", kind: str = "ln", out: str = "log_price") -> DataFrame:
    """ln keeps positive prices only; log1p keeps all that are not below zero."""
    if kind == "ln":
        return df.where(F.col(col) > 0).withColumn(out, F.ln(col))
    if kind == "log1p":
        return df.where(F.col(col) >= 0).withColumn(out, F.log1p(col))
    raise ValueError(f"unknown target {kind!r}")


def inverse(c: Col, kind: str = "ln") -> Column:
    return F.exp(_c(c)) if kind == "ln" else F.expm1(_c(c))


def delta(a: Col, b: Col) -> Column:
    return _c(b) - _c(a)


def pct_change(a: Col, b: Col) -> Column:
    return F.try_divide((_c(b) - _c(a)) * 100, _c(a))


def gap_pct(pred: Col, actual: Col) -> Column:
    """Gap of a declared value below its prediction, in % of the prediction."""
    return F.try_divide(_c(pred) - _c(actual), _c(pred)) * 100


def power_ratios(df: DataFrame, hp: str = "horsepower", age: str = "car_age", km: str = "km") -> DataFrame:
    """Power per year of age (+1), per km (+1000), and power times age."""
    h, a, k = F.col(hp).cast("double"), F.col(age), F.col(km)
    return df.withColumns({
        "hp_per_age": F.try_divide(h, a + 1),
        "hp_per_km": F.try_divide(h, k + 1000),
        "hp_x_age": h * a,
    })


def plausible_km(km: Col, age: Col, hi_per_year: float = 60_000, lo_per_year: float = 1_000, lo_from_age: int = 10) -> list[Column]:
    """Flags for a mileage too high for any age, or too low for an old car."""
    rate, a = km_per_year(km, age), _c(age)
    too_high = rate > hi_per_year
    too_low = (a >= lo_from_age) & (rate < lo_per_year)
    return [too_high.alias("km_too_high"), too_low.alias("km_too_low"), (~too_high & ~too_low).alias("km_plausible")]

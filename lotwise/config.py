"""Parameters and fixed vocabularies shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Labels and closed ranges of the age buckets, in display order.
AGE_BUCKETS = (
    (0, 2, "0-2"),
    (3, 5, "3-5"),
    (6, 10, "6-10"),
    (11, 15, "11-15"),
    (16, 20, "16-20"),
    (21, 200, "21+"),
)

# The lean model matrix, in column order.
LEAN_FEATURES = (
    "car_age",
    "brand_avg_age", "brand_median_age",
    "brand_mean_log_price", "brand_median_log_price", "brand_std_log_price",
    "model_count", "model_popularity_ratio",
    "model_mean_log_price", "model_median_log_price", "model_std_log_price",
    "is_almost_new", "decade",
    "sqrt_age", "age_squared", "age_cubed",
    "brand_top25_price", "brand_bottom25_price", "brand_top5_price",
    "model_top25_price", "model_bottom25_price", "model_top5_price",
    "model_rank_within_brand",
    "brand_p25_log_price", "brand_p75_log_price", "brand_p90_log_price", "brand_iqr_log_price",
    "model_p25_log_price", "model_p75_log_price", "model_p90_log_price", "model_iqr_log_price",
)

# Fuel keyword lists.
FUEL_KEYWORDS = {
    "is_ev": ("électrique", "electric"),
    "is_hybrid": ("hybride", "hybrid"),
    "is_alternative_fuel": ("gpl", "e85", "éthanol", "gaz"),
    "is_traditional_fuel": ("essence", "diesel", "gasoil"),
}

# Accented letters and their plain forms, pairwise.
ACCENTED = "éèêëàâäùûüôöîïçñ"
PLAIN = "eeeeaaauuuooiicn"

# Match-support histogram.
SUPPORT_EDGES = (0, 1, 10, 50, 100, 500, 1000)
SUPPORT_LABELS = ("0", "1-9", "10-49", "50-99", "100-499", "500-999", "1000+")

# Fixed value: euro per CFA franc used for declared values.
XAF_TO_EUR = 0.0015

# Normal-approximation constants for entities without statistics.
NORMAL_P25, NORMAL_P75, NORMAL_P90, NORMAL_IQR = -0.674, 0.674, 1.282, 1.349

RAW_LISTING_COLUMNS = (
    "url", "index_date", "first_publication_date", "price", "marque", "modele",
    "annee_modele", "kilometrage", "energie", "puissance_din", "reference",
)

QUANTILES = {"q15": 0.15, "q50": 0.50, "q85": 0.85}


@dataclass(frozen=True)
class CleaningConfig:
    """Thresholds of the cleaning plan, in the order its stages use them."""

    price_floor: float | None = None
    price_ceiling: float | None = None
    min_year: int = 1990
    placeholder: str = "autre"
    hp_bounds: tuple[float, float] = (50.0, 1000.0)
    hp_multiplier: float = 1.5
    min_brand_count: int = 400
    price_multiplier: float = 1.5
    km_multiplier: float = 1.5
    large_group: int = 50
    min_pool: int = 10
    sparse: str = "drop"


@dataclass(frozen=True)
class EncoderConfig:
    """Which feature blocks the price encoder learns and emits."""

    current_year: int = 2025
    min_samples: int = 5
    model_key: tuple[str, ...] = ("model",)
    logs: bool = True
    polynomials: bool = True
    target_encoding: bool = True
    categories: bool = True
    interactions: bool = True
    quantile_features: bool = True
    horsepower: bool = False
    brand_onehot: bool = False
    fuel_onehot: bool = False

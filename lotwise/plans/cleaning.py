"""Raw text listings to clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from lotwise.config import CleaningConfig
from lotwise.functions.parse import normalize_text, parse_hp, parse_km, parse_money, try_num
from lotwise.operators.quality import (
    common_keys, group_fences, iqr_bounds, iqr_filter, iqr_filter_pooled, prepare_fences,
)
from lotwise.operators.rows import bound, drop_placeholder, min_year, require_target, to_canonical
from lotwise.operators.stats import n_rows
from lotwise.scale import settle

CLEAN_COLUMNS = ("price", "year", "km", "brand", "model", "energie", "horsepower")


def typed_listings(raw: DataFrame) -> DataFrame:
    """Canonical, typed columns of raw listings; rows without a price are dropped."""
    return require_target(to_canonical(raw, {
        "price": parse_money("price"),
        "year": try_num("annee_modele"),
        "km": parse_km("kilometrage"),
        "brand": normalize_text("marque"),
        "model": normalize_text("modele"),
        "energie": F.col("energie"),
        "horsepower": parse_hp("puissance_din"),
    }))


def cleaning_stages(
    raw: DataFrame, config: CleaningConfig = CleaningConfig(), *, strategy=None, lazy: bool = False
) -> dict[str, DataFrame]:
    """The frame after each stage, in order. Later statistics see earlier filters.

    Each stage that depends on statistics reads the rows before it once more.
    So the text is parsed once and the typed rows are settled: later passes read
    only the columns they need, and bounds reach the files as pushed filters.
    The small tables (fences per brand, common brands, fences per brand and
    year) are settled too, one pass each; the rest is one lazy scan with joins
    to them. `lazy=True` leaves everything to the action.
    """
    fix = (lambda table: table) if lazy else settle
    hp = {"horsepower": config.hp_multiplier}
    stages = {"typed": fix(typed_listings(raw))}
    stages["price_bounds"] = bound(stages["typed"], "price", config.price_floor, config.price_ceiling)
    stages["min_year"] = min_year(stages["price_bounds"], config.min_year)
    stages["placeholder"] = drop_placeholder(stages["min_year"], ["brand", "model"], config.placeholder)

    powered = bound(stages["placeholder"], "horsepower", *config.hp_bounds)
    fences = fix(group_fences(powered, ["brand"], hp, strategy=strategy))
    stages["horsepower"] = iqr_filter(powered, ["brand"], hp, fences=fences)

    common = fix(common_keys(stages["horsepower"], "brand", config.min_brand_count))
    stages["rare_brands"] = stages["horsepower"].join(common, "brand", "left_semi")

    rows = prepare_fences(stages["rare_brands"])
    measures = {"log_price1p": config.price_multiplier, "km": config.km_multiplier}
    limits = (config.large_group, config.min_pool)
    bounds = fix(iqr_bounds(rows, "brand", "year", measures, *limits, strategy=strategy))
    fenced = iqr_filter_pooled(rows, "brand", "year", measures, *limits, config.sparse, bounds=bounds)
    stages["clean"] = fenced.select(*CLEAN_COLUMNS)
    return stages


def clean(
    raw: DataFrame, config: CleaningConfig = CleaningConfig(), *, strategy=None, lazy: bool = False
) -> DataFrame:
    return cleaning_stages(raw, config, strategy=strategy, lazy=lazy)["clean"]


def with_stats(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while they pass; read the observation after any action."""
    seen = Observation(name)
    return df.observe(seen, n_rows()), seen


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(step, stage, n_rows): the counters of each stage as a frame."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.lit(i).alias("step"), F.lit(name).alias("stage"), n_rows("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out

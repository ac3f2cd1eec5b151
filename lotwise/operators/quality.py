"""Fences, sweeps, duplicate audits and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.operators.keys import join_on, with_one_row
from lotwise.operators.quantiles import for_targets, quantile_table
from lotwise.operators.rows import valid_rows
from lotwise.operators.stats import n_rows, pivot, rate_by
from lotwise.operators.match import lookalike_counts
from lotwise.scale import settle

Measures = Mapping[str, float]
Tier = tuple[int, Mapping[str, float]]


def _quartile_spec(measures: Sequence[str]) -> dict[str, tuple[str, float]]:
    return {f"{q}_{m}": (m, p) for m in measures for q, p in (("q1", 0.25), ("q3", 0.75))}


def _with_fences(table: DataFrame, multiplier: Mapping[str, Column | float]) -> DataFrame:
    """lo_/hi_ columns from q1_/q3_ columns."""
    cols = {}
    for m, mult in multiplier.items():
        reach = (F.col(f"q3_{m}") - F.col(f"q1_{m}")) * (mult if isinstance(mult, Column) else F.lit(float(mult)))
        cols[f"lo_{m}"] = F.col(f"q1_{m}") - reach
        cols[f"hi_{m}"] = F.col(f"q3_{m}") + reach
    return table.withColumns(cols)


def _inside(measures: Sequence[str]) -> Column:
    ok = F.lit(True)
    for m in measures:
        ok = ok & F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    return F.coalesce(ok, F.lit(False))


def group_fences(
    df: DataFrame, keys: Sequence[str], measures: Measures, tier: Tier | None = None,
    *, strategy: str | None = None,
) -> DataFrame:
    """Quartiles and fences per group. `measures` maps a column to its multiplier;
    `tier` = (N, stricter multipliers) applies to groups of more than N rows."""
    table = quantile_table(df, keys, _quartile_spec(list(measures)), aggs=[n_rows("n_group")], strategy=strategy)
    multiplier: dict[str, Column | float] = dict(measures)
    if tier:
        limit, strict = tier
        for m, value in strict.items():
            multiplier[m] = F.when(F.col("n_group") > limit, float(value)).otherwise(float(measures[m]))
    return _with_fences(table, multiplier)


def iqr_flag(
    df: DataFrame, keys: Sequence[str], measures: Measures, tier: Tier | None = None,
    flag: str = "is_iqr_outlier", *, strategy: str | None = None, fences: DataFrame | None = None,
) -> DataFrame:
    """Flag rows outside their group's fences (computed from `df` unless given)."""
    if fences is None:
        fences = group_fences(df, keys, measures, tier, strategy=strategy)
    bounds = [f"{side}_{m}" for m in measures for side in ("lo", "hi")]
    return (
        join_on(df, fences.select(*keys, *bounds), list(keys), "left")
        .withColumn(flag, ~_inside(list(measures)))
        .drop(*bounds)
    )


def iqr_filter(
    df: DataFrame, keys: Sequence[str], measures: Measures, tier: Tier | None = None,
    *, strategy: str | None = None, fences: DataFrame | None = None,
) -> DataFrame:
    """Rows whose measures all lie within their group's fences, bounds included."""
    flagged = iqr_flag(df, keys, measures, tier, "_out", strategy=strategy, fences=fences)
    return flagged.where("not _out").drop("_out")


def iqr_outliers(df: DataFrame, col: str, mult: float = 1.5, *, strategy: str | None = None) -> DataFrame:
    """Rows outside the fences of the whole column."""
    known = df.where(F.col(col).isNotNull())
    return iqr_flag(known, [], {col: mult}, flag="_out", strategy=strategy).where("_out").drop("_out")


def iqr_bounds(
    df: DataFrame, brand: str, year: str, measures: Measures, large: int = 50, min_pool: int = 10,
    *, strategy: str | None = None,
) -> DataFrame:
    """Fences per (brand, year) with their origin.

    Groups of at least `large` rows use their own quartiles (``brand_year``);
    smaller ones those of the years next to them too (``brand_year_pm1``); a
    pool below `min_pool` gives ``no_bound`` and null fences. One quantile pass
    serves both kinds: a row goes to its own group, and to the small groups
    next to it.
    """
    by = [brand, year]
    sizes = settle(df.groupBy(*by).agg(n_rows("n_group")))
    rows = df.select(*by, *measures)
    # own rows of every group, and those next to the small groups
    small = sizes.where(F.col("n_group") < large)
    asked = for_targets(rows, small, [brand], year, 1)
    direct = join_on(rows, sizes.where(F.col("n_group") >= large).select(*by), by)
    # group sizes and quantiles both read the pool
    pool = settle(direct.select(*by, *measures).unionByName(asked))
    table = quantile_table(pool, by, _quartile_spec(list(measures)), aggs=[n_rows("n_pool")], strategy=strategy)
    table = join_on(table, sizes, by)
    own = F.col("n_group") >= large
    usable = own | (F.col("n_pool") >= min_pool)
    fenced = _with_fences(table, measures)
    bounds = {
        f"{s}_{m}": F.when(usable, F.col(f"{s}_{m}")) for m in measures for s in ("lo", "hi")
    }
    source = F.when(own, "brand_year").when(usable, "brand_year_pm1").otherwise("no_bound")
    return (
        fenced.withColumns({**bounds, "source": source})
        .select(*by, "n_group", "n_pool", *bounds, "source")
    )


def prepare_fences(df: DataFrame, price: str = "price", km: str = "km", year: str = "year") -> DataFrame:
    """Valid rows with ln(price+1) as `log_price1p` and a whole-number year."""
    return (
        df.where(valid_rows(price, km, [year]))
        .withColumn("log_price1p", F.log1p(price))
        .withColumn(year, F.col(year).cast("int"))
    )


def iqr_flag_pooled(
    df: DataFrame, brand: str, year: str, measures: Measures, large: int = 50, min_pool: int = 10,
    sparse: str = "drop", flag: str = "is_iqr_outlier", *, strategy: str | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Flag rows outside their (brand, year) fences; `sparse` says what happens without fences."""
    if sparse not in ("drop", "keep"):
        raise ValueError(f"unknown sparse rule {sparse!r}")
    if bounds is None:
        bounds = iqr_bounds(df, brand, year, measures, large, min_pool, strategy=strategy)
    cols = [f"{s}_{m}" for m in measures for s in ("lo", "hi")]
    joined = join_on(df, bounds.select(brand, year, *cols, "source"), [brand, year], "left")
    keep = _inside(list(measures))
    if sparse == "keep":
        keep = keep | (F.col("source") == "no_bound")
    return joined.withColumn(flag, ~keep).drop(*cols)


def iqr_filter_pooled(
    df: DataFrame, brand: str, year: str, measures: Measures, large: int = 50, min_pool: int = 10,
    sparse: str = "drop", *, strategy: str | None = None, bounds: DataFrame | None = None,
) -> DataFrame:
    flagged = iqr_flag_pooled(
        df, brand, year, measures, large, min_pool, sparse, "_out", strategy=strategy, bounds=bounds
    )
    return flagged.where("not _out").drop("_out", "source")


def bounds_summary(bounds: DataFrame) -> DataFrame:
    """Groups and rows per origin of the fences."""
    return bounds.groupBy("source").agg(n_rows("n_groups"), F.sum("n_group").alias("n_rows"))


def iqr_sweep(
    df: DataFrame, key: str, price: str, km: str, multipliers: Sequence[float],
    high_volume: int = 10_000, standard: float = 1.5, *, strategy: str | None = None,
) -> DataFrame:
    """Effect of each price multiplier on high-volume groups (others keep the standard one).

    Quartiles are taken once, every multiplier is judged in the same aggregate
    over the rows; no row is copied per multiplier.
    """
    table = quantile_table(df, [key], _quartile_spec([price, km]), aggs=[n_rows("_n")], strategy=strategy)
    rows = join_on(df.select(key, price, km), table, [key])

    def outside(m: str, mult: float) -> Column:
        reach = (F.col(f"q3_{m}") - F.col(f"q1_{m}")) * float(mult)
        return (F.col(m) < F.col(f"q1_{m}") - reach) | (F.col(m) > F.col(f"q3_{m}") + reach)

    big = F.col("_n") > high_volume
    out_km = outside(km, standard)
    aggs = [n_rows("n"), F.count_if(big).alias("n_big")]
    for i, mult in enumerate(multipliers):
        out_price = F.when(big, outside(price, mult)).otherwise(outside(price, standard))
        aggs += [
            F.count_if(out_price | out_km).alias(f"t{i}"),
            F.count_if(out_price).alias(f"p{i}"),
            F.count_if(big & (out_price | out_km)).alias(f"h{i}"),
        ]
    one = rows.agg(*aggs)
    lines = F.array(*[
        F.struct(
            F.lit(float(m)).alias("multiplier"), F.col(f"t{i}").alias("total_outliers"),
            F.col(f"p{i}").alias("price_outliers"), F.col(f"h{i}").alias("high_volume_outliers"),
        )
        for i, m in enumerate(multipliers)
    ])
    removed = F.col("total_outliers") * 100.0 / F.col("n")
    retention = (F.col("n") - F.col("total_outliers")) * 100.0 / F.col("n")
    return one.select("n", "n_big", F.inline(lines)).select(
        "multiplier", "total_outliers", "price_outliers", "high_volume_outliers",
        (F.col("n") - F.col("total_outliers")).alias("data_retained"),
        retention.alias("retention_rate"),
        F.coalesce(
            F.try_divide((F.col("n_big") - F.col("high_volume_outliers")) * 100.0, F.col("n_big")), F.lit(100.0)
        ).alias("high_volume_retention"),
        F.when(removed > 0.5, retention / 100 * (removed / 5.0)).alias("balance_score"),
    )


def best_multiplier(sweep: DataFrame) -> DataFrame:
    """The multiplier with the highest balance of retention and removal; of equal ones the smallest. None if no
    multiplier removes enough."""
    scored = sweep.where(F.col("balance_score").isNotNull())
    return scored.orderBy(F.desc("balance_score"), "multiplier").limit(1).select("multiplier", "balance_score")


def common_keys(df: DataFrame, key: str, min_count: int) -> DataFrame:
    return df.groupBy(key).agg(n_rows("_n")).where(F.col("_n") >= min_count).select(key)


def drop_rare(df: DataFrame, key: str, min_count: int) -> DataFrame:
    """Rows of keys that occur at least `min_count` times; null is a key of its own."""
    return join_on(df, settle(common_keys(df, key, min_count)), [key], "left_semi")


def rare_counts(df: DataFrame, key: str, min_count: int) -> DataFrame:
    kept = F.col("n") >= min_count
    return df.groupBy(key).agg(n_rows()).agg(
        n_rows("n_keys"), F.count_if(kept).alias("n_kept"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("rows_after"),
    )


def group_mid_frequency(
    df: DataFrame, key: str, child: str, price: str, lo: int, hi: int, *, strategy: str | None = None
) -> DataFrame:
    """Drop keys under `lo` rows; keys under `hi` become a price tier, and so do their children.

    The tier compares the key's mean price with the 33rd and 67th percentile
    of all remaining prices.
    """
    counts = settle(df.groupBy(key).agg(n_rows("_n"), F.avg(price).alias("_mean")).where(F.col("_n") >= lo))
    kept = df.join(counts.select(key), key, "left_semi")
    cuts = quantile_table(kept, [], {"_p33": (price, 0.33), "_p67": (price, 0.67)}, strategy=strategy)
    tier = (
        F.when(F.col("_mean") <= F.col("_p33"), "other_low_cost")
        .when(F.col("_mean") >= F.col("_p67"), "other_luxury")
        .otherwise("other_standard")
    )
    tiers = (
        with_one_row(counts.where(F.col("_n") < hi), cuts)
        .select(key, tier.alias("_tier"))
    )
    return (
        df.join(counts.select(key), key, "left_semi")
        .join(tiers, key, "left")
        .withColumn(child, F.coalesce("_tier", child))
        .withColumn(key, F.coalesce("_tier", key))
        .drop("_tier")
    )


def threshold_sweep(df: DataFrame, key: str, thresholds: Sequence[int]) -> DataFrame:
    """Keys and rows kept and lost per minimum count; counted once."""
    counts = df.groupBy(key).agg(n_rows())
    kept = F.col("n") >= F.col("threshold")
    return (
        counts.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
        .groupBy("threshold").agg(
            F.count_if(kept).alias("keys_kept"), F.count_if(~kept).alias("keys_removed"),
            F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("rows_kept"),
            F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("rows_lost"),
        )
    )


def near_dup_audit(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Natural keys listed under more than one id: groups, rows, redundant rows and their rate.

    Distinct ids are found by (key, id) first, so a hot key is spread over its ids.
    """
    per_id = df.groupBy(*keys, id_col).agg(n_rows("_rows"))
    per_key = per_id.groupBy(*keys).agg(F.sum("_rows").alias("n"), n_rows("n_ids"))
    multi = F.col("n_ids") > 1
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(multi).alias("n_groups"),
        F.coalesce(F.sum(F.when(multi, F.col("n"))), F.lit(0)).alias("rows_in_groups"),
    ).select(
        "n_rows", "n_groups", "rows_in_groups",
        (F.col("rows_in_groups") - F.col("n_groups")).alias("redundant_rows"),
        F.try_divide((F.col("rows_in_groups") - F.col("n_groups")) * 100.0, F.col("n_rows")).alias("rate_pct"),
    )


def pair_drift(pairs: DataFrame, col: str = "price", *, strategy: str | None = None) -> DataFrame:
    """Shares of changed, lower and higher values, and median changes, over paired rows."""
    old, new = F.col(f"{col}_a"), F.col(f"{col}_b")
    moved = pairs.where((old > 0) & (new > 0)).select(((new - old) / old * 100).alias("pct")).withColumn(
        "abs_pct", F.abs("pct")
    )
    tiny = 1e-9
    return quantile_table(
        moved, [], {"median_pct": ("pct", 0.5), "median_abs_pct": ("abs_pct", 0.5)},
        aggs=[
            n_rows(),
            (F.avg((F.col("abs_pct") > tiny).cast("int")) * 100).alias("changed_pct"),
            (F.avg((F.col("pct") < -tiny).cast("int")) * 100).alias("decreased_pct"),
            (F.avg((F.col("pct") > tiny).cast("int")) * 100).alias("increased_pct"),
        ],
        strategy=strategy,
    )


def segment_drift(
    a: DataFrame, b: DataFrame, seg: Sequence[str], measure: str, min_n: int = 30, *, strategy: str | None = None
) -> DataFrame:
    """Change of the median per segment, for segments with enough rows in both snapshots."""
    def medians(df: DataFrame, tag: str) -> DataFrame:
        return quantile_table(
            df, seg, {f"median_{tag}": (measure, 0.5)}, aggs=[n_rows(f"n_{tag}")], strategy=strategy
        ).where(F.col(f"n_{tag}") >= min_n)

    return medians(a, "a").join(medians(b, "b"), list(seg)).withColumn(
        "drift_pct", F.try_divide((F.col("median_b") - F.col("median_a")) * 100, F.col("median_a"))
    )


def drift_by(drift: DataFrame, by: str) -> DataFrame:
    return quantile_table(drift, [by], {"median_drift_pct": ("drift_pct", 0.5)}, aggs=[n_rows("n_segments")])


def share_drift(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Share of each value in both snapshots and the change in points."""
    def shares(df: DataFrame, tag: str) -> DataFrame:
        counts = df.groupBy(col).agg(n_rows("_n"))
        total = counts.agg(F.sum("_n").alias("_t"))
        return with_one_row(counts, total).select(
            col, (F.col("_n") * 100.0 / F.col("_t")).alias(f"share_{tag}")
        )

    left = shares(a, "a")
    right = shares(b, "b").withColumnRenamed(col, "_r")
    return left.join(right, F.col(col).eqNullSafe(F.col("_r")), "full").select(
        F.coalesce(col, "_r").alias(col),
        F.coalesce("share_a", F.lit(0.0)).alias("share_a"),
        F.coalesce("share_b", F.lit(0.0)).alias("share_b"),
    ).withColumn("change_points", F.col("share_b") - F.col("share_a"))


def drop_rate_audit(flagged: DataFrame, by: Sequence[str], flag: str = "is_iqr_outlier") -> DataFrame:
    return rate_by(flagged, by, flag)


def drop_rate_pivot(
    flagged: DataFrame, row: str, col: str, values: Sequence[str], flag: str = "is_iqr_outlier"
) -> DataFrame:
    return pivot(flagged, row, col, values, F.avg(F.col(flag).cast("int")) * 100)


def compare_drop_rates(flagged: DataFrame, by: Sequence[str], old: str, new: str) -> DataFrame:
    """Drop rate per segment under two rules, from one pass."""
    rate = lambda f: F.avg(F.col(f).cast("int")) * 100
    return flagged.groupBy(*by).agg(
        n_rows("n_total"), rate(old).alias("old_pct"), rate(new).alias("new_pct"),
    ).withColumn("change_points", F.col("new_pct") - F.col("old_pct"))


def key_audit(df: DataFrame, brand: str = "brand", model: str = "model", short: int = 2) -> DataFrame:
    """Counts of suspicious keys per brand: combinations, singletons, short names, look-alike pairs."""
    combos = df.groupBy(brand, model).agg(n_rows())
    base = combos.groupBy(brand).agg(
        n_rows("n_models"), F.count_if(F.col("n") == 1).alias("n_single"),
        F.count_if(F.length(F.trim(F.col(model))) < short).alias("n_short"),
    )
    alike = lookalike_counts(df, brand, model)
    return join_on(base, alike, [brand], "left").withColumn(
        "n_lookalikes", F.coalesce("n_lookalikes", F.lit(0))
    )



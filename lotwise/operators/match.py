"""Joins: statistics onto rows, snapshots with each other, declarations with markets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from lotwise.operators.keys import join_on
from lotwise.operators.quantiles import for_targets, quantile_table
from lotwise.operators.windows import dedup_subset
from lotwise.scale import settle


def join_stats(df: DataFrame, stats: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Left equi join of a table with one row per key."""
    return join_on(df, stats, [keys] if isinstance(keys, str) else list(keys), "left")


def pair_snapshots(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """One row per key in both: (key, <col>_a, <col>_b)."""
    return a.select(key, F.col(col).alias(f"{col}_a")).join(
        b.select(key, F.col(col).alias(f"{col}_b")), key
    )


def join_aggregates(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys))


def join_counts(df: DataFrame, counts: DataFrame, key: str, col: str = "n") -> DataFrame:
    """Left join of counts; a key without one has 0."""
    return join_on(df, counts, [key], "left").withColumn(col, F.coalesce(F.col(col), F.lit(0)))


def coverage(df: DataFrame, ref: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with `has_match`, distinct key combinations without a match)."""
    seen = settle(ref.select(*keys).distinct().withColumn("_hit", F.lit(True)))
    flagged = join_on(df, seen, keys, "left").withColumn("has_match", F.col("_hit").isNotNull()).drop("_hit")
    return flagged, flagged.where("not has_match").select(*keys).distinct()


def band_quantiles(
    targets: DataFrame, market: DataFrame, eq: Sequence[str], band: str, k: int,
    spec: Mapping[str, tuple[str, float]], n: str = "n", *, strategy: str | None = None,
) -> DataFrame:
    """Quantiles of the market rows within ±k of each distinct target key.

    The targets are spread over the 2k+1 bands they ask for and meet the market by
    an equality join: market rows that no one asks for are never copied.
    """
    by = [*eq, band]
    measures = list(dict.fromkeys(c for c, _ in spec.values()))
    wanted = settle(targets.select(*by).distinct())
    # group sizes and quantiles both read the pool
    pool = settle(for_targets(market.select(*by, *measures), wanted, eq, band, k))
    return quantile_table(pool, by, spec, aggs=[F.count(F.lit(1)).alias(n)], strategy=strategy)


def band_join(
    left: DataFrame, right: DataFrame, eq: Sequence[str], band: str, k: int,
    spec: Mapping[str, tuple[str, float]], n: str = "n", *, strategy: str | None = None,
) -> DataFrame:
    """Every left row with the quantiles of its matches and their number (0 kept)."""
    table = band_quantiles(left, right, eq, band, k, spec, n, strategy=strategy)
    return left.join(table, [*eq, band], "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))


def match_counts(left: DataFrame, right: DataFrame, eq: Sequence[str], band: str, k: int) -> DataFrame:
    """Per left row, matches at the same band value and within ±k."""
    by = [*eq, band]
    exact = right.groupBy(*by).agg(F.count(F.lit(1)).alias("n_exact"))
    wanted = settle(left.select(*by).distinct())
    near = for_targets(exact, wanted, eq, band, k).groupBy(*by).agg(F.sum("n_exact").alias("n_band"))
    both = settle(join_on(near, exact, by, "left"))
    return left.join(both, by, "left").withColumns({
        c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_exact", "n_band")
    })


def exact_reference(
    left: DataFrame, right: DataFrame, keys: Sequence[str], col: str,
    qs: Mapping[str, float], prefix: str = "second_",
) -> DataFrame:
    """Percentiles of an exactly matching second market beside each left row."""
    spec = {f"{prefix}{name}": (col, q) for name, q in qs.items()}
    table = quantile_table(
        right, keys, spec, aggs=[F.count(F.lit(1)).alias(f"{prefix}n")]
    )
    joined = left.join(table, list(keys), "left")
    n = F.coalesce(F.col(f"{prefix}n"), F.lit(0))
    return joined.withColumn(f"{prefix}n", n).withColumn(f"{prefix}has_data", F.col(f"{prefix}n") > 0)


def offset_join(
    left: DataFrame, right: DataFrame, eq: Sequence[str], band: str, offsets: Sequence[int] = (-1, 0, 1)
) -> DataFrame:
    """Distinct left keys against right rows at band + offset; the right band value is kept.

    `right` should hold few rows per key (aggregated, or one example per key).
    """
    keys = left.select(*eq, F.col(band).alias("target_band")).distinct()
    wanted = keys.withColumn("band_offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    wanted = wanted.withColumn(band, F.col("target_band") + F.col("band_offset"))
    return wanted.join(right, [*eq, band])


def lookalikes(
    df: DataFrame, group: str, name: str, prefix: int = 3, max_len_diff: int = 2
) -> DataFrame:
    """Pairs of names in a group with the same first letters and nearly the same length.

    Names are distinct values with counts. Length is part of the equality (one
    side is spread over the lengths it may meet), so only real pairs are formed.
    """
    names = _names(df, group, name, prefix)
    a = names.select(group, F.col(name).alias("name_a"), F.col("_n").alias("n_a"), "_p",
                     F.explode(F.sequence(F.col("_l") - max_len_diff, F.col("_l") + max_len_diff)).alias("_l"))
    b = names.select(group, F.col(name).alias("name_b"), F.col("_n").alias("n_b"), "_p", "_l")
    return a.join(b, [group, "_p", "_l"]).where("name_a < name_b").drop("_p", "_l")


def _names(df: DataFrame, group: str, name: str, prefix: int) -> DataFrame:
    """Distinct names with their count, first letters and length."""
    key = F.lower(F.trim(F.col(name)))
    return (
        df.where(F.length(key) > 0)
        .groupBy(group, name).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_p", F.substring(key, 1, prefix))
        .withColumn("_l", F.length(key))
    )


def lookalike_counts(
    df: DataFrame, group: str, name: str, prefix: int = 3, max_len_diff: int = 2, n: str = "n_lookalikes"
) -> DataFrame:
    """How many pairs `lookalikes` has per group, without forming them: names per first letters and length pair with
    each other and with those of the next lengths."""
    by = [group, "_p", "_l"]
    sizes = _names(df, group, name, prefix).where(F.col(group).isNotNull()).groupBy(*by).agg(F.count("*").alias("_c"))
    longer = sizes.select(
        group, "_p", F.explode(F.sequence(F.col("_l") - max_len_diff, F.col("_l") - 1)).alias("_l"),
        F.col("_c").alias("_d")).groupBy(*by).agg(F.sum("_d").alias("_d"))
    own = F.floor(F.col("_c") * (F.col("_c") - 1) / 2)
    pairs = sizes.join(longer, by, "left").select(group, (own + F.col("_c") * F.coalesce("_d", F.lit(0))).alias("_pairs"))
    return pairs.groupBy(group).agg(F.sum("_pairs").alias(n)).where(F.col(n) > 0)


def market_examples(
    decl: DataFrame, market: DataFrame, offsets: Sequence[int] = (-1, 0, 1),
    eq: Sequence[str] = ("brand", "model"), band: str = "year",
    picks: Mapping[str, tuple[str, str]] | None = None, show: Sequence[str] = ("price", "km", "horsepower"),
) -> DataFrame:
    """Example market rows for each declared combination: cheapest, weakest, most driven.

    The example of a (key, band) group does not depend on who asks for it, so all
    kinds and the count come from one aggregate of the market and are then looked
    up. Counts are at both levels.
    """
    picks = picks or {"lowest_price": ("price", "min"), "lowest_hp": ("horsepower", "min"), "highest_km": ("km", "max")}
    by = [*eq, band]

    def example(col: str, how: str):
        """The shown columns of the row that comes first by `col`, then by all of them."""
        best = F.col(col) if how == "min" else -F.col(col)
        return F.min_by(F.struct(*show), F.when(F.col(col).isNotNull(), F.struct(best, *show)))

    kinds = F.array(*[
        F.struct(F.lit(kind).alias("example_type"), F.col(f"_{kind}").alias("row")) for kind in picks])
    groups = settle(market.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count_at_band"), *[example(col, how).alias(f"_{kind}") for kind, (col, how) in picks.items()]))
    examples = (
        groups.select(*by, F.inline(kinds)).where("row is not null").select(*by, "row.*", "example_type")
    )
    found = offset_join(decl, examples, eq, band, offsets)
    unique = dedup_subset(
        found, [*by, "price", "km"], tie=["example_type", "target_band", "band_offset"]
    )
    here = groups.select(*by, "count_at_band")
    everywhere = here.groupBy(*eq).agg(F.sum("count_at_band").alias("count_all_bands"))
    return unique.join(here, by, "left").join(everywhere, list(eq), "left")

"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.operators.keys import join_on
from lotwise.scale import settle


def to_canonical(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Project, rename and cast to the canonical columns, in the order given."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in mapping.items()])


def require_target(df: DataFrame, col: str = "price") -> DataFrame:
    return df.where(F.col(col).isNotNull())


def bound(
    df: DataFrame, col: str, lo: float | None = None, hi: float | None = None, keep_null: bool = False
) -> DataFrame:
    """Rows with lo <= col <= hi; a null passes only with `keep_null`."""
    c = F.col(col)
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (c >= lo)
    if hi is not None:
        inside = inside & (c <= hi)
    return df.where(c.isNull() | inside) if keep_null else df.where(c.isNotNull() & inside)


def bound_counts(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """How many rows lie below and above the bounds, are null, and remain."""
    c = F.col(col)
    below = c < lo if lo is not None else F.lit(False)
    above = c > hi if hi is not None else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(below).alias("n_below"),
        F.count_if(above).alias("n_above"),
        F.count_if(c.isNull()).alias("n_null"),
        F.count_if(c.isNotNull() & ~below & ~above).alias("n_after"),
    )


def min_year(df: DataFrame, year: int, col: str = "year") -> DataFrame:
    return df.where(F.col(col) >= year)


def max_age(df: DataFrame, n: int, current_year: int, col: str = "year") -> DataFrame:
    return df.where(F.col(col) >= current_year - n)


def drop_placeholder(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """Rows whose columns are all known and none equals the placeholder, in any case."""
    wanted = [F.lower(F.col(c)) != value.lower() for c in cols]
    return df.where(reduce(lambda a, b: a & b, wanted))


def keep_in(df: DataFrame, col: str, keys_df: DataFrame) -> DataFrame:
    return df.join(settle(keys_df.select(col).distinct()), col, "left_semi")


def drop_in(df: DataFrame, col: str, keys_df: DataFrame) -> DataFrame:
    """Rows whose value is not listed; a null is not listed."""
    return df.join(settle(keys_df.select(col).distinct()), col, "left_anti")


def valid_rows(
    price: str = "price", km: str = "km", others: Sequence[str] = ("year", "brand", "model")
) -> Column:
    known = [F.col(c).isNotNull() for c in others]
    return reduce(lambda a, b: a & b, [F.col(price) > 0, F.col(km) >= 0, *known])


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def without_text(df: DataFrame, col: str, pattern: str, regex: bool = False) -> DataFrame:
    """Rows whose text does not contain the literal (or match the pattern)."""
    c = F.col(col)
    return df.where(~(c.rlike(pattern) if regex else c.contains(pattern)))


def is_between(c: str, lo: str | float, hi: str | float) -> Column:
    low = F.col(lo) if isinstance(lo, str) else F.lit(lo)
    high = F.col(hi) if isinstance(hi, str) else F.lit(hi)
    return F.col(c).between(low, high)


def align(df: DataFrame, features: Sequence[str], fill: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly these columns in this order, as doubles; absent ones and nulls are `fill`."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[
            F.coalesce(F.col(f).cast("double"), F.lit(float(fill))).alias(f)
            if f in present else F.lit(float(fill)).alias(f)
            for f in features
        ],
    )


def drop_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def short_names(df: DataFrame, col: str, below: int) -> DataFrame:
    return df.where(F.length(F.trim(F.col(col))) < below)


def singletons(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations seen exactly once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def keep_seen(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key combination occurs in the other frame."""
    return df.join(settle(keys_df.select(*keys).distinct()), list(keys), "left_semi")


def known_only(df: DataFrame, vocab: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with known values in every column, unseen values with their row counts)."""
    known, reports = df, []
    for c in cols:
        words = settle(vocab.select(c).where(F.col(c).isNotNull()).distinct())
        reports.append(
            known.join(words, c, "left_anti")
            .groupBy(F.lit(c).alias("column"), F.col(c).alias("value"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
        )
        known = known.join(words, c, "left_semi")
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return known, report


def vocabulary_diff(df: DataFrame, ref: DataFrame, col: str) -> DataFrame:
    """(col, n_rows, seen): every value of `col` and whether the reference has it."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    words = ref.select(col).distinct().withColumn("_hit", F.lit(True))
    return join_on(counts, words, [col], "left").select(
        col, "n_rows", F.col("_hit").isNotNull().alias("seen")
    )

"""Parsing and normalising raw text columns, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.config import ACCENTED, FUEL_KEYWORDS, PLAIN, XAF_TO_EUR

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_money(c: Col) -> Column:
    """'25 000 €' -> 25000.0; anything without one clean number -> null."""
    return F.regexp_replace(_c(c), "[^0-9.]", "").try_cast("double")


def currency(c: Col) -> Column:
    """The trailing run of non-digits."""
    return F.regexp_extract(_c(c), r"([^0-9]+)$", 1)


def parse_km(c: Col) -> Column:
    """'150,000 km' -> 150000.0."""
    return F.regexp_replace(_c(c), "[, km]", "").try_cast("double")


def parse_digits(c: Col, as_type: str = "double") -> Column:
    """Every digit of the text, joined and cast."""
    return F.regexp_replace(_c(c), "[^0-9]", "").try_cast(as_type)


def parse_hp(c: Col) -> Column:
    """'150 Ch' -> 150.0; text such as 'n.c.' -> null."""
    return F.trim(F.replace(_c(c), F.lit(" Ch"), F.lit(""))).try_cast("double")


def first_int(c: Col) -> Column:
    """First integer found in the text."""
    return F.regexp_extract(_c(c), "([0-9]+)", 1).try_cast("bigint")


def unit_suffixes(df: DataFrame, c: str, out: str = "unit") -> DataFrame:
    """Inventory of the unit texts that remain once digits are removed."""
    return df.select(F.trim(F.regexp_replace(F.col(c), "[0-9]+", "")).alias(out)).distinct()


def try_num(c: Col, as_type: str = "double") -> Column:
    """Tolerant numeric cast; integers go through double so '2020.0' survives."""
    number = _c(c).try_cast("double")
    return number if as_type == "double" else number.try_cast(as_type)


def normalize_text(c: Col) -> Column:
    """Lower, trim, plain letters for the mapped accents, then [a-z0-9] and blanks only."""
    trimmed = F.regexp_replace(_c(c), r"^\s+|\s+$", "")
    return F.regexp_replace(F.translate(F.lower(trimmed), ACCENTED, PLAIN), r"[^a-z0-9\s]", "")


def std_key(c: Col, replacements: Mapping[str, str] | None = None) -> Column:
    """Lower and trim, then literal replacements."""
    key = F.trim(F.lower(_c(c)))
    for old, new in (replacements or {}).items():
        key = F.replace(key, F.lit(old), F.lit(new))
    return key


def _literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def crosswalk(df: DataFrame, c: str, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace mapped values of `c`, keep the others.

    A small mapping is a literal; a frame with columns (old, new) is joined. Of several
    new values for one old value the smallest counts.
    """
    if not isinstance(mapping, DataFrame):
        return df.withColumn(c, F.coalesce(F.try_element_at(_literal_map(mapping), F.col(c)), F.col(c)))
    names = mapping.groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new"))
    return (
        df.join(names, F.col(c) == F.col("_old"), "left")
        .withColumn(c, F.coalesce("_new", c))
        .drop("_old", "_new")
    )


def rank_of(c: Col, mapping: Mapping[str, int]) -> Column:
    """Strict map of labels to ranks: an unknown label is an error."""
    label = _c(c)
    return F.coalesce(
        F.try_element_at(_literal_map(mapping), label),
        F.raise_error(F.concat(F.lit("unmapped label: "), F.coalesce(label, F.lit("null")))).cast("int"),
    )


def year_of_text(c: Col) -> Column:
    return F.substring(_c(c), 1, 4).try_cast("int")


def parse_date(c: Col) -> Column:
    """Date from the first ten characters (yyyy-mm-dd), null where it is none."""
    return F.try_to_date(F.substring(_c(c), 1, 10), "yyyy-MM-dd")


def parse_ts(c: Col) -> Column:
    return F.try_to_timestamp(_c(c))


def convert(c: Col, rate: float = XAF_TO_EUR) -> Column:
    return _c(c) * F.lit(rate)


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column where the source has none."""
    return df.withColumn(name, F.lit(value))


def keyword_flags(
    c: Col,
    keywords: Mapping[str, Iterable[str]] = FUEL_KEYWORDS,
    exclude: Mapping[str, str] | None = None,
) -> list[Column]:
    """One 0/1 flag per keyword list; `exclude` maps a flag to the one that overrules it."""
    exclude = {"is_traditional_fuel": "is_hybrid"} if exclude is None else exclude
    text = F.lower(_c(c))
    found = {
        name: reduce(lambda a, b: a | b, [F.coalesce(text.contains(w), F.lit(False)) for w in words])
        for name, words in keywords.items()
    }
    return [
        (hit & ~found[exclude[name]] if name in exclude else hit).cast("int").alias(name)
        for name, hit in found.items()
    ]


def safe_name(c: Col) -> Column:
    return F.regexp_replace(_c(c), "[^0-9a-zA-Z_]", "_")


def follow_prefix(c: Col, prefix: str, otherwise: Col) -> Column:
    """The value of `c` where it starts with `prefix`, else the other column."""
    return F.when(F.startswith(_c(c), F.lit(prefix)), _c(c)).otherwise(_c(otherwise))


def clip(c: Col, lo: float | None = None, hi: float | None = None) -> Column:
    out = _c(c)
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def fill_number(c: Col, value: float = 0.0) -> Column:
    """Null and NaN become `value`."""
    number = _c(c).cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(float(value)))


def nonfinite_profile(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Per column the number of NaN and of infinite values, from one aggregate."""
    cols = list(cols)
    one = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.isnan(F.col(c).cast("double"))).alias("n_nan"),
            F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("n_inf"),
        ).alias(c)
        for c in cols
    ])
    return one.select(F.inline(F.array(*[F.col(c) for c in cols])))


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Rounded copies for a report."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})

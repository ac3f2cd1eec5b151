"""Queries over parsing and feature expressions (inventory C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import features as fx, parse
from lotwise.operators import stats
from lotwise.operators.quantiles import quantile_table
from lotwise.plans.catalog import NOW, Tables, query, sql
from lotwise.sources.files import add_block

# Text columns built from the data by the same expression on both sides.
MONEY = """CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN '1.2.3'
  WHEN 2 THEN concat(CAST(floor(l_extendedprice) AS BIGINT), ' €') WHEN 3 THEN concat('25 000 ', l_returnflag)
  ELSE concat('EUR ', CAST(floor(l_extendedprice) AS BIGINT), '.50') END"""
KM = "CASE l_linenumber % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN concat(l_partkey, ',000 km') ELSE concat(l_partkey, 'km') END"
HP = "CASE l_linenumber % 3 WHEN 0 THEN 'n.c.' WHEN 1 THEN concat(l_suppkey, ' Ch') ELSE concat(' ', l_suppkey, ' Ch ') END"
MIXED = "CASE l_linenumber % 3 WHEN 0 THEN 'none' WHEN 1 THEN concat('a', l_partkey, 'b', l_suppkey) ELSE concat(l_suppkey, '.0') END"
DATE = """CASE l_linenumber % 3 WHEN 0 THEN 'soon' WHEN 1 THEN concat(substr(concat(l_shipdate, ''), 1, 10), 'T10:00')
  ELSE substr(concat(l_shipdate, ''), 1, 19) END"""
KEYS = "l_orderkey, l_linenumber, l_suppkey"
OUT = "l_orderkey l_linenumber l_suppkey"


def texts(t: Tables, expression: str):
    return t("lineitem").withColumn("x", F.expr(expression))


def keyed(df, *columns):
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", *columns)


def over(expression: str, select: str, plain: str = "", doubles: str = "") -> str:
    return sql(
        f"WITH s AS (SELECT *, {expression} AS x FROM lineitem) SELECT {KEYS}, {select} FROM s",
        f"{OUT} {plain}", doubles, listings=False)


@query("c1_parse_money", over(
    MONEY, "TRY_CAST(nullif(regexp_replace(x, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS value", "", "value"))
def _(t: Tables):
    return keyed(texts(t, MONEY), parse.parse_money("x").alias("value"))


@query("c2_currency", over(MONEY, r"coalesce(regexp_extract(x, '([^0-9]+)$', 1), '') AS suffix", "suffix"))
def _(t: Tables):
    return keyed(texts(t, MONEY), parse.currency("x").alias("suffix"))


@query("c3_parse_km", over(KM, "TRY_CAST(regexp_replace(x, '[, km]', '', 'g') AS DOUBLE) AS value", "", "value"))
def _(t: Tables):
    return keyed(texts(t, KM), parse.parse_km("x").alias("value"))


@query("c4_parse_digits", over(
    MIXED, "TRY_CAST(nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') AS BIGINT) AS value", "value"))
def _(t: Tables):
    return keyed(texts(t, MIXED), parse.parse_digits("x", "bigint").alias("value"))


@query("c5_parse_hp", over(HP, "TRY_CAST(trim(replace(x, ' Ch', '')) AS DOUBLE) AS value", "", "value"))
def _(t: Tables):
    return keyed(texts(t, HP), parse.parse_hp("x").alias("value"))


@query("c6_first_int", over(
    MIXED, "TRY_CAST(nullif(regexp_extract(x, '([0-9]+)', 1), '') AS BIGINT) AS value", "value"))
def _(t: Tables):
    return keyed(texts(t, MIXED), parse.first_int("x").alias("value"))


@query("c7_unit_suffixes", sql(
    f"SELECT DISTINCT trim(regexp_replace({HP}, '[0-9]+', '', 'g')) AS unit FROM lineitem", "unit", listings=False))
def _(t: Tables):
    return parse.unit_suffixes(texts(t, HP), "x")


@query("c8_try_num", over(
    MIXED, "TRY_CAST(trunc(TRY_CAST(x AS DOUBLE)) AS INT) AS whole, TRY_CAST(x AS DOUBLE) AS value", "whole", "value"))
def _(t: Tables):
    return keyed(texts(t, MIXED), parse.try_num("x", "int").alias("whole"), parse.try_num("x").alias("value"))


@query("c9_normalize_text", """
  SELECT doc_id, regexp_replace(translate(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')),
         'éèêëàâäùûüôöîïçñ', 'eeeeaaauuuooiicn'), '[^a-z0-9\\s]', '', 'g') AS plain FROM documents""")
def _(t: Tables):
    return t("documents").select("doc_id", parse.normalize_text("text").alias("plain"))


@query("c10_std_key", sql(
    "SELECT p_partkey, replace(trim(lower(' ' || p_brand || ' ')), 'brand#', 'brand-') AS k FROM part", "p_partkey k", listings=False))
def _(t: Tables):
    padded = t("part").withColumn("x", F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    return padded.select("p_partkey", parse.std_key("x", {"brand#": "brand-"}).alias("k"))


@query("c11_crosswalk", sql("""
  SELECT url, CASE brand WHEN 'Brand#1' THEN 'first' WHEN 'Brand#2' THEN 'second' ELSE brand END AS brand,
         coalesce((SELECT max(p_brand) FROM part WHERE p_type = l.model), model) AS model FROM l""", "url brand model"))
def _(t: Tables):
    names = t("part").groupBy(F.col("p_type").alias("old")).agg(F.max("p_brand").alias("new"))
    named = parse.crosswalk(t.listings, "brand", {"Brand#1": "first", "Brand#2": "second"})
    return parse.crosswalk(named, "model", names).select("url", "brand", "model")


@query("c12_rank_of", sql("SELECT url, CASE snapshot WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS rank FROM l", "url rank"))
def _(t: Tables):
    return t.listings.select("url", parse.rank_of("snapshot", {"F": 0, "O": 1}).alias("rank"))


@query("c13_year_of_text", over(DATE, "TRY_CAST(substr(x, 1, 4) AS INT) AS year", "year"))
def _(t: Tables):
    return keyed(texts(t, DATE), parse.year_of_text("x").alias("year"))


@query("c14_parse_date", over(
    DATE, """TRY_CAST(substr(x, 1, 10) AS DATE) AS day, CAST(year(TRY_CAST(substr(x, 1, 10) AS DATE)) AS INT) AS y,
    CAST(month(TRY_CAST(substr(x, 1, 10) AS DATE)) AS INT) AS m""", "day y m"))
def _(t: Tables):
    day = parse.parse_date("x")
    return keyed(texts(t, DATE), day.alias("day"), F.year(day).alias("y"), F.month(day).alias("m"))


@query("c15_parse_ts", over(
    DATE, "strftime(TRY_CAST(substr(x, 1, 19) AS TIMESTAMP), '%Y-%m-%d %H:%M') AS stamp", "stamp"))
def _(t: Tables):
    stamp = F.date_format(parse.parse_ts(F.substring("x", 1, 19)), "yyyy-MM-dd HH:mm")
    return keyed(texts(t, DATE), stamp.alias("stamp"))


@query("c16_convert", sql("SELECT url, price * 0.0015 AS eur FROM l", "url", "eur"))
def _(t: Tables):
    return t.listings.select("url", parse.convert("price").alias("eur"))


@query("c17_with_default", sql("SELECT url, 100000.0 AS km FROM l", "url", "km"))
def _(t: Tables):
    return parse.with_default(t.listings.select("url"), "km", 100000.0)


@query("c18_keyword_flags", sql("""
  SELECT url, energie, 0 AS is_ev, CAST(energie = 'Hybride essence' AS INT) AS is_hybrid, 0 AS is_alternative_fuel,
         CASE WHEN energie IN ('Diesel', 'Essence') THEN 1 ELSE 0 END AS is_traditional_fuel
  FROM (SELECT url, coalesce(energie, '') AS energie FROM l)""",
    "url energie is_ev is_hybrid is_alternative_fuel is_traditional_fuel"))
def _(t: Tables):
    return add_block(t.listings.select("url", "energie"), parse.keyword_flags("energie"))


@query("c19_safe_name", sql("SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name, '[^0-9a-zA-Z_]', '_', 'g') AS name FROM part",
    "p_partkey name", listings=False))
def _(t: Tables):
    return t("part").select("p_partkey", parse.safe_name(F.concat_ws(" ", "p_brand", "p_name")).alias("name"))


@query("c20_follow_prefix", sql(
    "SELECT url, CASE WHEN starts_with(brand, 'Brand#1') THEN brand ELSE model END AS model FROM l", "url model"))
def _(t: Tables):
    return t.listings.select("url", parse.follow_prefix("brand", "Brand#1", "model").alias("model"))


@query("c21_clip", sql("SELECT url, greatest(least(price, 60000), 5000) AS price FROM l", "url", "price"))
def _(t: Tables):
    return t.listings.select("url", parse.clip("price", 5000.0, 60000.0).alias("price"))


@query("c22_fill_number", sql("SELECT url, CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 0 ELSE price END AS price FROM l", "url", "price"))
def _(t: Tables):
    holes = F.when(F.col("flag") == "A", F.lit(float("nan"))).when(F.col("flag") == "R", F.col("price"))
    return t.listings.select("url", parse.fill_number(holes).alias("price"))


@query("c23_nonfinite_profile", sql("""
  SELECT 'price' AS "column", count(*) FILTER (flag = 'A') AS n_nan, count(*) FILTER (flag = 'N') AS n_inf FROM l
  UNION ALL SELECT 'km', 0, 0""", '"column" n_nan n_inf'))
def _(t: Tables):
    odd = (F.when(F.col("flag") == "A", F.lit(float("nan"))).when(F.col("flag") == "N", F.lit(float("-inf")))
           .otherwise(F.col("price")))
    return parse.nonfinite_profile(t.listings.withColumn("price", odd), ["price", "km"])


@query("c24_round_columns", sql("SELECT url, round(price / 7.3::DOUBLE, 1) AS price, round(km / 7000, 0) AS km FROM l", "url", "price km"))
def _(t: Tables):
    scaled = t.listings.select("url", (F.col("price") / 7.3).alias("price"), (F.col("km") / 7000).alias("km"))
    return parse.round_columns(scaled, {"price": 1, "km": 0})


@query("d1_car_age", sql("SELECT url, 2003 - year AS age FROM l", "url age"))
def _(t: Tables):
    return t.listings.select("url", fx.car_age("year", NOW).alias("age"))


@query("d2_decade", sql("SELECT url, CAST(floor(year / 10) * 10 AS INT) AS decade FROM l", "url decade"))
def _(t: Tables):
    return t.listings.select("url", fx.decade("year").alias("decade"))


def as_flags(df, names):
    return df.withColumns({n: F.col(n).cast("int") for n in names})


@query("d3_newness_flags", sql("""
  SELECT url, CAST(year >= 2000 AS INT) AS is_almost_new, CAST(2001 - year < 2 AS INT) AS is_new_car,
         CAST(2001 - year > 15 AS INT) AS is_old_car FROM l""", "url is_almost_new is_new_car is_old_car"))
def _(t: Tables):
    flags = fx.newness_flags("year", 2001)
    return as_flags(t.listings.select("url", *flags), ["is_almost_new", "is_new_car", "is_old_car"])


@query("d4_age_category", sql("""
  SELECT url, CASE WHEN year >= 2001 THEN 'new_0-2yr' WHEN year >= 1998 THEN 'recent_3-5yr'
    WHEN year >= 1993 THEN 'mid_age_6-10yr' WHEN year >= 1988 THEN 'older_11-15yr' ELSE 'very_old_16+yr' END AS category
  FROM l""", "url category"))
def _(t: Tables):
    return t.listings.select("url", fx.age_category("year", NOW).alias("category"))


BUCKET = """CASE WHEN car_age BETWEEN 0 AND 2 THEN '0-2' WHEN car_age BETWEEN 3 AND 5 THEN '3-5'
  WHEN car_age BETWEEN 6 AND 10 THEN '6-10' WHEN car_age BETWEEN 11 AND 15 THEN '11-15'
  WHEN car_age BETWEEN 16 AND 20 THEN '16-20' WHEN car_age BETWEEN 21 AND 200 THEN '21+' END"""


@query("d5_age_bucket", sql(f"""
  SELECT url, {BUCKET} AS bucket, CASE {BUCKET} WHEN '0-2' THEN 0 WHEN '3-5' THEN 1 WHEN '6-10' THEN 2 WHEN '11-15' THEN 3
    WHEN '16-20' THEN 4 WHEN '21+' THEN 5 END AS place FROM l""", "url bucket place"))
def _(t: Tables):
    label, order = fx.age_bucket("car_age")
    return t.aged.select("url", label.alias("bucket"), order.alias("place"))


@query("d6_km_per_year", sql("""
  SELECT url, CASE WHEN 1998 - year > 0 THEN km / (1998 - year) ELSE km END AS guard, km / (car_age + 1) AS plus_one FROM l""",
    "url", "guard plus_one"))
def _(t: Tables):
    return t.aged.select(
        "url", fx.km_per_year("km", fx.car_age("year", 1998)).alias("guard"),
        fx.km_per_year("km", "car_age", "plus_one").alias("plus_one"))


def with_km_cuts(df):
    return stats.with_scalars(df, quantile_table(df, [], {f"p{p}": ("km", p / 100) for p in (25, 50, 75, 90)}))


@query("d7_mileage_flags", sql("""
  SELECT url, CAST(km < 50000 AS INT) AS is_low_mileage, CAST(km > (SELECT quantile_cont(km, 0.75) FROM l) AS INT) AS is_high_mileage,
         CAST(km < 10000 AS INT) AS is_nearly_new_mileage FROM l""",
    "url is_low_mileage is_high_mileage is_nearly_new_mileage"))
def _(t: Tables):
    flagged = with_km_cuts(t.listings).select("url", *fx.mileage_flags("km", "p75"))
    return as_flags(flagged, ["is_low_mileage", "is_high_mileage", "is_nearly_new_mileage"])


@query("d8_mileage_category", sql("""
  WITH q AS (SELECT quantile_cont(km, 0.25) a, quantile_cont(km, 0.5) b, quantile_cont(km, 0.75) c, quantile_cont(km, 0.9) e FROM l)
  SELECT url, CASE WHEN km < a THEN 'very_low' WHEN km < b THEN 'low' WHEN km < c THEN 'medium' WHEN km < e THEN 'high'
    ELSE 'very_high' END AS category FROM l, q""", "url category"))
def _(t: Tables):
    return with_km_cuts(t.listings).select("url", fx.mileage_category("km", "p25", "p50", "p75", "p90").alias("category"))


@query("d9_log_features", sql(
    "SELECT url, ln(km + 1) AS log_km, ln(km / (car_age + 1) + 1) AS log_km_per_year FROM l", "url", "log_km log_km_per_year"))
def _(t: Tables):
    return t.aged.select("url", *fx.log_features("km", fx.km_per_year("km", "car_age", "plus_one")))


@query("d10_polynomials", sql("""
  SELECT url, km / 1000 AS mileage, pow(car_age, 2) AS age_squared, pow(car_age, 3) AS age_cubed,
         pow(km / 1000, 2) AS mileage_squared, pow(km / 1000, 3) AS mileage_cubed, sqrt(km / 1000) AS sqrt_km,
         sqrt(car_age) AS sqrt_age FROM l""",
    "url", "mileage age_squared age_cubed mileage_squared mileage_cubed sqrt_km sqrt_age"))
def _(t: Tables):
    return t.aged.select("url", *fx.polynomials("car_age", F.col("km") / 1000))


@query("d11_interactions", sql("""
  SELECT url, car_age * km AS age_mileage, car_age * car_age * km AS age_squared_mileage,
         car_age * km * km AS age_mileage_squared, car_age * km / 1000 AS age_km_interaction FROM l""",
    "url", "age_mileage age_squared_mileage age_mileage_squared age_km_interaction"))
def _(t: Tables):
    return t.aged.select("url", *fx.interactions("car_age", "km"))


@query("d12_usage_flags", sql("""
  SELECT url, CAST(car_age < 5 AND km < 50000 AS INT) AS is_low_use_recent, CAST(car_age < 3 AND km > 150000 AS INT) AS is_high_use_new,
         CAST(car_age > 15 AND km < 50000 AS INT) AS is_garage_queen FROM l""",
    "url is_low_use_recent is_high_use_new is_garage_queen"))
def _(t: Tables):
    flagged = t.aged.select("url", *fx.usage_flags("car_age", "km"))
    return as_flags(flagged, ["is_low_use_recent", "is_high_use_new", "is_garage_queen"])


@query("d13_hp_features", sql("""
  SELECT url, horsepower AS hp, horsepower * horsepower AS hp_squared, horsepower * horsepower * horsepower AS hp_cubed,
         sqrt(horsepower) AS sqrt_hp FROM l""", "url", "hp hp_squared hp_cubed sqrt_hp"))
def _(t: Tables):
    return fx.hp_features(t.listings).select("url", "hp", "hp_squared", "hp_cubed", "sqrt_hp")


@query("d14_market_share", sql("""
  WITH c AS (SELECT variant, count(*) AS variant_count FROM l GROUP BY variant)
  SELECT url, variant, variant_count, variant_count / (SELECT count(*) FROM l) AS variant_market_share,
         CAST(variant_count < 900 AS INT) AS is_rare_variant, CAST(variant_count > 1000 AS INT) AS is_common_variant
  FROM l JOIN c USING (variant)""",
    "url variant variant_count is_rare_variant is_common_variant", "variant_market_share"))
def _(t: Tables):
    return stats.market_share(t.listings.select("url", "variant"), "variant", 900, 1000)


@query("d15_relative_flags", sql("""
  WITH q AS (SELECT brand, quantile_cont(horsepower, 0.25) lo, quantile_cont(horsepower, 0.9) hi FROM l GROUP BY brand)
  SELECT url, brand, CAST(horsepower > hi AS INT) AS is_high_horsepower_within_brand,
         CAST(horsepower < lo AS INT) AS is_low_horsepower_within_brand FROM l JOIN q USING (brand)""",
    "url brand is_high_horsepower_within_brand is_low_horsepower_within_brand"))
def _(t: Tables):
    return stats.relative_flags(t.listings, "brand", "horsepower").select(
        "url", "brand", "is_high_horsepower_within_brand", "is_low_horsepower_within_brand")


@query("d16_premium_flags", sql("""
  SELECT url, CAST(energie = 'Hybride essence' AND starts_with(brand, 'Brand#2') AS INT) AS is_hybrid_premium FROM l""",
    "url is_hybrid_premium"))
def _(t: Tables):
    top = add_block(t.listings, parse.keyword_flags("energie")).withColumn(
        "top", F.startswith(F.col("brand"), F.lit("Brand#2")).cast("int"))
    return fx.premium_flags(top, ["is_hybrid"], "top").select("url", "is_hybrid_premium")


@query("d17_log_target", sql("""
  SELECT url, ln(price - 20000) AS log_price, price - 20000 AS back, ln(price + 1) AS log1p_price FROM l WHERE price > 20000""",
    "url", "log_price back log1p_price"))
def _(t: Tables):
    logged = fx.log_target(t.listings.withColumn("less", F.col("price") - 20000), "less")
    both = fx.log_target(logged, "price", "log1p", "log1p_price")
    return both.select("url", "log_price", fx.inverse("log_price").alias("back"), "log1p_price")


@query("d18_gaps", sql("""
  SELECT url, km - price AS delta, (km - price) / price * 100 AS pct, (price - km) / price * 100 AS gap FROM l""", "url", "delta pct gap"))
def _(t: Tables):
    return t.listings.select(
        "url", fx.delta("price", "km").alias("delta"), fx.pct_change("price", "km").alias("pct"),
        fx.gap_pct("price", "km").alias("gap"))

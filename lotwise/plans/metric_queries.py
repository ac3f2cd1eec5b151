"""Queries over metrics and declared-value validation (inventory M and N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.features import age_bucket
from lotwise.learning.evaluate import with_fold
from lotwise.operators import metrics as mt, rows, validate as va
from lotwise.operators.keys import join_on
from lotwise.operators.match import market_examples
from lotwise.operators.quantiles import quantile_table
from lotwise.plans.catalog import Tables, query, sql
from lotwise.plans.column_queries import BUCKET

SEGMENT = ["brand", "model", "year"]
EDGES, LABELS = (0, 10_000, 30_000, 60_000), ("low", "middle", "high", "top")

# Declared rows with market quantiles of their segment (q15, q50, q85) and of their brand (b15, b50, b85).
SCORED = """WITH c AS (SELECT brand, model, year, quantile_cont(price, 0.15) q15, median(price) q50, quantile_cont(price, 0.85) q85 FROM m GROUP BY 1, 2, 3),
  cb AS (SELECT brand, quantile_cont(price, 0.15) b15, median(price) b50, quantile_cont(price, 0.85) b85 FROM m GROUP BY 1),
  s AS (SELECT d.*, q15, q50, q85, b15, b50, b85 FROM d JOIN c USING (brand, model, year) JOIN cb USING (brand))"""
RANGE = "CASE WHEN price < 10000 THEN 'low' WHEN price < 30000 THEN 'middle' WHEN price < 60000 THEN 'high' ELSE 'top' END"
R2 = "1 - sum((price - q50) * (price - q50)) / (var_pop(price) * count(*))"
CORE = f"avg(abs(price - q50)) AS mae, sqrt(avg((price - q50) * (price - q50))) AS rmse, {R2} AS r2, avg(abs(price - q50) / price) * 100 AS mape"
APE = "abs(price - q50) / greatest(price, 1) * 100"


def scored(t: Tables):
    """The frame SCORED describes."""
    market = t.market
    segment = quantile_table(market, SEGMENT, {"q15": ("price", 0.15), "q50": ("price", 0.5), "q85": ("price", 0.85)})
    brand = quantile_table(market, ["brand"], {"b15": ("price", 0.15), "b50": ("price", 0.5), "b85": ("price", 0.85)})
    declared = t.declared.withColumn("car_age", F.lit(2003) - F.col("year"))
    return join_on(join_on(declared, segment, SEGMENT), brand, ["brand"])


@query("m1_regression_metrics", sql(f"{SCORED} SELECT brand, count(*) AS n, {CORE} FROM s GROUP BY 1", "brand n", "mae rmse r2 mape"))
def _(t: Tables):
    return mt.regression_metrics(scored(t), "price", "q50", ["brand"])


@query("m2_median_errors", sql(
    f"{SCORED} SELECT brand, median(abs(price - q50)) AS medae, median({APE}) AS median_ape FROM s GROUP BY 1", "brand", "medae median_ape"))
def _(t: Tables):
    return mt.median_errors(scored(t), "price", "q50", ["brand"])


@query("m3_adjusted_r2", sql(f"""
  {SCORED} SELECT n, mae, rmse, r2, mape, 1 - (1 - r2) * (n - 1) / (n - 31 - 1) AS adjusted_r2
  FROM (SELECT count(*) AS n, {CORE} FROM s)""", "n", "mae rmse r2 mape adjusted_r2"))
def _(t: Tables):
    return mt.adjusted_r2(mt.regression_metrics(scored(t), "price", "q50"), 31)


@query("m4_pinball", sql(f"""
  {SCORED} SELECT brand, avg(CASE WHEN ln(price) >= ln(q85) THEN 0.85 * (ln(price) - ln(q85)) ELSE -0.15 * (ln(price) - ln(q85)) END) AS pinball
  FROM s GROUP BY 1""", "brand", "pinball"))
def _(t: Tables):
    return mt.pinball(scored(t), "price", "q85", 0.85, ["brand"])


@query("m5_coverage", sql(f"""
  {SCORED} SELECT brand, count(*) AS n, avg((price BETWEEN q15 AND q85)::INT) * 100 AS coverage_pct, avg((price < q15)::INT) * 100 AS below_pct,
    avg((price > q85)::INT) * 100 AS above_pct FROM s GROUP BY 1""", "brand n", "coverage_pct below_pct above_pct"))
def _(t: Tables):
    return mt.coverage(scored(t), "price", "q15", "q85", ["brand"])


@query("m6_interval_width", sql(f"""
  {SCORED} SELECT brand, avg(q85 - q15) AS mean_width, median(q85 - q15) AS median_width, stddev_samp(q85 - q15) AS std_width,
    min(q85 - q15) AS min_width, max(q85 - q15) AS max_width, avg((q85 - q15) / greatest(price, 1) * 100) AS mean_relative_width
  FROM s GROUP BY 1""", "brand", "mean_width median_width std_width min_width max_width mean_relative_width"))
def _(t: Tables):
    return mt.interval_width(scored(t), "q15", "q85", "price", ["brand"])


@query("m7_crossings", sql(f"""
  {SCORED} SELECT count(*) AS n, count(*) FILTER (q15 > declared_price OR declared_price > q85) AS n_crossings,
    count(*) FILTER (q15 > q85) AS n_negative_width, avg((q15 > declared_price OR declared_price > q85)::INT) * 100 AS crossing_pct FROM s""",
    "n n_crossings n_negative_width", "crossing_pct"))
def _(t: Tables):
    return mt.crossings(scored(t), ["q15", "declared_price", "q85"])[0]


@query("m7_crossing_rows", sql(f"""
  {SCORED} SELECT url, CASE WHEN q15 > declared_price AND declared_price > q85 THEN 'both' WHEN q15 > declared_price THEN 'q15 > declared_price'
    ELSE 'declared_price > q85' END AS issue FROM s WHERE q15 > declared_price OR declared_price > q85""", "url issue"))
def _(t: Tables):
    return mt.crossings(scored(t), ["q15", "declared_price", "q85"])[1].select("url", "issue")


@query("m8_calibration", sql(f"""
  {SCORED}, x AS (SELECT 0.15 AS alpha, avg((price <= q15)::INT) AS share_below FROM s UNION ALL SELECT 0.5, avg((price <= q50)::INT) FROM s
    UNION ALL SELECT 0.85, avg((price <= q85)::INT) FROM s)
  SELECT alpha, share_below, abs(share_below - alpha) AS abs_error FROM x""", "", "alpha share_below abs_error"))
def _(t: Tables):
    return mt.calibration(scored(t), "price", {0.15: "q15", 0.5: "q50", 0.85: "q85"})


@query("m9_accuracy_bands", sql(f"""
  {SCORED} SELECT band, avg((abs(q50 - price) / price * 100 <= band)::INT) * 100 AS within_pct
  FROM s, (SELECT unnest([5, 10, 15, 20, 25])::DOUBLE AS band) GROUP BY 1""", "", "band within_pct"))
def _(t: Tables):
    return mt.accuracy_bands(scored(t), "price", "q50")


@query("m10_metrics_by", sql(
    f"{SCORED} SELECT variant, count(*) AS n, {CORE} FROM s GROUP BY 1 HAVING count(*) >= 310", "variant n", "mae rmse r2 mape"))
def _(t: Tables):
    return mt.metrics_by(scored(t), "variant", "price", "q50", 310)


PROFILE = f"""count(*) AS n, median(price) AS median_price, median({APE}) AS median_ape, avg(abs(price - q50)) AS mae, avg({APE}) AS mape,
  median((q50 - price) / greatest(price, 1) * 100) AS median_signed_pct, avg((price BETWEEN q15 AND q85)::INT) AS coverage"""
PROFILE_COLUMNS = "median_price median_ape mae mape median_signed_pct coverage"


@query("m11_year_metrics", sql(f"{SCORED} SELECT year, {PROFILE} FROM s GROUP BY 1", "year n", PROFILE_COLUMNS))
def _(t: Tables):
    return mt.year_metrics(scored(t), "price", "q15", "q50", "q85")


@query("m12_bucket_metrics", sql(f"""
  {SCORED} SELECT {BUCKET} AS age_bucket, CASE {BUCKET} WHEN '0-2' THEN 0 WHEN '3-5' THEN 1 ELSE 2 END AS bucket_order, {PROFILE}
  FROM s GROUP BY 1, 2""", "age_bucket bucket_order n", PROFILE_COLUMNS))
def _(t: Tables):
    return mt.bucket_metrics(scored(t), "price", "q15", "q50", "q85")


@query("m13_error_over_median", sql(f"""
  {SCORED}, g AS (SELECT brand, median(price) AS group_median FROM s GROUP BY 1)
  SELECT brand, count(*) AS n, group_median, avg(abs(price - q50) / group_median * 100) AS pct_error_over_median
  FROM s JOIN g USING (brand) GROUP BY 1, 3""", "brand n", "group_median pct_error_over_median"))
def _(t: Tables):
    return mt.error_over_median(scored(t), "brand", "price", "q50")


@query("m14_mae_by", sql(f"{SCORED} SELECT model, count(*) AS n, avg(abs(price - q50)) AS mae FROM s GROUP BY 1", "model n", "mae"))
def _(t: Tables):
    return mt.mae_by(scored(t), "model", "price", "q50")


@query("m15_metrics_by_range", sql(f"""
  {SCORED} SELECT {RANGE} AS range, count(*) AS n, avg(abs(price - q50)) AS mae, sqrt(avg((price - q50) * (price - q50))) AS rmse,
    avg({APE}) AS mape_floor1, avg((price BETWEEN q15 AND q85)::INT) * 100 AS coverage_pct, avg(q85 - q15) AS mean_width,
    count(*) FILTER (q15 > q50 OR q50 > q85) AS n_crossings FROM s GROUP BY 1""",
    "range n n_crossings", "mae rmse mape_floor1 coverage_pct mean_width"))
def _(t: Tables):
    return mt.metrics_by_range(scored(t), "price", "q50", "q15", "q85", EDGES, LABELS)


@query("m16_compare_models", sql(f"""
  {SCORED}, x AS (SELECT brand, count(*) AS n, avg(abs(price - b50)) AS mae_a, avg(abs(price - q50)) AS mae_b,
    sqrt(avg((price - b50) * (price - b50))) AS rmse_a, sqrt(avg((price - q50) * (price - q50))) AS rmse_b,
    count(*) FILTER (q85 - q15 < b85 - b15) AS n_narrower, count(*) FILTER (q85 - q15 > b85 - b15) AS n_wider,
    count(*) FILTER (q85 - q15 = b85 - b15) AS n_same, avg(b85 - b15) AS width_a, avg(q85 - q15) AS width_b FROM s GROUP BY 1)
  SELECT *, (mae_a - mae_b) / mae_a * 100 AS mae_improvement_pct, (width_a - width_b) / width_a * 100 AS width_reduction_pct FROM x""",
    "brand n n_narrower n_wider n_same", "mae_a mae_b rmse_a rmse_b width_a width_b mae_improvement_pct width_reduction_pct"))
def _(t: Tables):
    return mt.compare_models(scored(t), "price", ["b15", "b50", "b85"], ["q15", "q50", "q85"], ["brand"])


@query("m17_train_test_delta", sql(f"""
  {SCORED}, g AS (SELECT snapshot, model AS model_name, avg(abs(price - q50)) AS mae, sqrt(avg((price - q50) * (price - q50))) AS rmse FROM s GROUP BY 1, 2)
  SELECT model_name, 'train' AS dataset, mae, rmse FROM g WHERE snapshot = 'F'
  UNION ALL SELECT model_name, 'test', mae, rmse FROM g WHERE snapshot = 'O'
  UNION ALL SELECT a.model_name, 'test-train', b.mae - a.mae, b.rmse - a.rmse FROM g a JOIN g b USING (model_name)
  WHERE a.snapshot = 'F' AND b.snapshot = 'O'""", "model_name dataset", "mae rmse"))
def _(t: Tables):
    per = [
        mt.regression_metrics(scored(t).where(F.col("snapshot") == s), "price", "q50", ["model"])
        .select(F.col("model").alias("model_name"), "mae", "rmse") for s in ("F", "O")
    ]
    return mt.train_test_delta(*per)


@query("m18_trimmed_residuals", sql(f"""
  {SCORED}, r AS (SELECT 'q50' AS model_name, price - q50 AS residual FROM s UNION ALL SELECT 'q85', price - q85 FROM s),
  z AS (SELECT model_name, quantile_cont(residual, 0.025) lo, quantile_cont(residual, 0.975) hi FROM r GROUP BY 1)
  SELECT model_name, count(*) AS n, 0 AS n_null, avg(residual) AS mean, stddev_samp(residual) AS std, min(residual) AS min,
    quantile_cont(residual, 0.25) AS p25, median(residual) AS p50, quantile_cont(residual, 0.75) AS p75, max(residual) AS max
  FROM r JOIN z USING (model_name) WHERE residual BETWEEN lo AND hi GROUP BY 1""", "model_name n n_null", "mean std min p25 p50 p75 max"))
def _(t: Tables):
    return mt.trimmed_residuals(scored(t), "price", {"q50": "q50", "q85": "q85"})


FOLD = "CAST(('0x' || substr(md5(concat_ws('|', '42', url)), 1, 8)) AS BIGINT) % 5"


@query("m19_fold_stability", sql(f"""
  {SCORED}, g AS (SELECT {FOLD} AS fold, {BUCKET} AS age_bucket, avg((price BETWEEN q15 AND q85)::INT) * 100 AS coverage_pct FROM s GROUP BY 1, 2)
  SELECT age_bucket, count(*) AS n, avg(coverage_pct) AS coverage_pct_mean, stddev_samp(coverage_pct) AS coverage_pct_std FROM g GROUP BY 1""",
    "age_bucket n", "coverage_pct_mean coverage_pct_std"))
def _(t: Tables):
    folded = with_fold(scored(t), ["url"], 5, 42).withColumn("age_bucket", age_bucket("car_age")[0])
    return mt.fold_stability(mt.coverage(folded, "price", "q15", "q85", ["fold", "age_bucket"]), ["age_bucket"], ["coverage_pct"])


def table_line(variant: str, alpha: float, column: str) -> str:
    return f"""SELECT '{variant}' AS variant, {alpha} AS alpha, count(*) AS n, median(abs(price - {column}) / greatest(price, 1) * 100) AS median_ape,
      avg(abs(price - {column})) AS mae, sqrt(avg((price - {column}) * (price - {column}))) AS rmse,
      1 - sum((price - {column}) * (price - {column})) / (var_pop(price) * count(*)) AS r2,
      avg(CASE WHEN ln(price) >= ln({column}) THEN {alpha} * (ln(price) - ln({column})) ELSE ({alpha} - 1) * (ln(price) - ln({column})) END) AS pinball FROM s"""


@query("m20_quantile_metric_table", sql(
    f"{SCORED} " + " UNION ALL ".join(
        table_line(v, a, f"{p}{round(a * 100)}") for v, p in (("brand", "b"), ("segment", "q")) for a in (0.15, 0.5, 0.85)),
    "variant n", "alpha median_ape mae rmse r2 pinball"))
def _(t: Tables):
    return mt.quantile_metric_table(scored(t), "price", {
        "brand": {0.15: "b15", 0.5: "b50", 0.85: "b85"}, "segment": {0.15: "q15", 0.5: "q50", 0.85: "q85"}})


# Declared rows with segment predictions and market quantiles within one year.
VALID = f"""{SCORED},
  k AS (SELECT DISTINCT brand, model, year FROM d),
  j AS (SELECT k.brand, k.model, k.year, count(m.price) AS training_sample_size, quantile_cont(m.price, 0.1) train_p10,
    quantile_cont(m.price, 0.15) train_q15, median(m.price) train_q50, quantile_cont(m.price, 0.85) train_q85, quantile_cont(m.price, 0.9) train_p90,
    min(m.price) AS train_min, max(m.price) AS train_max
    FROM k LEFT JOIN m ON m.brand = k.brand AND m.model = k.model AND m.year BETWEEN k.year - 1 AND k.year + 1 GROUP BY 1, 2, 3),
  v AS (SELECT *, (q50 - declared_price) / q50 * 100 AS gap_pct, CASE WHEN declared_price BETWEEN q15 AND q85 THEN 'GREEN'
    WHEN training_sample_size > 0 AND declared_price BETWEEN train_p10 AND train_p90 THEN 'ORANGE' ELSE 'RED' END AS color_tier
    FROM s JOIN j USING (brand, model, year))"""


def predicted(t: Tables):
    return scored(t).withColumnsRenamed({"q15": "pred_q15", "q50": "pred_q50", "q85": "pred_q85"})


def tiered(t: Tables):
    return va.assign_tier(va.market_reference(predicted(t), t.market, 1))


@query("n1_normalize_declarations", sql("""
  SELECT 'CM' AS country, CASE lower(brand) WHEN 'brand#1' THEN 'first' ELSE lower(brand) END AS brand,
    CASE lower(model) WHEN 'promo' THEN 'special' ELSE lower(model) END AS model, year, price * 655.957 * 0.0015 AS actual_price_eur,
    100000.0 AS km, url FROM d""", "country brand model year url", "actual_price_eur km"))
def _(t: Tables):
    source = t.declared.select(
        "url", F.concat(F.lit(" "), "brand").alias("MARQUE"), F.upper("model").alias("MODELE"),
        F.col("index_date").cast("string").alias("FIRST"), (F.col("price") * 655.957).alias("VALUE"))
    return va.normalize_declarations(
        source, "CM", "MARQUE", "MODELE", "FIRST", "VALUE", {"brand#1": "first"}, {"promo": "special"}, keep=["url"])


KNOWN = "(SELECT * FROM m WHERE brand <> 'Brand#7' AND variant <> 'red ring')"


@query("n2_known_only", sql(f"""
  SELECT url, brand, variant FROM d WHERE brand IN (SELECT brand FROM {KNOWN}) AND variant IN (SELECT variant FROM {KNOWN})""", "url brand variant"))
def _(t: Tables):
    vocab = t.market.where("brand <> 'Brand#7' and variant <> 'red ring'")
    return rows.known_only(t.declared, vocab, ["brand", "variant"])[0].select("url", "brand", "variant")


@query("n2_unseen_report", sql(f"""
  SELECT 'brand' AS "column", brand AS value, count(*) AS n_rows FROM d WHERE brand NOT IN (SELECT brand FROM {KNOWN}) GROUP BY 2
  UNION ALL SELECT 'variant', variant, count(*) FROM d WHERE brand IN (SELECT brand FROM {KNOWN})
    AND variant NOT IN (SELECT variant FROM {KNOWN}) GROUP BY 2""", '"column" value n_rows'))
def _(t: Tables):
    vocab = t.market.where("brand <> 'Brand#7' and variant <> 'red ring'")
    return rows.known_only(t.declared, vocab, ["brand", "variant"])[1]


@query("n3_market_reference", sql(
    f"{VALID} SELECT url, training_sample_size, train_p10, train_q15, train_q50, train_q85, train_p90 FROM v",
    "url training_sample_size", "train_p10 train_q15 train_q50 train_q85 train_p90"))
def _(t: Tables):
    out = va.market_reference(predicted(t), t.market, 1)
    return out.select("url", "training_sample_size", *va.MARKET_QUANTILES)


@query("n4_assign_tier", sql(f"{VALID} SELECT url, color_tier, gap_pct FROM v", "url color_tier", "gap_pct"))
def _(t: Tables):
    return tiered(t).select("url", "color_tier", "gap_pct")


@query("n4_assign_tier_min_max", sql(f"""
  {VALID} SELECT url, CASE WHEN declared_price BETWEEN q15 AND q85 THEN 'GREEN'
    WHEN training_sample_size > 0 AND declared_price BETWEEN train_min AND train_max THEN 'ORANGE' ELSE 'RED' END AS color_tier FROM v""",
    "url color_tier"))
def _(t: Tables):
    ranged = va.market_range(predicted(t), t.market, 1)
    return va.assign_tier(ranged, range="min_max").select("url", "color_tier")


@query("n5_validate", sql(f"""
  {VALID}, g AS (SELECT brand, model, year, count(*) AS second_n, quantile_cont(price, 0.1) second_p10, median(price) second_p50,
    quantile_cont(price, 0.9) second_p90 FROM m2 GROUP BY 1, 2, 3)
  SELECT url, color_tier, training_sample_size, coalesce(second_n, 0) AS second_n, gap_pct, second_p10, second_p50, second_p90
  FROM v LEFT JOIN g USING (brand, model, year)""", "url color_tier training_sample_size second_n", "gap_pct second_p10 second_p50 second_p90"))
def _(t: Tables):
    out = va.validate(predicted(t), t.market, t.second_market, 1)
    return out.select("url", "color_tier", "training_sample_size", "second_n", "gap_pct", "second_p10", "second_p50", "second_p90")


@query("n6_second_market_coverage", sql("""
  WITH k AS (SELECT DISTINCT brand, variant, year FROM d)
  SELECT count(*) AS n_combinations, count(*) FILTER ((brand, variant, year) IN (SELECT brand, variant, year FROM m2)) AS n_matched,
    avg(((brand, variant, year) IN (SELECT brand, variant, year FROM m2))::INT) * 100 AS matched_pct FROM k""",
    "n_combinations n_matched", "matched_pct"))
def _(t: Tables):
    return va.second_market_coverage(t.declared, t.second_market, ["brand", "variant", "year"])


@query("n7_match_support", sql("""
  WITH k AS (SELECT DISTINCT brand, variant, year FROM d),
  j AS (SELECT k.brand, k.variant, k.year, count(m.price) AS c FROM k LEFT JOIN m ON m.brand = k.brand AND m.variant = k.variant
    AND m.year BETWEEN k.year - 1 AND k.year + 1 GROUP BY 1, 2, 3),
  x AS (SELECT CASE WHEN c < 1 THEN '0' WHEN c < 10 THEN '1-9' WHEN c < 50 THEN '10-49' WHEN c < 100 THEN '50-99'
    WHEN c < 500 THEN '100-499' WHEN c < 1000 THEN '500-999' ELSE '1000+' END AS support FROM d JOIN j USING (brand, variant, year))
  SELECT support, CASE support WHEN '0' THEN 1 WHEN '1-9' THEN 2 WHEN '10-49' THEN 3 WHEN '50-99' THEN 4 WHEN '100-499' THEN 5
    WHEN '500-999' THEN 6 ELSE 7 END AS support_order, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM x) AS pct FROM x GROUP BY 1""",
    "support support_order n", "pct"))
def _(t: Tables):
    return va.match_support(t.declared, t.market, 1, ["brand", "variant"])


CATEGORY = f"""{SCORED}, x AS (SELECT *, CASE WHEN declared_price < q15 THEN 'below_q15' WHEN declared_price > q85 THEN 'above_q85'
    ELSE 'within_interval' END AS coverage_category, abs(declared_price - q50) AS absolute_deviation,
  abs(declared_price - q50) / q50 * 100 AS percentage_deviation, (q15 - declared_price) / q15 * 100 AS below_q15_pct,
  (declared_price - q85) / q85 * 100 AS above_q85_pct FROM s)"""


def categorised(t: Tables):
    return va.coverage_category(scored(t), "declared_price", "q15", "q50", "q85")


@query("n8_coverage_category", sql(
    f"{CATEGORY} SELECT url, coverage_category, absolute_deviation, percentage_deviation, below_q15_pct, above_q85_pct FROM x",
    "url coverage_category", "absolute_deviation percentage_deviation below_q15_pct above_q85_pct"))
def _(t: Tables):
    return categorised(t).select(
        "url", "coverage_category", "absolute_deviation", "percentage_deviation", "below_q15_pct", "above_q85_pct")


@query("n9_deviation_summary", sql(f"""
  {CATEGORY} SELECT count(*) AS n, avg(absolute_deviation) AS mean_abs, avg(percentage_deviation) AS mean_pct,
    count(*) FILTER (percentage_deviation > 30) AS n_high, count(*) FILTER (coverage_category = 'below_q15') AS n_below_q15,
    count(*) FILTER (coverage_category = 'within_interval') AS n_within_interval, count(*) FILTER (coverage_category = 'above_q85') AS n_above_q85,
    median(absolute_deviation) AS median_abs, quantile_cont(absolute_deviation, 0.9) AS p90_abs,
    median(percentage_deviation) AS median_pct, quantile_cont(percentage_deviation, 0.9) AS p90_pct FROM x""",
    "n n_high n_below_q15 n_within_interval n_above_q85", "mean_abs mean_pct median_abs p90_abs median_pct p90_pct"))
def _(t: Tables):
    return va.deviation_summary(categorised(t))


@query("n10_coverage_by_top", sql(f"""
  {CATEGORY}, top AS (SELECT brand FROM x GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 10)
  SELECT brand, count(*) FILTER (coverage_category = 'below_q15') AS below_q15, count(*) FILTER (coverage_category = 'within_interval') AS within_interval,
    count(*) FILTER (coverage_category = 'above_q85') AS above_q85 FROM x WHERE brand IN (FROM top) GROUP BY 1""",
    "brand below_q15 within_interval above_q85"))
def _(t: Tables):
    return va.coverage_by_top(categorised(t), "brand", 10)


@query("n11_high_risk", sql(f"""
  {CATEGORY} SELECT url, brand, coverage_category, greatest(below_q15_pct, above_q85_pct) AS excess_pct FROM x
  WHERE below_q15_pct > 20 OR above_q85_pct > 20""", "url brand coverage_category", "excess_pct"))
def _(t: Tables):
    return va.high_risk(categorised(t), 20, ["url"]).select("url", "brand", "coverage_category", "excess_pct")


SELLERS = """, sn AS (SELECT s.*, n_name AS country FROM s JOIN supplier ON seller = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def by_country(t: Tables, df):
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return df.join(places.select(F.col("s_suppkey").alias("seller"), F.col("n_name").alias("country")), "seller")


@query("n12_coverage_by_country", sql(f"""
  {SCORED}{SELLERS} SELECT country, count(*) AS n, count(*) FILTER (declared_price BETWEEN q15 AND q85) AS n_inside,
    count(*) FILTER (declared_price < q15) AS n_below, count(*) FILTER (declared_price > q85) AS n_above,
    avg((declared_price BETWEEN q15 AND q85)::INT) * 100 AS coverage_pct FROM sn GROUP BY 1""",
    "country n n_inside n_below n_above", "coverage_pct"))
def _(t: Tables):
    return va.coverage_by(by_country(t, scored(t)), "country", "declared_price", "q15", "q85")


SIDE = ("mae", "rmse", "r2", "mape", "coverage_pct", "mean_width")


@query("n13_metrics_side_by_side", sql(f"""
  {SCORED}, g AS (SELECT snapshot, {CORE}, avg((price BETWEEN q15 AND q85)::INT) * 100 AS coverage_pct, avg(q85 - q15) AS mean_width
    FROM s GROUP BY 1)
  """ + " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, max({m}) FILTER (snapshot = 'F') AS "F", max({m}) FILTER (snapshot = 'O') AS "O" FROM g""" for m in SIDE),
    "metric", '"F" "O"'))
def _(t: Tables):
    return va.metrics_side_by_side(scored(t), "snapshot", ["F", "O"], "price", "q15", "q50", "q85")


@query("n14_undervaluation_stats", sql(f"""
  {SCORED}, x AS (SELECT 'q50' AS reference, q50 - declared_price AS e, (q50 - declared_price) / q50 * 100 AS p FROM s
    UNION ALL SELECT 'q15', q15 - declared_price, (q15 - declared_price) / q15 * 100 FROM s)
  SELECT reference, avg(e) AS mean_eur, stddev_samp(e) AS std_eur, min(e) AS min_eur, max(e) AS max_eur, avg(p) AS mean_pct,
    median(e) AS median_eur, median(p) AS median_pct FROM x GROUP BY 1""",
    "reference", "mean_eur std_eur min_eur max_eur mean_pct median_eur median_pct"))
def _(t: Tables):
    return va.undervaluation_stats(predicted(t))


@query("n15_severity_zones", sql(f"""
  {SCORED}, x AS (SELECT CASE WHEN declared_price < q15 THEN 'below_q15' WHEN declared_price < q50 THEN 'q15_q50'
    WHEN declared_price <= q85 THEN 'q50_q85' ELSE 'above_q85' END AS zone FROM s)
  SELECT zone, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM x) AS pct FROM x GROUP BY 1""", "zone n", "pct"))
def _(t: Tables):
    return va.severity_zones(predicted(t))


@query("n16_gap_by_year", sql(f"""
  {VALID} SELECT year, count(*) AS n, avg(gap_pct) AS mean_gap_pct, median(gap_pct) AS median_gap_pct, median(declared_price) AS median_declared,
    median(q50) AS median_predicted FROM v GROUP BY 1""", "year n", "mean_gap_pct median_gap_pct median_declared median_predicted"))
def _(t: Tables):
    return va.gap_by_year(tiered(t))


@query("n17_tier_counts", sql(f"""
  {VALID} SELECT CASE WHEN brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'group A' WHEN brand IN ('Brand#4', 'Brand#5') THEN 'group B'
    ELSE brand END AS brand, count(*) AS n, count(*) FILTER (color_tier = 'GREEN') AS green, count(*) FILTER (color_tier = 'ORANGE') AS orange,
    count(*) FILTER (color_tier = 'RED') AS red, median(declared_price) AS median_declared FROM v GROUP BY 1""",
    "brand n green orange red", "median_declared"))
def _(t: Tables):
    groups = {f"Brand#{i}": "group A" for i in (1, 2, 3)} | {f"Brand#{i}": "group B" for i in (4, 5)}
    return va.tier_counts(tiered(t), "brand", groups)


EXAMPLE = """SELECT brand, variant, year, price, km, horsepower, '{kind}' AS example_type FROM (
    SELECT *, row_number() OVER (PARTITION BY brand, variant, year ORDER BY {order}, brand, variant, year, price, km, horsepower) rn FROM m) WHERE rn = 1"""


@query("n18_market_examples", sql(f"""
  WITH k AS (SELECT DISTINCT brand, variant, year AS target_band FROM d),
  e AS ({EXAMPLE.format(kind='lowest_price', order='price')} UNION ALL {EXAMPLE.format(kind='lowest_hp', order='horsepower')}
    UNION ALL {EXAMPLE.format(kind='highest_km', order='km DESC')}),
  f AS (SELECT e.*, target_band, e.year - target_band AS band_offset FROM k JOIN e ON k.brand = e.brand AND k.variant = e.variant
    AND e.year - target_band IN (-1, 0, 1)),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, variant, year, price, km ORDER BY example_type, target_band, band_offset) rn
    FROM f) WHERE rn = 1),
  c AS (SELECT brand, variant, year, count(*) AS count_at_band FROM m GROUP BY 1, 2, 3),
  a AS (SELECT brand, variant, count(*) AS count_all_bands FROM m GROUP BY 1, 2)
  SELECT brand, variant, year, example_type, target_band, band_offset, count_at_band, count_all_bands, price, km, horsepower
  FROM u JOIN c USING (brand, variant, year) JOIN a USING (brand, variant)""",
    "brand variant year example_type target_band band_offset count_at_band count_all_bands", "price km horsepower"))
def _(t: Tables):
    return market_examples(t.declared, t.market, eq=["brand", "variant"])


@query("n19_price_stats", sql(f"""
  {SCORED}{SELLERS} SELECT country, count(*) AS n, avg(declared_price) AS mean, stddev_samp(declared_price) AS std, min(declared_price) AS min,
    quantile_cont(declared_price, 0.25) AS p25, median(declared_price) AS p50, quantile_cont(declared_price, 0.75) AS p75,
    max(declared_price) AS max FROM sn GROUP BY 1""", "country n", "mean std min p25 p50 p75 max"))
def _(t: Tables):
    return va.price_stats(by_country(t, scored(t)), "country", "declared_price")

"""Queries over aggregates, windows, joins, sorts and sets (inventory E to I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.features import age_bucket
from lotwise.operators import match, rows, stats, windows
from lotwise.operators.quantiles import group_quantiles, pooled_quantiles, quantile_table, quantiles
from lotwise.plans.catalog import Tables, query, sql
from lotwise.plans.column_queries import BUCKET
from lotwise.sources.files import union_all

BINS = (0, 10_000, 30_000, 60_000)
BIN_LABELS = ("low", "middle", "high", "top")
BIN_SQL = """CASE WHEN price < 0 THEN NULL WHEN price < 10000 THEN 'low' WHEN price < 30000 THEN 'middle'
  WHEN price < 60000 THEN 'high' ELSE 'top' END"""


@query("e1_count_by", sql("SELECT brand, model, count(*) AS n FROM l GROUP BY 1, 2", "brand model n"))
def _(t: Tables):
    return stats.count_by(t.listings, ["brand", "model"])


@query("e2_distinct_profile", sql("""
  SELECT 'url' AS "column", count(*) AS n_rows, count(DISTINCT url) AS n_unique, count(*) - count(DISTINCT url) AS n_duplicate FROM l
  UNION ALL SELECT 'brand', count(*), count(DISTINCT brand), count(*) - count(DISTINCT brand) FROM l""",
    '"column" n_rows n_unique n_duplicate'))
def _(t: Tables):
    return stats.distinct_profile(t.listings, ["url", "brand"])


@query("e2_distinct_profile_approximate")
def _(t: Tables):
    return stats.distinct_profile(t.listings, ["url", "brand"], approximate=True)


@query("e2_approximate_is_close", sql("SELECT count(*) AS n_rows, TRUE AS close FROM l", "n_rows close"))
def _(t: Tables):
    """The approximate number of distinct urls is within four standard errors (5 % each) of the exact one."""
    exact, rough = F.countDistinct("url"), F.approx_count_distinct("url")
    return t.listings.agg(F.count("*").alias("n_rows"), (F.abs(rough - exact) <= exact * 0.2).alias("close"))


@query("e3_group_stats", sql("""
  SELECT brand, count(*) AS n, avg(price) AS mean, median(price) AS median, stddev_samp(price) AS std, min(price) AS min,
         max(price) AS max FROM l GROUP BY brand""", "brand n", "mean median std min max"))
def _(t: Tables):
    return stats.group_stats(t.listings, ["brand"], "price")


@query("e4_describe", sql("""
  SELECT 'price' AS "column", count(price) AS n, CAST(0 AS BIGINT) AS n_null, avg(price) AS mean, stddev_samp(price) AS std, min(price) AS min,
         quantile_cont(price, 0.25) AS p25, median(price) AS p50, quantile_cont(price, 0.75) AS p75, max(price) AS max FROM l
  UNION ALL SELECT 'km', count(km), 0, avg(km), stddev_samp(km), min(km), quantile_cont(km, 0.25), median(km),
         quantile_cont(km, 0.75), max(km) FROM l""",
    '"column" n n_null', "mean std min p25 p50 p75 max"))
def _(t: Tables):
    return stats.describe(t.listings, ["price", "km"])


@query("e5_quantiles", sql("""
  SELECT unnest([0.1, 0.25, 0.5, 0.9, 0.99])::DOUBLE AS q,
         unnest(quantile_cont(price, [0.1, 0.25, 0.5, 0.9, 0.99])) AS value FROM l""", "", "q value"))
def _(t: Tables):
    return quantiles(t.listings, "price", [0.1, 0.25, 0.5, 0.9, 0.99])


GROUP_QUANTILES = sql("""
  SELECT brand, quantile_cont(price, 0.25) AS price_p25, quantile_cont(price, 0.75) AS price_p75,
         quantile_cont(km, 0.25) AS km_p25, quantile_cont(km, 0.75) AS km_p75 FROM l GROUP BY brand""",
    "brand", "price_p25 price_p75 km_p25 km_p75")


@query("e6_group_quantiles", GROUP_QUANTILES)
def _(t: Tables):
    return group_quantiles(t.listings, ["brand"], ["price", "km"], [0.25, 0.75])


@query("e6_group_quantiles_ranked", GROUP_QUANTILES)
def _(t: Tables):
    return group_quantiles(t.listings, ["brand"], ["price", "km"], [0.25, 0.75], strategy="ranked")


@query("e6_approx_rank_error", sql("SELECT brand, TRUE AS close FROM l GROUP BY brand", "brand close"))
def _(t: Tables):
    """At most a share of 1/10,000 of a group's rows (and one row) lies between an approximate quartile and its rank."""
    table = group_quantiles(t.listings, ["brand"], ["price"], [0.25], strategy="approx")
    both = t.listings.join(table, "brand").groupBy("brand").agg(
        F.count("*").alias("n"), F.count_if(F.col("price") < F.col("price_p25")).alias("below"),
        F.count_if(F.col("price") <= F.col("price_p25")).alias("upto"))
    wanted, slack = F.col("n") * 0.25, F.col("n") * 1e-4 + 1
    return both.select("brand", ((F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("close"))


@query("e6_group_quantiles_approx")
def _(t: Tables):
    return group_quantiles(t.listings, ["brand"], ["price", "km"], [0.25, 0.75], strategy="approx")


@query("e7_value_counts", sql("""
  SELECT variant, count(*) AS n, count(*) / (SELECT count(*) FROM l) AS share FROM l GROUP BY 1
  ORDER BY n DESC, variant LIMIT 10""", "variant n", "share"))
def _(t: Tables):
    return stats.value_counts(t.listings, "variant", 10)


@query("e8_recount", sql("""
  WITH f AS (SELECT date_trunc('month', index_date) AS mo, count(*) AS n FROM l GROUP BY 1)
  SELECT CAST(date_trunc('year', mo) AS DATE) AS period, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_fine, max(n) AS max_fine FROM f GROUP BY 1""",
    "period n n_fine max_fine"))
def _(t: Tables):
    return stats.recount(t.listings, "index_date")


@query("e9_rate_by", sql("""
  SELECT brand, count(*) AS n_total, count(*) FILTER (price > 60000) AS n_flagged,
         count(*) FILTER (price > 60000) * 100.0 / count(*) AS pct FROM l GROUP BY 1""", "brand n_total n_flagged", "pct"))
def _(t: Tables):
    return stats.rate_by(t.listings, ["brand"], F.col("price") > 60000)


@query("e10_null_profile", sql("""
  SELECT 'price' AS "column", count(*) FILTER (flag = 'A') AS n_null,
         count(*) FILTER (flag <> 'A') * 100.0 / count(*) AS complete_pct FROM l
  UNION ALL SELECT 'km', 0, 100.0""", '"column" n_null', "complete_pct"))
def _(t: Tables):
    gappy = t.listings.withColumn("price", F.when(F.col("flag") != "A", F.col("price")))
    return stats.null_profile(gappy, ["price", "km"])


@query("e11_correlations", sql("""
  SELECT 'price' AS a, 'km' AS b, corr(price, km) AS r FROM l
  UNION ALL SELECT 'price', 'horsepower', corr(price, horsepower) FROM l
  UNION ALL SELECT 'km', 'horsepower', corr(km, horsepower) FROM l""", "a b", "r"))
def _(t: Tables):
    return stats.correlations(t.listings, ["price", "km", "horsepower"])


@query("e12_trend", sql(
    "SELECT brand, regr_slope(price, km) AS slope, regr_intercept(price, km) AS intercept FROM l GROUP BY 1",
    "brand", "slope intercept"))
def _(t: Tables):
    return stats.trend(t.listings, "km", "price", ["brand"])


@query("e13_trend2", sql("""
  WITH p AS (SELECT km / 1000 AS x, price AS y FROM l), mx AS (SELECT avg(x) AS mx FROM p), q AS (SELECT x - mx AS u, y FROM p, mx),
  s AS (SELECT count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS sy, sum(u * y) AS suy,
    sum(u * u * y) AS su2y FROM q),
  c AS (SELECT *, (su2y - s2 * sy / n - s3 * suy / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS c FROM s),
  b AS (SELECT *, (suy - s3 * c) / s2 AS b, (sy - s2 * c) / n AS a FROM c)
  SELECT a - b * mx + c * mx * mx AS c0, b - 2 * c * mx AS c1, c AS c2 FROM b, mx""", "", "c0 c1 c2"))
def _(t: Tables):
    return stats.trend2(t.listings.withColumn("k", F.col("km") / 1000), "k", "price")


@query("e14_binned", sql(f"""
  SELECT {BIN_SQL} AS bin, count(*) AS n, avg(km) AS mean_km FROM l GROUP BY 1""", "bin n", "mean_km"))
def _(t: Tables):
    return stats.binned(t.listings, "price", BINS, BIN_LABELS, [F.avg("km").alias("mean_km")])


@query("e15_histogram", sql("""
  WITH b AS (SELECT least(floor((least(greatest(price, 5000), 65000) - 5000) / 3000), 19)::INT AS bin FROM l)
  SELECT bin, count(*) AS n, bin * 3000 + 5000 AS left_edge FROM b GROUP BY bin""", "bin n", "left_edge"))
def _(t: Tables):
    return stats.histogram(t.listings, "price", 5000, 65000, 20)


@query("e16_density", sql("""
  WITH c AS (SELECT brand, round(price / 100) AS cell, count(*) AS n FROM l GROUP BY 1, 2),
       g AS (SELECT unnest([10000, 30000, 50000, 70000])::DOUBLE AS x)
  SELECT brand, x, sum(exp(-0.5 * pow((x - cell * 100) / 2000, 2)) * n) / (2000 * sqrt(2 * pi())) / sum(n) * 1e6 AS density
  FROM c, g GROUP BY brand, x""", "brand", "x density"))
def _(t: Tables):
    shape = stats.density(t.listings, "price", [10000, 30000, 50000, 70000], 2000.0, ["brand"])
    return shape.withColumn("density", F.col("density") * 1e6)


@query("e17_ecdf", sql("""
  WITH e AS (SELECT ceil(abs(price - 40000) / 100) AS k, count(*) AS n FROM l GROUP BY 1)
  SELECT k * 100 AS value, n, sum(n) OVER (ORDER BY k) / (SELECT count(*) FROM l) AS share FROM e""", "n", "value share"))
def _(t: Tables):
    errors = t.listings.select(F.abs(F.col("price") - 40000).alias("error"))
    return stats.ecdf(errors, "error", 100.0, cells=50)


@query("e18_pivot", sql("""
  SELECT brand, avg(price) FILTER (flag = 'A') AS "A", avg(price) FILTER (flag = 'N') AS "N", avg(price) FILTER (flag = 'R') AS "R"
  FROM l GROUP BY brand""", "brand", '"A" "N" "R"'))
def _(t: Tables):
    return stats.pivot(t.listings, "brand", "flag", ["A", "N", "R"], F.avg("price"))


@query("e19_weighted_mean", sql("""
  WITH g AS (SELECT brand, flag, avg(price) AS m, count(*) AS n FROM l GROUP BY 1, 2)
  SELECT flag, sum(m * n) / sum(n) AS weighted_mean FROM g GROUP BY flag""", "flag", "weighted_mean"))
def _(t: Tables):
    means = t.listings.groupBy("brand", "flag").agg(F.avg("price").alias("m"), stats.n_rows())
    return stats.weighted_mean(means, "m", "n", ["flag"])


@query("e20_mean_std", sql("""
  WITH g AS (SELECT brand, year, avg(price) AS price, avg(km) AS km FROM l GROUP BY 1, 2)
  SELECT brand, count(*) AS n, avg(price) AS price_mean, stddev_samp(price) AS price_std, avg(km) AS km_mean,
         stddev_samp(km) AS km_std FROM g GROUP BY brand""", "brand n", "price_mean price_std km_mean km_std"))
def _(t: Tables):
    segments = t.listings.groupBy("brand", "year").agg(F.avg("price").alias("price"), F.avg("km").alias("km"))
    return stats.mean_std(segments, ["brand"], ["price", "km"])


@query("e21_distribution_stats", sql("""
  SELECT variant, count(*) AS n, quantile_cont(ln(price), 0.25) AS p25, median(ln(price)) AS p50, quantile_cont(ln(price), 0.75) AS p75,
         quantile_cont(ln(price), 0.9) AS p90, quantile_cont(ln(price), 0.95) AS p95,
         quantile_cont(ln(price), 0.75) - quantile_cont(ln(price), 0.25) AS iqr FROM l GROUP BY 1 HAVING count(*) >= 900""",
    "variant n", "p25 p50 p75 p90 p95 iqr"))
def _(t: Tables):
    return stats.distribution_stats(t.listings, ["variant"], "price", 900)


@query("e22_price_cv", sql(
    "SELECT brand, stddev_samp(price) / (avg(price) + 1) AS cv FROM l GROUP BY 1", "brand", "cv"))
def _(t: Tables):
    return stats.price_cv(t.listings, ["brand"], "price")


@query("e23_funnel", sql("""
  SELECT 0 AS step, 'all' AS stage, count(*) AS n_rows, count(DISTINCT brand) AS n_brands, count(DISTINCT model) AS n_models FROM l
  UNION ALL SELECT 1, 'cheap', count(*), count(DISTINCT brand), count(DISTINCT model) FROM l WHERE price < 2000""",
    "step stage n_rows n_brands n_models"))
def _(t: Tables):
    return stats.funnel({"all": t.listings, "cheap": t.listings.where("price < 2000")})


@query("e24_group_size_report", sql("""
  WITH s AS (SELECT brand, year, count(*) AS n FROM l GROUP BY 1, 2)
  SELECT year, count(*) AS n_groups, count(*) FILTER (n < 350) AS n_small,
         CAST(coalesce(sum(n) FILTER (n < 350), 0) AS BIGINT) AS rows_small,
         CAST(coalesce(sum(n) FILTER (n >= 350), 0) AS BIGINT) AS rows_large, median(n) AS median_size FROM s GROUP BY year""",
    "year n_groups n_small rows_small rows_large", "median_size"))
def _(t: Tables):
    return stats.group_size_report(t.listings, ["brand", "year"], 350, by="year")


@query("e25_sample_n", sql("""
  SELECT url, price FROM (SELECT url, price, row_number() OVER (ORDER BY md5(concat_ws('|', '42', url)), brand, km, price) AS rn
    FROM (SELECT DISTINCT url, brand, km, price FROM l)) WHERE rn <= 1000""", "url", "price"))
def _(t: Tables):
    unique = t.listings.select("url", "brand", "km", "price").distinct()
    return stats.sample_n(unique.select("brand", "km", "price", "url"), 1000, ["url"]).select("url", "price")


@query("e26_five_number", sql("""
  WITH q AS (SELECT brand, quantile_cont(price, 0.25) q1, median(price) median, quantile_cont(price, 0.75) q3 FROM l GROUP BY 1)
  SELECT brand, q1, median, q3, count(*) AS n,
    min(price) FILTER (price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)) AS low,
    max(price) FILTER (price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)) AS high,
    count(*) FILTER (NOT price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)) AS n_outliers
  FROM l JOIN q USING (brand) GROUP BY ALL""", "brand n n_outliers", "q1 median q3 low high"))
def _(t: Tables):
    return stats.five_number(t.listings, ["brand"], "price", 0.5)


@query("f1_rank_within", sql("""
  WITH g AS (SELECT brand, variant, count(*) AS n, median(price) AS median FROM l GROUP BY 1, 2 HAVING count(*) >= 20)
  SELECT brand, variant, n, median, CAST(dense_rank() OVER (PARTITION BY brand ORDER BY median) AS INT) AS rank FROM g""",
    "brand variant n rank", "median"))
def _(t: Tables):
    return windows.rank_within(t.listings, "brand", "variant", "price", 20)


@query("f2_latest_per_key", sql("""
  SELECT url, stamp, price FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY stamp DESC NULLS LAST, price) AS rn
    FROM (SELECT url, CASE WHEN flag <> 'A' THEN index_date END AS stamp, price FROM l)) WHERE rn = 1""", "url stamp", "price"))
def _(t: Tables):
    seen = t.listings.select("url", F.when(F.col("flag") != "A", F.col("index_date")).alias("stamp"), "price")
    return windows.latest_per_key(seen, "url", "stamp", ["price"])


@query("f3_best_source", sql("""
  SELECT url, rank, price FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank DESC, price) AS rn
    FROM (SELECT url, CASE snapshot WHEN 'O' THEN 1 ELSE 0 END AS rank, price FROM l)) WHERE rn = 1""", "url rank", "price"))
def _(t: Tables):
    ranked = t.listings.select("url", (F.col("snapshot") == "O").cast("int").alias("rank"), "price")
    return windows.best_source(ranked, "url", "rank", ["price"])


@query("f4_arg_row", sql("""
  SELECT brand, year, url, km, price, kind FROM (
    SELECT brand, year, url, km, price, 'min' AS kind, row_number() OVER (PARTITION BY brand, year ORDER BY price, url) rn FROM l
    UNION ALL SELECT brand, year, url, km, price, 'max', row_number() OVER (PARTITION BY brand, year ORDER BY price DESC, url) FROM l)
  WHERE rn = 1""", "brand year url kind", "km price"))
def _(t: Tables):
    slim = t.listings.select("brand", "year", "url", "km", "price")
    return union_all(*[
        windows.arg_row(slim, ["brand", "year"], "price", kind, ["url"]).withColumn("kind", F.lit(kind)) for kind in ("min", "max")])


@query("f5_pooled_quantiles", sql("""
  WITH k AS (SELECT DISTINCT brand, year FROM l)
  SELECT k.brand, k.year, count(*) AS n_pool, quantile_cont(price, 0.25) AS q1_price, quantile_cont(price, 0.75) AS q3_price,
         median(km) AS median_km
  FROM k JOIN l ON l.brand = k.brand AND l.year BETWEEN k.year - 1 AND k.year + 1 GROUP BY 1, 2""",
    "brand year n_pool", "q1_price q3_price median_km"))
def _(t: Tables):
    spec = {"q1_price": ("price", 0.25), "q3_price": ("price", 0.75), "median_km": ("km", 0.5)}
    return pooled_quantiles(t.listings, ["brand"], "year", spec)


@query("f6_with_group_stat", sql("""
  SELECT url, brand, price, median(price) OVER (PARTITION BY brand) AS price_median FROM l""", "url brand", "price price_median"))
def _(t: Tables):
    return stats.with_group_stat(t.listings.select("url", "brand", "price"), ["brand"], "price", "median")


@query("f7_with_share", sql("""
  SELECT url, brand, count(*) OVER (PARTITION BY brand) / count(*) OVER () AS share FROM l""", "url brand", "share"))
def _(t: Tables):
    return stats.with_share(t.listings.select("url", "brand"), ["brand"])


@query("g1_join_stats", sql("""
  WITH g AS (SELECT brand, avg(price) AS mean_price FROM l WHERE flag = 'A' GROUP BY 1)
  SELECT url, brand, price - mean_price AS diff FROM l LEFT JOIN g USING (brand)""", "url brand", "diff"))
def _(t: Tables):
    means = t.second_market.groupBy("brand").agg(F.avg("price").alias("mean_price"))
    joined = match.join_stats(t.listings, means, "brand")
    return joined.select("url", "brand", (F.col("price") - F.col("mean_price")).alias("diff"))


@query("g2_join_stats_composite", sql("""
  WITH g AS (SELECT brand, variant, year, avg(price) AS mean_price FROM l WHERE flag = 'A' GROUP BY ALL)
  SELECT url, brand, mean_price FROM l LEFT JOIN g USING (brand, variant, year)""", "url brand", "mean_price"))
def _(t: Tables):
    keys = ["brand", "variant", "year"]
    means = t.second_market.groupBy(*keys).agg(F.avg("price").alias("mean_price"))
    return match.join_stats(t.listings, means, keys).select("url", "brand", "mean_price")


# The two snapshots, one row per url in each.
SNAPSHOT_PAIR = """a AS (SELECT url, price FROM (SELECT url, price, row_number() OVER (PARTITION BY url ORDER BY price) rn
    FROM l WHERE snapshot = 'F') WHERE rn = 1),
  b AS (SELECT url, price FROM (SELECT url, price, row_number() OVER (PARTITION BY url ORDER BY price) rn
    FROM l WHERE snapshot = 'O') WHERE rn = 1)"""


def snapshot_pair(t: Tables):
    return [
        windows.dedup_subset(t.listings.where(F.col("snapshot") == s).select("url", "price"), ["url"], ["price"])
        for s in ("F", "O")
    ]


@query("g3_pair_snapshots", sql(f"""
  WITH {SNAPSHOT_PAIR} SELECT url, a.price AS price_a, b.price AS price_b FROM a JOIN b USING (url)""", "url", "price_a price_b"))
def _(t: Tables):
    return match.pair_snapshots(*snapshot_pair(t), "url", "price")


@query("g4_join_aggregates", sql("""
  WITH a AS (SELECT brand, year, count(*) AS n_a FROM l WHERE snapshot = 'F' GROUP BY 1, 2),
       b AS (SELECT brand, year, count(*) AS n_b FROM l WHERE snapshot = 'O' GROUP BY 1, 2)
  SELECT brand, year, n_a, n_b FROM a JOIN b USING (brand, year)""", "brand year n_a n_b"))
def _(t: Tables):
    count = lambda s, n: t.listings.where(F.col("snapshot") == s).groupBy("brand", "year").agg(stats.n_rows(n))
    return match.join_aggregates(count("F", "n_a"), count("O", "n_b"), ["brand", "year"])


@query("g5_keep_seen", sql("""
  SELECT url, brand, variant, year FROM l WHERE flag = 'R' AND EXISTS (
    SELECT 1 FROM l x WHERE x.flag = 'N' AND x.brand = l.brand AND x.variant = l.variant AND x.year = l.year)""",
    "url brand variant year"))
def _(t: Tables):
    keys = ["brand", "variant", "year"]
    return rows.keep_seen(t.declared, t.market, keys).select("url", *keys)


@query("g6_join_counts", sql("""
  WITH b AS (SELECT DISTINCT brand FROM l), c AS (SELECT brand, count(*) AS n FROM l WHERE price > 104500 GROUP BY 1)
  SELECT brand, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (brand)""", "brand n"))
def _(t: Tables):
    dear = t.listings.where("price > 104500").groupBy("brand").agg(stats.n_rows())
    return match.join_counts(t.listings.select("brand").distinct(), dear, "brand")


@query("g7_coverage", sql("""
  WITH k AS (SELECT DISTINCT brand, variant, year FROM m2)
  SELECT d.brand, d.variant, d.year, count(*) AS n, count(*) FILTER (k.brand IS NULL) AS n_unmatched
  FROM d LEFT JOIN k ON d.brand = k.brand AND d.variant = k.variant AND d.year = k.year GROUP BY 1, 2, 3""",
    "brand variant year n n_unmatched"))
def _(t: Tables):
    keys = ["brand", "variant", "year"]
    flagged, _missing = match.coverage(t.declared, t.second_market, keys)
    return flagged.groupBy(*keys).agg(stats.n_rows(), F.count_if(~F.col("has_match")).alias("n_unmatched"))


@query("g7_coverage_missing", sql("""
  SELECT DISTINCT brand, variant, year FROM d
  WHERE (brand, variant, year) NOT IN (SELECT brand, variant, year FROM m2)""", "brand variant year"))
def _(t: Tables):
    return match.coverage(t.declared, t.second_market, ["brand", "variant", "year"])[1]


BAND_SPEC = {"p10": ("price", 0.1), "p90": ("price", 0.9)}


@query("g8_band_join", sql("""
  WITH k AS (SELECT DISTINCT brand, model, year FROM d),
       j AS (SELECT k.brand, k.model, k.year, count(m.price) AS n, quantile_cont(m.price, 0.1) AS p10, quantile_cont(m.price, 0.9) AS p90
             FROM k LEFT JOIN m ON m.brand = k.brand AND m.model = k.model AND m.year BETWEEN k.year - 1 AND k.year + 1 GROUP BY 1, 2, 3)
  SELECT url, brand, model, year, n, p10, p90 FROM d JOIN j USING (brand, model, year)""", "url brand model year n", "p10 p90"))
def _(t: Tables):
    out = match.band_join(t.declared, t.market, ["brand", "model"], "year", 1, BAND_SPEC)
    return out.select("url", "brand", "model", "year", "n", "p10", "p90")


@query("g9_match_counts", sql("""
  WITH k AS (SELECT DISTINCT brand, variant, year FROM d),
       j AS (SELECT k.brand, k.variant, k.year, count(m.price) FILTER (m.year = k.year) AS n_exact, count(m.price) AS n_band
             FROM k LEFT JOIN m ON m.brand = k.brand AND m.variant = k.variant AND m.year BETWEEN k.year - 1 AND k.year + 1 GROUP BY 1, 2, 3)
  SELECT url, n_exact, n_band FROM d JOIN j USING (brand, variant, year)""", "url n_exact n_band"))
def _(t: Tables):
    return match.match_counts(t.declared, t.market, ["brand", "variant"], "year", 1).select("url", "n_exact", "n_band")


@query("g10_exact_reference", sql("""
  WITH g AS (SELECT brand, variant, year, count(*) AS n, quantile_cont(price, 0.1) p10, median(price) p50, quantile_cont(price, 0.9) p90
             FROM m2 GROUP BY ALL)
  SELECT url, coalesce(n, 0) AS second_n, CAST(n IS NOT NULL AS INT) AS second_has_data, p10 AS second_p10, p50 AS second_p50, p90 AS second_p90
  FROM d LEFT JOIN g USING (brand, variant, year)""", "url second_n second_has_data", "second_p10 second_p50 second_p90"))
def _(t: Tables):
    out = match.exact_reference(
        t.declared, t.second_market, ["brand", "variant", "year"], "price", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.select("url", "second_n", F.col("second_has_data").cast("int").alias("second_has_data"),
                      "second_p10", "second_p50", "second_p90")


@query("g11_offset_join", sql("""
  WITH k AS (SELECT DISTINCT brand, variant, year FROM d), c AS (SELECT brand, variant, year, count(*) AS n FROM m GROUP BY ALL)
  SELECT c.brand, c.variant, c.year, k.year AS target_band, c.year - k.year AS band_offset, n
  FROM k JOIN c ON k.brand = c.brand AND k.variant = c.variant AND c.year - k.year IN (-1, 0, 1)""",
    "brand variant year target_band band_offset n"))
def _(t: Tables):
    counts = t.market.groupBy("brand", "variant", "year").agg(stats.n_rows())
    return match.offset_join(t.declared, counts, ["brand", "variant"], "year")


@query("g12_lookalikes", sql("""
  WITH n AS (SELECT brand, variant, count(*) AS n FROM l GROUP BY 1, 2)
  SELECT a.brand, a.variant AS name_a, a.n AS n_a, b.variant AS name_b, b.n AS n_b FROM n a JOIN n b
    ON a.brand = b.brand AND a.variant < b.variant AND substr(lower(trim(a.variant)), 1, 3) = substr(lower(trim(b.variant)), 1, 3)
   AND abs(length(trim(a.variant)) - length(trim(b.variant))) <= 2""", "brand name_a n_a name_b n_b"))
def _(t: Tables):
    return match.lookalikes(t.listings, "brand", "variant")


@query("g13_with_scalars", sql("""
  SELECT url, price / (SELECT median(price) FROM l) AS relative FROM l""", "url", "relative"))
def _(t: Tables):
    middle = quantile_table(t.listings, [], {"middle": ("price", 0.5)})
    return stats.with_scalars(t.listings, middle).select("url", (F.col("price") / F.col("middle")).alias("relative"))


@query("h1_order_latest", sql("""
  SELECT url, stamp FROM (SELECT url, CASE WHEN flag <> 'A' THEN index_date END AS stamp FROM l)
  ORDER BY stamp DESC NULLS LAST, url""", "url stamp"))
def _(t: Tables):
    seen = t.listings.select("url", F.when(F.col("flag") != "A", F.col("index_date")).alias("stamp"))
    return stats.order_latest(seen, "stamp", ["url"])


@query("h2_keep_top_groups", sql("""
  SELECT url, variant FROM l WHERE variant IN (SELECT variant FROM l GROUP BY 1 ORDER BY count(*) DESC, variant LIMIT 5)""", "url variant"))
def _(t: Tables):
    return stats.keep_top_groups(t.listings, "variant", 5).select("url", "variant")


@query("h3_extremes", sql("""
  WITH g AS (SELECT brand, year, avg(price) AS mean_price FROM l GROUP BY 1, 2)
  (SELECT *, 'high' AS "end" FROM g ORDER BY mean_price DESC, brand, year LIMIT 10)
  UNION ALL (SELECT *, 'low' FROM g ORDER BY mean_price, brand, year LIMIT 10)""", 'brand year "end"', "mean_price"))
def _(t: Tables):
    means = t.listings.groupBy("brand", "year").agg(F.avg("price").alias("mean_price"))
    return stats.extremes(means, "mean_price", 10, ["brand", "year"])


@query("h4_order_by_labels", sql("""
  SELECT flag, count(*) AS n, CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS label_order FROM l GROUP BY 1""", "flag n label_order"))
def _(t: Tables):
    return stats.order_by_labels(stats.count_by(t.listings, ["flag"]), "flag", ["R", "A", "N"])


@query("h5_best_row", sql("""
  WITH g AS (SELECT brand, year, avg(price) AS mean_price FROM l GROUP BY 1, 2)
  SELECT brand, year, mean_price FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY mean_price, year) rn FROM g) WHERE rn = 1""",
    "brand year", "mean_price"))
def _(t: Tables):
    means = t.listings.groupBy("brand", "year").agg(F.avg("price").alias("mean_price"))
    return stats.best_row(means, "mean_price", ["brand"], ["year"])


@query("i2_combinations", sql("SELECT DISTINCT brand, variant FROM l", "brand variant"))
def _(t: Tables):
    return stats.combinations(t.listings, ["brand", "variant"])


@query("i3_dedup_subset", sql("""
  SELECT brand, variant, year, url, price FROM (SELECT *, row_number() OVER (PARTITION BY brand, variant, year ORDER BY url, price) rn FROM l)
  WHERE rn = 1""", "brand variant year url", "price"))
def _(t: Tables):
    slim = t.listings.select("brand", "variant", "year", "url", "price")
    return windows.dedup_subset(slim, ["brand", "variant", "year"], ["url", "price"])


@query("i4_vocabulary_diff", sql("""
  SELECT variant || '-' || seller AS word, count(*) AS n_rows,
         CAST(variant || '-' || seller IN (SELECT variant || '-' || seller FROM m) AS INT) AS seen FROM l GROUP BY 1""", "word n_rows seen"))
def _(t: Tables):
    words = t.listings.withColumn("word", F.concat_ws("-", "variant", "seller"))
    diff = rows.vocabulary_diff(words, words.where("flag = 'N'"), "word")
    return diff.withColumn("seen", F.col("seen").cast("int"))


@query("e9_rate_by_age_bucket", sql(f"""
  SELECT {BUCKET} AS bucket, count(*) AS n_total, count(*) FILTER (km > 150000) AS n_flagged,
         count(*) FILTER (km > 150000) * 100.0 / count(*) AS pct FROM l GROUP BY 1""", "bucket n_total n_flagged", "pct"))
def _(t: Tables):
    bucketed = t.aged.withColumn("bucket", age_bucket("car_age")[0])
    return stats.rate_by(bucketed, ["bucket"], F.col("km") > 150_000)

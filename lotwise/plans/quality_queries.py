"""Queries over cleaning, duplicates and drift (inventory J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.config import CleaningConfig
from lotwise.functions.features import age_bucket
from lotwise.operators import quality as q
from lotwise.operators.match import pair_snapshots
from lotwise.operators.quantiles import quantile_table
from lotwise.operators.stats import combinations, count_by, keep_top_groups, n_rows
from lotwise.plans import cleaning, snapshots
from lotwise.plans.catalog import Tables, query, sql
from lotwise.plans.column_queries import BUCKET
from lotwise.plans.stats_queries import SNAPSHOT_PAIR, snapshot_pair

# Thresholds of the queries, small enough for every branch to be taken on small data.
DIRECT, POOL, MULT = 350, 700, 0.5
FENCES = {"log_price1p": MULT, "km": MULT}
CONFIG = CleaningConfig(
    price_floor=2000, price_ceiling=100_000, min_year=1996, placeholder="promo", hp_multiplier=0.3,
    min_brand_count=1200, price_multiplier=MULT, km_multiplier=MULT, large_group=200, min_pool=400)


def pooled_ctes(source: str, direct: int, pool: int) -> str:
    """CTEs p (rows with ln price), sz, pl and b (fences with their origin) over `source`."""
    return f"""p AS (SELECT *, ln(price + 1) AS lp FROM {source} WHERE price > 0 AND km >= 0),
  sz AS (SELECT brand, year, count(*) AS n_group FROM p GROUP BY 1, 2),
  pl AS (SELECT sz.brand, sz.year, sz.n_group, p.lp, p.km FROM sz JOIN p ON p.brand = sz.brand
         AND (p.year = sz.year OR (sz.n_group < {direct} AND p.year BETWEEN sz.year - 1 AND sz.year + 1))),
  b0 AS (SELECT brand, year, n_group, count(*) AS n_pool, quantile_cont(lp, 0.25) a1, quantile_cont(lp, 0.75) a3,
         quantile_cont(km, 0.25) c1, quantile_cont(km, 0.75) c3 FROM pl GROUP BY 1, 2, 3),
  b AS (SELECT brand, year, n_group, n_pool, a1 - {MULT} * (a3 - a1) AS lo_lp, a3 + {MULT} * (a3 - a1) AS hi_lp,
        c1 - {MULT} * (c3 - c1) AS lo_km, c3 + {MULT} * (c3 - c1) AS hi_km,
        CASE WHEN n_group >= {direct} THEN 'brand_year' WHEN n_pool >= {pool} THEN 'brand_year_pm1' ELSE 'no_bound' END AS source
        FROM b0)"""


INSIDE = "lp BETWEEN lo_lp AND hi_lp AND km BETWEEN lo_km AND hi_km"
PLAIN_FENCES = f"""f AS (SELECT brand, count(*) AS n_group, quantile_cont(ln(price + 1), 0.25) a1, quantile_cont(ln(price + 1), 0.75) a3,
    quantile_cont(km, 0.25) c1, quantile_cont(km, 0.75) c3 FROM l GROUP BY brand)"""


def outside(mult: str, km_mult: str = str(MULT)) -> str:
    return f"""(ln(price + 1) < a1 - {mult} * (a3 - a1) OR ln(price + 1) > a3 + {mult} * (a3 - a1)
      OR km < c1 - {km_mult} * (c3 - c1) OR km > c3 + {km_mult} * (c3 - c1))"""


CLEANING = f"""
  s0 AS (SELECT price, year, km, lower(replace(brand, '#', '')) AS brand, lower(model) AS model, energie, horsepower FROM l),
  s1 AS (SELECT * FROM s0 WHERE price BETWEEN 2000 AND 100000 AND year >= 1996 AND brand <> 'promo' AND model <> 'promo'
         AND horsepower BETWEEN 50 AND 1000),
  h AS (SELECT brand, quantile_cont(horsepower, 0.25) h1, quantile_cont(horsepower, 0.75) h3 FROM s1 GROUP BY 1),
  s2 AS (SELECT s1.* FROM s1 JOIN h USING (brand) WHERE horsepower BETWEEN h1 - 0.3 * (h3 - h1) AND h3 + 0.3 * (h3 - h1)),
  s3 AS (SELECT * FROM s2 WHERE brand IN (SELECT brand FROM s2 GROUP BY 1 HAVING count(*) >= 1200)),
  {pooled_ctes('s3', 200, 400)},
  s4 AS (SELECT price, year, km, brand, model, energie, horsepower FROM p JOIN b USING (brand, year) WHERE source <> 'no_bound' AND {INSIDE})"""


@query("j1_clean", sql(f"WITH {CLEANING} SELECT * FROM s4", "year brand model energie", "price km horsepower"))
def _(t: Tables):
    return cleaning.clean(t.raw_listings, CONFIG)


STAGE_ROWS = (
    ("typed", "s0"), ("price_bounds", "s0 WHERE price BETWEEN 2000 AND 100000"),
    ("min_year", "s0 WHERE price BETWEEN 2000 AND 100000 AND year >= 1996"),
    ("placeholder", "s0 WHERE price BETWEEN 2000 AND 100000 AND year >= 1996 AND brand <> 'promo' AND model <> 'promo'"),
    ("horsepower", "s2"), ("rare_brands", "s3"), ("clean", "s4"),
)


@query("j1_stage_counts", sql(
    f"WITH {CLEANING} " + " UNION ALL ".join(
        f"SELECT {i} AS step, '{name}' AS stage, count(*) AS n_rows FROM {rows}" for i, (name, rows) in enumerate(STAGE_ROWS)),
    "step stage n_rows"))
def _(t: Tables):
    return cleaning.stage_counts(cleaning.cleaning_stages(t.raw_listings, CONFIG))


@query("j2_iqr_filter", sql(f"""
  WITH {PLAIN_FENCES} SELECT url, brand, price, km FROM l JOIN f USING (brand) WHERE NOT {outside(str(MULT))}""",
    "url brand", "price km"))
def _(t: Tables):
    kept = q.iqr_filter(q.prepare_fences(t.listings), ["brand"], FENCES)
    return kept.select("url", "brand", "price", "km")


J3_SQL = sql(f"""
  WITH {pooled_ctes('l', DIRECT, POOL)}
  SELECT url, brand, year, price, km FROM p JOIN b USING (brand, year) WHERE source <> 'no_bound' AND {INSIDE}""",
    "url brand year", "price km")


def pooled_filter(t: Tables, direct: int = DIRECT, pool: int = POOL, **options):
    return q.iqr_filter_pooled(q.prepare_fences(t.listings), "brand", "year", FENCES, direct, pool, **options)


def segment_corridor(t: Tables, direct: int = DIRECT, pool: int = POOL):
    """Lower, median and upper price per brand and year, after robust cleaning."""
    spec = {"q15": ("price", 0.15), "q50": ("price", 0.5), "q85": ("price", 0.85)}
    return quantile_table(pooled_filter(t, direct, pool), ["brand", "year"], spec, aggs=[n_rows()])


@query("j3_iqr_filter_pooled", J3_SQL)
def _(t: Tables):
    return pooled_filter(t).select("url", "brand", "year", "price", "km")


@query("j3_iqr_filter_pooled_ranked", J3_SQL)
def _(t: Tables):
    return pooled_filter(t, strategy="ranked").select("url", "brand", "year", "price", "km")


@query("j3_iqr_filter_pooled_keep_sparse", sql(f"""
  WITH {pooled_ctes('l', DIRECT, POOL)}
  SELECT url, brand, year, price, km FROM p JOIN b USING (brand, year) WHERE source = 'no_bound' OR ({INSIDE})""",
    "url brand year", "price km"))
def _(t: Tables):
    return pooled_filter(t, sparse="keep").select("url", "brand", "year", "price", "km")


@query("j3_segment_corridor", sql(f"""
  WITH {pooled_ctes('l', DIRECT, POOL)},
  k AS (SELECT * FROM p JOIN b USING (brand, year) WHERE source <> 'no_bound' AND {INSIDE})
  SELECT brand, year, count(*) AS n, quantile_cont(price, 0.15) AS q15, median(price) AS q50, quantile_cont(price, 0.85) AS q85
  FROM k GROUP BY 1, 2""", "brand year n", "q15 q50 q85"))
def _(t: Tables):
    return segment_corridor(t)


@query("j4_iqr_bounds", sql(f"""
  WITH {pooled_ctes('l', DIRECT, POOL)}
  SELECT brand, year, n_group, n_pool, source, CASE WHEN source <> 'no_bound' THEN lo_lp END AS lo_log_price1p,
    CASE WHEN source <> 'no_bound' THEN hi_lp END AS hi_log_price1p, CASE WHEN source <> 'no_bound' THEN lo_km END AS lo_km,
    CASE WHEN source <> 'no_bound' THEN hi_km END AS hi_km FROM b""",
    "brand year n_group n_pool source", "lo_log_price1p hi_log_price1p lo_km hi_km"))
def _(t: Tables):
    return q.iqr_bounds(q.prepare_fences(t.listings), "brand", "year", FENCES, DIRECT, POOL)


@query("j4_bounds_summary", sql(f"""
  WITH {pooled_ctes('l', DIRECT, POOL)}
  SELECT source, count(*) AS n_groups, CAST(sum(n_group) AS BIGINT) AS n_rows FROM b GROUP BY 1""", "source n_groups n_rows"))
def _(t: Tables):
    return q.bounds_summary(q.iqr_bounds(q.prepare_fences(t.listings), "brand", "year", FENCES, DIRECT, POOL))


@query("j5_iqr_flag", sql(f"""
  WITH {PLAIN_FENCES} SELECT url, brand, CAST({outside(str(MULT))} AS INT) AS is_iqr_outlier FROM l JOIN f USING (brand)""",
    "url brand is_iqr_outlier"))
def _(t: Tables):
    flagged = q.iqr_flag(q.prepare_fences(t.listings), ["brand"], FENCES)
    return flagged.select("url", "brand", F.col("is_iqr_outlier").cast("int").alias("is_iqr_outlier"))


@query("j6_iqr_filter_two_tier", sql(f"""
  WITH {PLAIN_FENCES} SELECT url, brand FROM l JOIN f USING (brand)
  WHERE NOT {outside(f"(CASE WHEN n_group > 2400 THEN 0.1 ELSE {MULT} END)")}""", "url brand"))
def _(t: Tables):
    kept = q.iqr_filter(q.prepare_fences(t.listings), ["brand"], FENCES, tier=(2400, {"log_price1p": 0.1}))
    return kept.select("url", "brand")


SWEEP = (0.1, 0.3, 0.5, 0.9, 1.5)


SWEEP_SQL = f"""
  WITH {PLAIN_FENCES}, k AS (SELECT unnest([0.1, 0.3, 0.5, 0.9, 1.5])::DOUBLE AS multiplier),
  r AS (SELECT multiplier, n_group > 2400 AS big,
    (ln(price + 1) < a1 - (CASE WHEN n_group > 2400 THEN multiplier ELSE 0.4 END) * (a3 - a1)
      OR ln(price + 1) > a3 + (CASE WHEN n_group > 2400 THEN multiplier ELSE 0.4 END) * (a3 - a1)) AS out_price,
    (km < c1 - 0.4 * (c3 - c1) OR km > c3 + 0.4 * (c3 - c1)) AS out_km FROM l JOIN f USING (brand), k),
  g AS (SELECT multiplier, count(*) AS n, count(*) FILTER (big) AS n_big, count(*) FILTER (out_price OR out_km) AS total_outliers,
    count(*) FILTER (out_price) AS price_outliers, count(*) FILTER (big AND (out_price OR out_km)) AS high_volume_outliers FROM r GROUP BY 1)
  SELECT multiplier, total_outliers, price_outliers, high_volume_outliers, n - total_outliers AS data_retained,
    (n - total_outliers) * 100.0 / n AS retention_rate, CASE WHEN n_big > 0 THEN (n_big - high_volume_outliers) * 100.0 / n_big ELSE 100 END AS high_volume_retention,
    CASE WHEN total_outliers * 100.0 / n > 0.5 THEN (n - total_outliers) * 1.0 / n * (total_outliers * 100.0 / n / 5.0) END AS balance_score
  FROM g"""


@query("j7_iqr_sweep", sql(SWEEP_SQL, "total_outliers price_outliers high_volume_outliers data_retained",
    "multiplier retention_rate high_volume_retention balance_score"))
def _(t: Tables):
    return q.iqr_sweep(q.prepare_fences(t.listings), "brand", "log_price1p", "km", SWEEP, 2400, 0.4)


@query("j7_best_multiplier", sql(
    f"SELECT multiplier, balance_score FROM ({SWEEP_SQL}) AS sweep WHERE balance_score IS NOT NULL ORDER BY balance_score DESC, multiplier LIMIT 1",
    "", "multiplier balance_score"))
def _(t: Tables):
    sweep = q.iqr_sweep(q.prepare_fences(t.listings), "brand", "log_price1p", "km", SWEEP, 2400, 0.4)
    return q.best_multiplier(sweep)


@query("j8_drop_rare", sql(
    "SELECT url, brand FROM l WHERE brand IN (SELECT brand FROM l GROUP BY 1 HAVING count(*) >= 2400)", "url brand"))
def _(t: Tables):
    return q.drop_rare(t.listings, "brand", 2400).select("url", "brand")


@query("j8_rare_counts", sql("""
  WITH c AS (SELECT brand, count(*) AS n FROM l GROUP BY 1)
  SELECT count(*) AS n_keys, count(*) FILTER (n >= 2400) AS n_kept, CAST(sum(n) AS BIGINT) AS rows_before,
    CAST(coalesce(sum(n) FILTER (n >= 2400), 0) AS BIGINT) AS rows_after FROM c""", "n_keys n_kept rows_before rows_after"))
def _(t: Tables):
    return q.rare_counts(t.listings, "brand", 2400)


@query("j9_group_mid_frequency", sql("""
  WITH x AS (SELECT url, brand, model, price * CAST(substr(brand, 7) AS INT) AS price FROM l),
  c AS (SELECT brand, count(*) AS n, avg(price) AS mean_price FROM x GROUP BY 1 HAVING count(*) >= 2000),
  k AS (SELECT x.*, n, mean_price FROM x JOIN c USING (brand)),
  z AS (SELECT quantile_cont(price, 0.33) lo, quantile_cont(price, 0.67) hi FROM k),
  r AS (SELECT url, brand, model, CASE WHEN n < 2500 THEN CASE WHEN mean_price <= lo THEN 'other_low_cost'
    WHEN mean_price >= hi THEN 'other_luxury' ELSE 'other_standard' END END AS tier FROM k, z)
  SELECT url, coalesce(tier, brand) AS brand, coalesce(tier, model) AS model FROM r""", "url brand model"))
def _(t: Tables):
    spread = t.listings.select(
        "url", "brand", "model", (F.col("price") * F.substring("brand", 7, 9).cast("int")).alias("price"))
    return q.group_mid_frequency(spread, "brand", "model", "price", 2000, 2500).select("url", "brand", "model")


@query("j10_threshold_sweep", sql("""
  WITH c AS (SELECT brand, count(*) AS n FROM l GROUP BY 1), k AS (SELECT unnest([2000, 2200, 2400, 2600]) AS threshold)
  SELECT threshold, count(*) FILTER (n >= threshold) AS keys_kept, count(*) FILTER (n < threshold) AS keys_removed,
    CAST(coalesce(sum(n) FILTER (n >= threshold), 0) AS BIGINT) AS rows_kept,
    CAST(coalesce(sum(n) FILTER (n < threshold), 0) AS BIGINT) AS rows_lost FROM c, k GROUP BY 1""",
    "threshold keys_kept keys_removed rows_kept rows_lost"))
def _(t: Tables):
    return q.threshold_sweep(t.listings, "brand", [2000, 2200, 2400, 2600])


@query("j11_iqr_outliers", sql("""
  WITH z AS (SELECT quantile_cont(price, 0.25) a, quantile_cont(price, 0.75) b FROM l)
  SELECT url, price FROM l, z WHERE price < a - 0.3 * (b - a) OR price > b + 0.3 * (b - a)""", "url", "price"))
def _(t: Tables):
    return q.iqr_outliers(t.listings, "price", 0.3).select("url", "price")


def dedup_cte(name: str, source: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY index_date DESC, brand, price) AS rn
      FROM {source}) WHERE rn = 1)"""


def narrow(df):
    return df.select("url", "index_date", "brand", "price")


@query("j12_dedup_latest", sql(f"WITH {dedup_cte('x', 'l')} SELECT url, index_date, brand, price FROM x", "url index_date brand", "price"))
def _(t: Tables):
    return snapshots.dedup_latest(narrow(t.listings))


def two_snapshots(t: Tables):
    return {s: narrow(t.listings.where(F.col("snapshot") == s)) for s in ("F", "O")}


MERGED = f"""{dedup_cte('xf', "(SELECT * FROM l WHERE snapshot = 'F')")}, {dedup_cte('xo', "(SELECT * FROM l WHERE snapshot = 'O')")},
  mg AS (SELECT url, index_date, brand, price, snapshot FROM xo UNION ALL
         SELECT url, index_date, brand, price, snapshot FROM xf WHERE url NOT IN (SELECT url FROM xo))"""


@query("j13_merge_snapshots", sql(f"WITH {MERGED} SELECT * FROM mg", "url index_date brand snapshot", "price"))
def _(t: Tables):
    return snapshots.merge_snapshots({s: snapshots.dedup_latest(df) for s, df in two_snapshots(t).items()})


@query("j13_overlap_accounting", sql(f"""
  WITH {MERGED} SELECT (SELECT count(*) FROM xf) + (SELECT count(*) FROM xo) AS n_listed, count(*) AS n_union,
    (SELECT count(*) FROM xf) + (SELECT count(*) FROM xo) - count(*) AS n_overlap,
    count(*) FILTER (snapshot = 'F') AS "kept_F", count(*) FILTER (snapshot = 'O') AS "kept_O" FROM mg""",
    'n_listed n_union n_overlap "kept_F" "kept_O"'))
def _(t: Tables):
    return snapshots.overlap_accounting(two_snapshots(t))


@query("j14_near_dup_audit", sql("""
  WITH g AS (SELECT brand, variant, year, km, count(*) AS n, count(DISTINCT url) AS n_ids FROM l GROUP BY 1, 2, 3, 4)
  SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n_ids > 1) AS n_groups,
    CAST(sum(n) FILTER (n_ids > 1) AS BIGINT) AS rows_in_groups,
    CAST(sum(n) FILTER (n_ids > 1) - count(*) FILTER (n_ids > 1) AS BIGINT) AS redundant_rows,
    (sum(n) FILTER (n_ids > 1) - count(*) FILTER (n_ids > 1)) * 100.0 / sum(n) AS rate_pct FROM g""",
    "n_rows n_groups rows_in_groups redundant_rows", "rate_pct"))
def _(t: Tables):
    return q.near_dup_audit(t.listings, ["brand", "variant", "year", "km"], "url")


@query("j15_collapse_exact", sql("""
  SELECT brand, variant, year, km, url FROM (SELECT *, row_number() OVER (PARTITION BY brand, variant, year, km ORDER BY url) rn FROM l)
  WHERE rn = 1""", "brand variant year url", "km"))
def _(t: Tables):
    slim = t.listings.select("brand", "variant", "year", "km", "url")
    return snapshots.collapse_exact(slim, ["brand", "variant", "year", "km"])


@query("j16_pair_drift", sql(f"""
  WITH {SNAPSHOT_PAIR}, x AS (SELECT (b.price - a.price) / a.price * 100 AS pct FROM a JOIN b USING (url))
  SELECT count(*) AS n, avg(CAST(abs(pct) > 1e-9 AS INT)) * 100 AS changed_pct, avg(CAST(pct < -1e-9 AS INT)) * 100 AS decreased_pct,
    avg(CAST(pct > 1e-9 AS INT)) * 100 AS increased_pct, median(pct) AS median_pct, median(abs(pct)) AS median_abs_pct FROM x""",
    "n", "changed_pct decreased_pct increased_pct median_pct median_abs_pct"))
def _(t: Tables):
    return q.pair_drift(pair_snapshots(*snapshot_pair(t), "url", "price"))


SEGMENTS = f"""sg AS (SELECT snapshot, brand, {BUCKET} AS age_bucket, median(price) AS med, count(*) AS n FROM l
    WHERE {BUCKET} IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 30),
  dr AS (SELECT a.brand, a.age_bucket, a.n AS n_a, b.n AS n_b, a.med AS median_a, b.med AS median_b,
    (b.med - a.med) / a.med * 100 AS drift_pct FROM sg a JOIN sg b ON a.brand = b.brand AND a.age_bucket = b.age_bucket
    WHERE a.snapshot = 'F' AND b.snapshot = 'O')"""


def drift(t: Tables):
    label, _ = age_bucket("car_age")
    rows = t.aged.withColumn("age_bucket", label).where("age_bucket is not null")
    old, new = (rows.where(F.col("snapshot") == s) for s in ("F", "O"))
    return q.segment_drift(old, new, ["brand", "age_bucket"], "price", 30)


@query("j17_segment_drift", sql(f"WITH {SEGMENTS} SELECT * FROM dr", "brand age_bucket n_a n_b", "median_a median_b drift_pct"))
def _(t: Tables):
    return drift(t)


@query("j17_drift_by_bucket", sql(
    f"WITH {SEGMENTS} SELECT age_bucket, count(*) AS n_segments, median(drift_pct) AS median_drift_pct FROM dr GROUP BY 1",
    "age_bucket n_segments", "median_drift_pct"))
def _(t: Tables):
    return q.drift_by(drift(t), "age_bucket")


def flagged(t: Tables):
    label, _ = age_bucket("car_age")
    rows = q.prepare_fences(t.aged.withColumn("age_bucket", label))
    return q.iqr_flag(rows, ["brand"], FENCES)


FLAGGED = f"WITH {PLAIN_FENCES}, fl AS (SELECT *, {BUCKET} AS age_bucket, {outside(str(MULT))} AS is_out FROM l JOIN f USING (brand))"


@query("j18_drop_rate_by_year", sql(f"""
  {FLAGGED} SELECT year, count(*) AS n_total, count(*) FILTER (is_out) AS n_flagged, count(*) FILTER (is_out) * 100.0 / count(*) AS pct
  FROM fl GROUP BY 1""", "year n_total n_flagged", "pct"))
def _(t: Tables):
    return q.drop_rate_audit(flagged(t), ["year"])


@query("j18_drop_rate_pivot", sql(f"""
  {FLAGGED}, top AS (SELECT brand FROM l GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 10)
  SELECT brand, avg(is_out::INT) FILTER (age_bucket = '0-2') * 100 AS "0-2", avg(is_out::INT) FILTER (age_bucket = '3-5') * 100 AS "3-5",
    avg(is_out::INT) FILTER (age_bucket = '6-10') * 100 AS "6-10" FROM fl WHERE brand IN (FROM top) GROUP BY 1""",
    "brand", '"0-2" "3-5" "6-10"'))
def _(t: Tables):
    return q.drop_rate_pivot(keep_top_groups(flagged(t), "brand", 10), "brand", "age_bucket", ["0-2", "3-5", "6-10"])


@query("j18_compare_drop_rates", sql(f"""
  {FLAGGED}, {pooled_ctes('l', DIRECT, POOL)},
  nw AS (SELECT url, brand, year, price, km, source = 'no_bound' OR NOT ({INSIDE}) AS is_new_out FROM p JOIN b USING (brand, year)),
  o AS (SELECT year, count(*) AS n_total, avg(is_out::INT) * 100 AS old_pct FROM fl GROUP BY 1),
  w AS (SELECT year, avg(is_new_out::INT) * 100 AS new_pct FROM nw GROUP BY 1)
  SELECT year, n_total, old_pct, new_pct, new_pct - old_pct AS change_points FROM o JOIN w USING (year)""",
    "year n_total", "old_pct new_pct change_points"))
def _(t: Tables):
    both = q.iqr_flag_pooled(flagged(t), "brand", "year", FENCES, DIRECT, POOL, flag="is_new_outlier")
    return q.compare_drop_rates(both, ["year"], "is_iqr_outlier", "is_new_outlier")


@query("j19_key_audit", sql("""
  WITH c AS (SELECT brand, variant, count(*) AS n FROM l GROUP BY 1, 2),
  k AS (SELECT a.brand, count(*) AS n_lookalikes FROM c a JOIN c b ON a.brand = b.brand AND a.variant < b.variant
    AND substr(a.variant, 1, 3) = substr(b.variant, 1, 3) AND abs(length(a.variant) - length(b.variant)) <= 2 GROUP BY 1)
  SELECT brand, count(*) AS n_models, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (length(variant) < 9) AS n_short,
    coalesce(max(n_lookalikes), 0) AS n_lookalikes FROM c LEFT JOIN k USING (brand) GROUP BY 1""",
    "brand n_models n_single n_short n_lookalikes"))
def _(t: Tables):
    return q.key_audit(t.listings, "brand", "variant", 9)


@query("j20_snapshot_profile", sql("""
  SELECT snapshot, count(*) AS n_rows, count(DISTINCT url) AS n_unique, count(*) - count(DISTINCT url) AS n_duplicate FROM l GROUP BY 1""",
    "snapshot n_rows n_unique n_duplicate"))
def _(t: Tables):
    return snapshots.snapshot_profile(two_snapshots(t))


@query("j21_combinations", sql("SELECT brand, variant, count(*) AS n FROM l GROUP BY 1, 2", "brand variant n"))
def _(t: Tables):
    counts = count_by(t.listings, ["brand", "variant"])
    return counts.join(combinations(t.listings, ["brand", "variant"]), ["brand", "variant"], "left_semi")


@query("j13_merge_report_drift", sql(f"""
  WITH {dedup_cte('xf', "(SELECT * FROM l WHERE snapshot = 'F')")}, {dedup_cte('xo', "(SELECT * FROM l WHERE snapshot = 'O')")},
  sa AS (SELECT brand, median(price) med, count(*) n FROM xf GROUP BY 1 HAVING count(*) >= 30),
  sb AS (SELECT brand, median(price) med, count(*) n FROM xo GROUP BY 1 HAVING count(*) >= 30)
  SELECT brand, sa.n AS n_a, sb.n AS n_b, sa.med AS median_a, sb.med AS median_b, (sb.med - sa.med) / sa.med * 100 AS drift_pct
  FROM sa JOIN sb USING (brand)""", "brand n_a n_b", "median_a median_b drift_pct"))
def _(t: Tables):
    old, new = two_snapshots(t).values()
    return snapshots.merge_report(old, new, "url", ["brand", "price"], ["brand"], "price")["segment_drift"]

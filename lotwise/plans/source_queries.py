"""Queries over sources, projections and filters (inventory A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.features import car_age, decade
from lotwise.functions.parse import parse_hp, parse_km, parse_money, try_num
from lotwise.operators import rows
from lotwise.operators.stats import n_rows
from lotwise.plans.catalog import NOW, Tables, query, sql
from lotwise.plans.cleaning import stage_counts, with_stats
from lotwise.scale import scratch_path
from lotwise.sources import files

TYPED = sql("SELECT url, price, year, km, horsepower, brand FROM l", "url brand", "price year km horsepower")


def typed(raw):
    return raw.select(
        "url", parse_money("price").alias("price"), try_num("annee_modele").alias("year"),
        parse_km("kilometrage").alias("km"), parse_hp("puissance_din").alias("horsepower"),
        F.col("marque").alias("brand"),
    )


@query("a1_read_listings", TYPED)
def _(t: Tables):
    path = files.write_csv(t.raw_listings, scratch_path(t.spark, "a1"))
    return typed(files.read_listings(t.spark, path))


@query("a2_read_with_rejects", sql(
    "SELECT CASE WHEN flag = 'A' THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM l GROUP BY 1", "kind n"))
def _(t: Tables):
    short, full = ["url", "brand"], ["url", "brand", "model"]
    line = F.when(F.col("flag") == "A", F.concat_ws(",", *short)).otherwise(F.concat_ws(",", *full))
    path = scratch_path(t.spark, "a2")
    t.listings.select(line.alias("value")).write.text(path)
    good, bad = files.read_with_rejects(t.spark, path, full, header=False)
    return good.agg(F.lit("good").alias("kind"), n_rows()).unionByName(bad.agg(F.lit("bad").alias("kind"), n_rows()))


@query("a3_read_validated", sql("""
  SELECT brand AS item, count(*) AS n FROM l WHERE flag <> 'R' GROUP BY brand
  UNION ALL SELECT 'skipped: missing: price', 1""", "item n"))
def _(t: Tables):
    path = scratch_path(t.spark, "a3")
    for flag, columns in (("A", ["url", "brand", "price"]), ("N", ["price", "brand", "model", "url"]), ("R", ["url", "brand"])):
        t.listings.where(F.col("flag") == flag).select(*columns).write.mode("append").option("header", True).csv(path)
    good, skipped = files.read_validated(t.spark, path, ["url", "brand", "price"])
    reasons = skipped.select(F.concat(F.lit("skipped: "), "reason").alias("item")).distinct().withColumn("n", F.lit(1).cast("bigint"))
    return good.groupBy(F.col("brand").alias("item")).agg(n_rows()).unionByName(reasons)


@query("a4_read_ragged", sql("SELECT url, brand FROM l", "url brand"))
def _(t: Tables):
    extra = F.when(F.col("flag") == "A", F.concat_ws(",", "url", "brand", "model", "flag")).otherwise(F.concat_ws(",", "url", "brand"))
    path = scratch_path(t.spark, "a4")
    t.listings.select(extra.alias("value")).write.text(path)
    return files.read_ragged(t.spark, path, ["url", "brand"], header=False)


@query("a5_read_parquet", sql(
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 10",
    "l_orderkey l_linenumber", "l_extendedprice"))
def _(t: Tables):
    return t("lineitem").where("l_quantity < 10").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("a6_write_versioned", sql("SELECT snapshot, brand, count(*) AS n FROM l GROUP BY 1, 2", "snapshot brand n"))
def _(t: Tables):
    path = files.write_versioned(t.listings, scratch_path(t.spark, "a6"), "v1", ["snapshot"])
    return t.spark.read.parquet(path).groupBy("snapshot", "brand").agg(n_rows())


@query("a7_write_csv", sql("SELECT brand, year, count(*) AS n FROM l GROUP BY 1, 2", "brand year n"))
def _(t: Tables):
    report = t.listings.groupBy("brand", "year").agg(n_rows())
    path = files.write_csv(report, scratch_path(t.spark, "a7"))
    return t.spark.read.schema("brand string, year int, n bigint").option("header", True).csv(path)


@query("a8_write_metrics", sql(
    "SELECT 'run1' AS run, flag, count(*) AS n, avg(price) AS mean_price FROM l GROUP BY flag", "run flag n", "mean_price"))
def _(t: Tables):
    report = t.listings.groupBy("flag").agg(n_rows(), F.avg("price").alias("mean_price"))
    path = files.write_metrics(report, scratch_path(t.spark, "a8"), run="run1")
    return t.spark.read.schema("run string, flag string, n bigint, mean_price double").json(path)


@query("a9_tag_snapshot", sql("SELECT url, 'dec_2025' AS snapshot FROM l", "url snapshot"))
def _(t: Tables):
    return files.tag_snapshot(t.listings.select("url"), "dec_2025")


@query("a10_union_all", sql(
    "SELECT url, brand FROM l WHERE flag = 'A' UNION ALL SELECT url, brand FROM l WHERE flag = 'N'", "url brand"))
def _(t: Tables):
    return files.union_all(t.second_market.select("url", "brand"), t.market.select("brand", "url"))


@query("a11_add_block", sql(
    "SELECT url, 2003 - year AS car_age, CAST(floor(year / 10) * 10 AS INT) AS decade FROM l", "url car_age decade"))
def _(t: Tables):
    block = [car_age("year", NOW).alias("car_age"), decade("year").alias("decade")]
    return files.add_block(t.listings.select("url", "year"), block).drop("year")


@query("a12_drop_header_rows", sql("""
  SELECT flag AS price, count(*) AS n FROM l WHERE flag <> 'R' GROUP BY 1""", "price n"))
def _(t: Tables):
    texts = t.listings.select(F.when(F.col("flag") == "R", "price").otherwise(F.col("flag")).alias("price"))
    return files.drop_header_rows(texts, "price").groupBy("price").agg(n_rows())


@query("a13_vocabulary", sql("SELECT DISTINCT brand FROM l", "brand"))
def _(t: Tables):
    path = files.save_vocabulary(t.listings, "brand", scratch_path(t.spark, "a13"))
    return files.load_vocabulary(t.spark, path, "brand")


@query("a14_with_stats", sql("""
  SELECT 0 AS step, 'all' AS stage, count(*) AS n_rows FROM l
  UNION ALL SELECT 1, 'priced', count(*) FROM l WHERE price >= 5000
  UNION ALL SELECT 2, 'recent', count(*) FROM l WHERE price >= 5000 AND year >= 1998""", "step stage n_rows"))
def _(t: Tables):
    stages = {"all": t.listings}
    stages["priced"] = rows.bound(stages["all"], "price", 5000)
    stages["recent"] = rows.min_year(stages["priced"], 1998)
    return stage_counts(stages)


@query("a14_observed_rows", sql("SELECT count(*) AS n_observed, count(DISTINCT flag) AS n_flags FROM l", "n_observed n_flags"))
def _(t: Tables):
    """What the observation saw while the rows went by on their way to a count per flag."""
    watched, seen = with_stats(t.listings, "listings")
    flags = watched.groupBy("flag").agg(n_rows()).count()
    return t.spark.range(1).select(
        F.lit(seen.get["n"]).cast("bigint").alias("n_observed"), F.lit(flags).cast("bigint").alias("n_flags"))


@query("a15_resolve_columns", sql("SELECT url, brand, price FROM l", "url brand", "price"))
def _(t: Tables):
    foreign = t.listings.select("url", F.col("brand").alias("marque"), F.col("price").alias("prix"))
    return files.resolve_columns(foreign, {"url": (), "brand": ("marque",), "price": ("cost", "prix")})


@query("b1_to_canonical", sql(
    "SELECT price, CAST(year AS DOUBLE) AS year, km, brand FROM l", "brand", "price year km"))
def _(t: Tables):
    return rows.to_canonical(t.raw_listings, {
        "price": parse_money("price"), "year": try_num("annee_modele"), "km": parse_km("kilometrage"), "brand": "marque"})


@query("b2_require_target", sql("SELECT url, price FROM l WHERE flag <> 'A'", "url", "price"))
def _(t: Tables):
    gappy = t.listings.select("url", F.when(F.col("flag") != "A", F.col("price")).alias("price"))
    return rows.require_target(gappy)


@query("b3_bound", sql("SELECT url, price FROM l WHERE price BETWEEN 5000 AND 60000", "url", "price"))
def _(t: Tables):
    return rows.bound(t.listings, "price", 5000, 60000).select("url", "price")


@query("b3_bound_counts", sql("""
  SELECT count(*) AS n_before, count(*) FILTER (price < 5000) AS n_below, count(*) FILTER (price > 60000) AS n_above,
         CAST(0 AS BIGINT) AS n_null, count(*) FILTER (price BETWEEN 5000 AND 60000) AS n_after FROM l""",
    "n_before n_below n_above n_null n_after"))
def _(t: Tables):
    return rows.bound_counts(t.listings, "price", 5000, 60000)


@query("b4_min_year", sql("SELECT url, year FROM l WHERE year >= 1998", "url year"))
def _(t: Tables):
    return rows.min_year(t.listings, 1998).select("url", "year")


@query("b5_max_age", sql("SELECT url, year FROM l WHERE 2003 - year <= 5", "url year"))
def _(t: Tables):
    return rows.max_age(t.listings, 5, NOW).select("url", "year")


@query("b6_drop_placeholder", sql("""
  SELECT url, brand, model FROM l WHERE lower(brand) <> 'brand#7' AND lower(model) <> 'brand#7' AND lower(model) <> 'promo'""",
    "url brand model"))
def _(t: Tables):
    kept = rows.drop_placeholder(t.listings, ["brand", "model"], "BRAND#7")
    return rows.drop_placeholder(kept, ["model"], "promo").select("url", "brand", "model")


@query("b7_horsepower_bounds", sql("SELECT url, horsepower FROM l WHERE horsepower BETWEEN 50 AND 1000", "url", "horsepower"))
def _(t: Tables):
    return rows.bound(t.listings, "horsepower", 50, 1000).select("url", "horsepower")


@query("b8_bound_keep_null", sql("""
  SELECT url, CASE WHEN flag <> 'A' THEN horsepower END AS horsepower FROM l
  WHERE flag = 'A' OR horsepower BETWEEN 50 AND 1000""", "url", "horsepower"))
def _(t: Tables):
    gappy = t.listings.select("url", F.when(F.col("flag") != "A", F.col("horsepower")).alias("horsepower"))
    return rows.bound(gappy, "horsepower", 50, 1000, keep_null=True)


@query("b9_keep_in", sql("SELECT url, brand FROM l WHERE brand IN (SELECT p_brand FROM part WHERE p_retailprice < 901)", "url brand"))
def _(t: Tables):
    listed = t("part").where("p_retailprice < 901").select(F.col("p_brand").alias("brand"))
    return rows.keep_in(t.listings, "brand", listed).select("url", "brand")


@query("b10_drop_in", sql("SELECT url, brand FROM l WHERE brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice < 901)", "url brand"))
def _(t: Tables):
    listed = t("part").where("p_retailprice < 901").select(F.col("p_brand").alias("brand"))
    return rows.drop_in(t.listings, "brand", listed).select("url", "brand")


@query("b11_valid_rows", sql("""
  SELECT url, price - 20000 AS price, km FROM l WHERE price - 20000 > 0 AND km >= 0""", "url", "price km"))
def _(t: Tables):
    moved = t.listings.withColumn("price", F.col("price") - 20000)
    return moved.where(rows.valid_rows()).select("url", "price", "km")


@query("b12_complete_cases", sql("SELECT url FROM l WHERE flag <> 'A' AND horsepower >= 100", "url"))
def _(t: Tables):
    gappy = t.listings.select(
        "url", F.when(F.col("flag") != "A", F.col("price")).alias("price"),
        F.when(F.col("horsepower") >= 100, F.col("horsepower")).alias("horsepower"))
    return rows.complete_cases(gappy, ["price", "horsepower"]).select("url")


@query("b13_without_text", sql("SELECT url, variant FROM l WHERE variant NOT LIKE '%red%'", "url variant"))
def _(t: Tables):
    return rows.without_text(t.listings, "variant", "red").select("url", "variant")


@query("b14_is_between", sql("SELECT url, CAST(price BETWEEN 10000 AND km AS INT) AS inside FROM l", "url inside"))
def _(t: Tables):
    return t.listings.select("url", rows.is_between("price", 10000, "km").cast("int").alias("inside"))


@query("b15_align", sql("SELECT url, km, 0.0 AS missing, price FROM l", "url", "km missing price"))
def _(t: Tables):
    return rows.align(t.listings, ["km", "missing", "price"], keep=["url"])


@query("b16_drop_existing", sql("SELECT url, brand, model FROM l", "url brand model"))
def _(t: Tables):
    return rows.drop_existing(t.listings.select("url", "brand", "model", "price"), ["price", "no_such_column"])


@query("b18_spot_filters", sql("""
  SELECT 'expensive' AS kind, count(*) AS n FROM l WHERE price > 100000
  UNION ALL SELECT 'short', count(*) FROM l WHERE length(trim(variant)) < 9
  UNION ALL SELECT 'single', count(*) FROM (SELECT brand, variant, year, model, seller FROM l GROUP BY ALL HAVING count(*) = 1)""", "kind n"))
def _(t: Tables):
    found = {
        "expensive": t.listings.where("price > 100000"), "short": rows.short_names(t.listings, "variant", 9),
        "single": rows.singletons(t.listings, ["brand", "variant", "year", "model", "seller"]),
    }
    return files.union_all(*[df.agg(F.lit(k).alias("kind"), n_rows()) for k, df in found.items()])

"""Queries over encoders, models, intervals and calibration (inventory K, L and Q)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotwise.config import EncoderConfig, LEAN_FEATURES
from lotwise.functions.features import car_age, plausible_km, power_ratios
from lotwise.learning import boost, encode as en, evaluate as ev, hist
from lotwise.operators import intervals as iv, quality, stats
from lotwise.operators.metrics import coverage
from lotwise.operators.quantiles import rollup_quantiles
from lotwise.plans.catalog import NOW, Tables, query, sql
from lotwise.plans.metric_queries import SCORED, scored
from lotwise.scale import scratch_path, settle
from lotwise.sources.files import union_all

MIN = 12
CONFIG = EncoderConfig(current_year=NOW, min_samples=MIN, model_key=("brand", "model"), horsepower=True, fuel_onehot=True)
FEATURES = ("car_age", "km", "horsepower", "brand_mean_log_price", "model_mean_log_price", "model_iqr_log_price")
# Rounds of boosting where the query is about something else than their number.
ROUNDS = 30


def with_variant(df):
    """Finer models: the part name stands for the model."""
    return df.withColumn("model", F.col("variant")).withColumn("car_age", car_age("year", NOW))


def train_rows(t: Tables):
    return with_variant(t.market)


def unseen(df):
    """Some scored rows get a brand, others a variant, that no training row has."""
    new_brand = F.when(F.col("discount") == 0, "Brand#new").otherwise(F.col("brand"))
    new_variant = F.when(F.col("discount") == 0.01, "zz new").otherwise(F.col("variant"))
    return df.withColumns({"brand": new_brand, "variant": new_variant})


def test_rows(t: Tables):
    return with_variant(unseen(t.declared))


UNSEEN = """u AS (SELECT * REPLACE (CASE WHEN discount = 0 THEN 'Brand#new' ELSE brand END AS brand,
  CASE WHEN discount = 0.01::DOUBLE THEN 'zz new' ELSE variant END AS variant) FROM d)"""
TRAIN = f"WITH {UNSEEN}, tr AS (SELECT * REPLACE (variant AS model), ln(price) AS lp FROM m)"


def entity_sql(prefix: str, keys: str) -> str:
    """State of one kind of entity, as SQL over tr."""
    e, logs = prefix, ("mean", "median", "std", "p25", "p75", "p90")
    kept = ", ".join(f"CASE WHEN n >= {MIN} THEN {s} END AS {e}_{s}_log_price" for s in logs)
    return f"""{e}0 AS (SELECT {keys}, count(*) AS n, avg(km) AS avg_km, median(km) AS median_km, avg(car_age) AS avg_age,
      median(car_age) AS median_age, avg(lp) AS mean, median(lp) AS median, stddev_pop(lp) AS std, quantile_cont(lp, 0.25) AS p25,
      quantile_cont(lp, 0.75) AS p75, quantile_cont(lp, 0.9) AS p90 FROM tr GROUP BY {keys}),
    {e}q AS (SELECT quantile_cont(median, 0.25) q25, quantile_cont(median, 0.75) q75, quantile_cont(median, 0.95) q95 FROM {e}0 WHERE n >= {MIN}),
    {e}s AS (SELECT {keys}, n AS {e}_count, avg_km AS {e}_avg_km, median_km AS {e}_median_km, avg_age AS {e}_avg_age, median_age AS {e}_median_age,
      {kept}, CASE WHEN n >= {MIN} THEN p75 - p25 END AS {e}_iqr_log_price, CASE WHEN n >= {MIN} THEN CAST(median >= q75 AS INT) END AS {e}_top25_price,
      CASE WHEN n >= {MIN} THEN CAST(median <= q25 AS INT) END AS {e}_bottom25_price,
      CASE WHEN n >= {MIN} THEN CAST(median >= q95 AS INT) END AS {e}_top5_price FROM {e}0, {e}q)"""


STATE = f"""{TRAIN}, {entity_sql('brand', 'brand')}, {entity_sql('model', 'brand, model')},
  rk AS (SELECT brand, model, CAST(dense_rank() OVER (PARTITION BY brand ORDER BY median) AS INT) AS model_rank_within_brand
         FROM model0 WHERE n >= {MIN}),
  g AS (SELECT avg(lp) AS gm, median(lp) AS gd, stddev_pop(lp) AS gs, avg(km) AS gk, avg(car_age) AS ga, quantile_cont(km, 0.25) k25,
        quantile_cont(km, 0.5) k50, quantile_cont(km, 0.75) k75, quantile_cont(km, 0.9) k90 FROM tr)"""
BRAND_STATE = ("brand_count brand_top25_price brand_bottom25_price brand_top5_price",
               "brand_avg_km brand_median_km brand_avg_age brand_median_age brand_mean_log_price brand_median_log_price "
               "brand_std_log_price brand_p25_log_price brand_p75_log_price brand_p90_log_price brand_iqr_log_price")


@query("k1_encoder_state", sql(f"{STATE} SELECT * FROM brands", f"brand {BRAND_STATE[0]}", BRAND_STATE[1]))
def _(t: Tables):
    return en.PriceEncoder(CONFIG).fit(train_rows(t)).state["brands"]


FILLED = ", ".join(
    [f"coalesce({e}_{s}_log_price, {x}) AS {e}_{s}_log_price" for e in ("brand", "model") for s, x in (
        ("mean", "gm"), ("median", "gd"), ("std", "gs"), ("p25", "gm - 0.674 * gs"), ("p75", "gm + 0.674 * gs"),
        ("p90", "gm + 1.282 * gs"), ("iqr", "1.349 * gs"))]
    + [f"coalesce({e}_{f}_price, 0) AS {e}_{f}_price" for e in ("brand", "model") for f in ("top25", "bottom25", "top5")])
ENCODED_DOUBLES = " ".join(f"{e}_{s}_log_price" for e in ("brand", "model") for s in ("mean", "median", "std", "p25", "p75", "p90", "iqr"))
ENCODED_FLAGS = " ".join(f"{e}_{f}_price" for e in ("brand", "model") for f in ("top25", "bottom25", "top5"))


@query("k2_encoder_transform", sql(f"""
  {STATE} SELECT url, d.brand, coalesce(model_count, 0) AS model_count, coalesce(model_rank_within_brand, 0) AS model_rank_within_brand, {FILLED},
    coalesce(brand_avg_km, gk) AS brand_avg_km, coalesce(brand_median_km, gk) AS brand_median_km, coalesce(brand_avg_age, ga) AS brand_avg_age,
    coalesce(brand_median_age, ga) AS brand_median_age, coalesce(model_count, 0) / coalesce(brand_count, 1) AS model_popularity_ratio,
    CASE WHEN car_age > 0 THEN km / car_age ELSE km END AS km_per_year, ln(km + 1) AS log_km, sqrt(car_age) AS sqrt_age,
    CASE WHEN km < k25 THEN 'very_low' WHEN km < k50 THEN 'low' WHEN km < k75 THEN 'medium' WHEN km < k90 THEN 'high' ELSE 'very_high' END AS mileage_category
  FROM u AS d CROSS JOIN g LEFT JOIN brands ON brands.brand = d.brand LEFT JOIN models ON models.brand = d.brand AND models.model = d.variant
  LEFT JOIN rk ON rk.brand = d.brand AND rk.model = d.variant""",
    f"url brand model_count model_rank_within_brand mileage_category {ENCODED_FLAGS}",
    f"{ENCODED_DOUBLES} brand_avg_km brand_median_km brand_avg_age brand_median_age model_popularity_ratio km_per_year log_km sqrt_age"))
def _(t: Tables):
    out = en.PriceEncoder(CONFIG).fit(train_rows(t)).transform(test_rows(t))
    return out.select(
        "url", "brand", "model_count", "model_rank_within_brand", "mileage_category", *ENCODED_FLAGS.split(), *ENCODED_DOUBLES.split(),
        "brand_avg_km", "brand_median_km", "brand_avg_age", "brand_median_age", "model_popularity_ratio", "km_per_year", "log_km", "sqrt_age")


@query("k3_global_stats", sql(f"""
  {TRAIN} SELECT avg(lp) AS global_mean, median(lp) AS global_median, stddev_pop(lp) AS global_std, avg(km) AS global_km_mean,
    avg(car_age) AS global_age_mean FROM tr""", "", "global_mean global_median global_std global_km_mean global_age_mean"))
def _(t: Tables):
    return en.global_stats(train_rows(t))


@query("k4_km_percentiles", sql(f"""
  {TRAIN} SELECT quantile_cont(km, 0.25) AS km_p25, median(km) AS km_p50, quantile_cont(km, 0.75) AS km_p75, quantile_cont(km, 0.9) AS km_p90 FROM tr""",
    "", "km_p25 km_p50 km_p75 km_p90"))
def _(t: Tables):
    return en.km_percentiles(train_rows(t))


@query("k5_entity_stats", sql(f"""
  {TRAIN} SELECT brand, count(*) AS n, avg(km) AS avg_km, median(km) AS median_km, avg(car_age) AS avg_age, median(car_age) AS median_age
  FROM tr GROUP BY 1""", "brand n", "avg_km median_km avg_age median_age"))
def _(t: Tables):
    return en.entity_stats(train_rows(t), "brand")


def encoding_sql(keys: str) -> str:
    return f"""{TRAIN} SELECT {keys}, count(*) AS n, avg(lp) AS mean_log_price, median(lp) AS median_log_price, stddev_pop(lp) AS std_log_price
      FROM tr GROUP BY {keys} HAVING count(*) >= {MIN}"""


@query("k6_brand_target_encoding", sql(encoding_sql("brand"), "brand n", "mean_log_price median_log_price std_log_price"))
def _(t: Tables):
    return en.target_encoding(train_rows(t), "brand", min_samples=MIN)


@query("k7_popularity", sql(f"""
  {TRAIN}, a AS (SELECT model, count(*) AS model_count FROM tr GROUP BY 1), b AS (SELECT brand, count(*) AS n FROM tr GROUP BY 1)
  SELECT DISTINCT brand, model, model_count, model_count / n AS model_popularity_ratio FROM tr JOIN a USING (model) JOIN b USING (brand)""",
    "brand model model_count", "model_popularity_ratio"))
def _(t: Tables):
    return en.popularity(train_rows(t))


@query("k8_model_target_encoding", sql(encoding_sql("brand, model"), "brand model n", "mean_log_price median_log_price std_log_price"))
def _(t: Tables):
    return en.target_encoding(train_rows(t), ["brand", "model"], min_samples=MIN)


@query("k9_quantile_flags", sql(f"""
  {STATE} SELECT brand, model, model_median_log_price AS median_log_price, model_top25_price AS entity_top25_price,
    model_bottom25_price AS entity_bottom25_price, model_top5_price AS entity_top5_price FROM models WHERE model_median_log_price IS NOT NULL""",
    "brand model entity_top25_price entity_bottom25_price entity_top5_price", "median_log_price"))
def _(t: Tables):
    return en.quantile_flags(train_rows(t), ["brand", "model"], min_samples=MIN)


@query("k10_model_rank", sql(f"{STATE} SELECT * FROM rk", "brand model model_rank_within_brand"))
def _(t: Tables):
    return en.model_rank(train_rows(t), min_samples=MIN)


@query("k11_distribution_features", sql(f"""
  {TRAIN} SELECT brand, count(*) AS n, quantile_cont(lp, 0.25) AS p25, quantile_cont(lp, 0.75) AS p75, quantile_cont(lp, 0.9) AS p90,
    quantile_cont(lp, 0.75) - quantile_cont(lp, 0.25) AS iqr FROM tr GROUP BY 1 HAVING count(*) >= 800""", "brand n", "p25 p75 p90 iqr"))
def _(t: Tables):
    return en.distribution_features(train_rows(t), "brand", min_samples=800)


BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))


@query("k12_brand_onehot", sql(
    "SELECT url, " + ", ".join(f"""CAST(brand = '{b}' AS INT) AS "ohe_{b}\"""" for b in BRANDS[1:]) + f" FROM (WITH {UNSEEN} SELECT * FROM u)",
    ["url", *[f'"ohe_{b}"' for b in BRANDS[1:]]]))
def _(t: Tables):
    onehot = en.OneHot("brand", "ohe", drop_input=True).fit(t.market)
    return onehot.transform(unseen(t.declared)).select("url", *[f"`{c}`" for c in onehot.columns])


@query("k13_sparse_onehot", sql(f"""
  WITH {UNSEEN}, v AS (SELECT DISTINCT variant FROM m)
  SELECT url, variant AS model, CAST(variant IN (SELECT variant FROM v WHERE variant <> (SELECT min(variant) FROM v)) AS INT) AS hits FROM u""",
    "url model", "hits"))
def _(t: Tables):
    train = train_rows(t)
    encoded = en.sparse_onehot("model", "vector", train).fit(train).transform(test_rows(t))
    return encoded.select("url", "model", F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda a, x: a + x).alias("hits"))


@query("k14_fuel_onehot", sql("""
  SELECT url, CAST(energie = 'Essence' AS INT) AS "energie_Essence", CAST(energie = 'Hybride essence' AS INT) AS "energie_Hybride essence" FROM l""",
    ["url", '"energie_Essence"', '"energie_Hybride essence"']))
def _(t: Tables):
    onehot = en.OneHot("energie").fit(t.listings)
    return onehot.transform(t.listings).select("url", *onehot.columns)


@query("k15_standardize", sql("""
  SELECT url, price, (km - (SELECT avg(km) FROM m)) / (SELECT stddev_pop(km) FROM m) AS km,
    (horsepower - (SELECT avg(horsepower) FROM m)) / (SELECT stddev_pop(horsepower) FROM m) AS horsepower FROM d""", "url", "price km horsepower"))
def _(t: Tables):
    columns = ["url", "price", "km", "horsepower"]
    return en.Standardize().fit(t.market.select(*columns)).transform(t.declared.select(*columns))


@query("k16_cv_encoder", sql(f"""
  WITH {UNSEEN}, a AS (SELECT brand, stddev_samp(price) / (avg(price) + 1) AS c FROM m GROUP BY 1),
  b AS (SELECT variant AS model, stddev_samp(price) / (avg(price) + 1) AS c FROM m GROUP BY 1)
  SELECT url, coalesce(a.c, 0) AS brand_price_cv, coalesce(b.c, 0) AS model_price_cv FROM u AS d LEFT JOIN a ON a.brand = d.brand LEFT JOIN b ON b.model = d.variant""",
    "url", "brand_price_cv model_price_cv"))
def _(t: Tables):
    out = en.CvEncoder().fit(train_rows(t)).transform(test_rows(t))
    return out.select("url", "brand_price_cv", "model_price_cv")


@query("k19_lean_matrix", sql(f"""
  {STATE} SELECT url, d.year AS y, coalesce(brand_mean_log_price, gm) AS brand_mean_log_price, coalesce(model_rank_within_brand, 0) AS model_rank_within_brand,
    pow(car_age, 3) AS age_cubed, CAST(d.year >= 2002 AS INT) AS is_almost_new, coalesce(model_iqr_log_price, 1.349 * gs) AS model_iqr_log_price
  FROM u AS d CROSS JOIN g LEFT JOIN brands ON brands.brand = d.brand LEFT JOIN models ON models.brand = d.brand AND models.model = d.variant
  LEFT JOIN rk ON rk.brand = d.brand AND rk.model = d.variant""",
    "url", "brand_mean_log_price model_rank_within_brand age_cubed is_almost_new model_iqr_log_price"))
def _(t: Tables):
    encoded = en.PriceEncoder(CONFIG).fit(train_rows(t)).transform(test_rows(t))
    matrix = en.lean_matrix(encoded, LEAN_FEATURES, keep=["url"])
    return matrix.select("url", "brand_mean_log_price", "model_rank_within_brand", "age_cubed", "is_almost_new", "model_iqr_log_price")


@query("k20_category_codes", sql(f"""
  WITH {UNSEEN}, v AS (SELECT variant AS model, row_number() OVER (ORDER BY variant) - 1 AS code FROM (SELECT DISTINCT variant FROM m))
  SELECT url, coalesce(code, (SELECT count(*) FROM v)) AS model_code FROM u AS d LEFT JOIN v ON v.model = d.variant""", "url", "model_code"))
def _(t: Tables):
    train = train_rows(t)
    return en.CategoryCodes(["model"]).fit(train).transform(test_rows(t)).select("url", "model_code")


@query("k21_pipeline_saved", sql(f"""
  WITH {UNSEEN}, tr AS (SELECT * FROM m), a AS (SELECT brand, stddev_samp(price) / (avg(price) + 1) AS c FROM m GROUP BY 1)
  SELECT url, coalesce(a.c, 0) AS brand_price_cv, pow(horsepower, 3) AS hp_cubed, CAST(d.brand = 'Brand#11' AS INT) AS brand_11, TRUE AS same
  FROM u AS d LEFT JOIN a ON a.brand = d.brand""", "url brand_11 same", "brand_price_cv hp_cubed"))
def _(t: Tables):
    """The fitted pipeline, saved and loaded again, gives the same rows as before."""
    config = EncoderConfig(current_year=NOW, min_samples=MIN, horsepower=True, brand_onehot=True)
    fitted, path = en.expanded_pipeline(config).fit(train_rows(t)), scratch_path(t.spark, "pipeline")
    en.save_pipeline(fitted, t.spark, path)
    columns = ("brand_price_cv", "model_price_cv", "is_traditional_fuel_premium", "hp_cubed", "`ohe_brand_Brand#11`", "brand_mean_log_price")
    rows = test_rows(t)
    before = fitted.transform(rows).select(*rows.columns, F.struct(*columns).alias("before"))
    after = en.load_pipeline(t.spark, path).transform(before).withColumn("after", F.struct(*columns))
    return after.select(
        "url", F.col("after.ohe_brand_Brand#11").alias("brand_11"), F.col("after").eqNullSafe(F.col("before")).alias("same"),
        "after.brand_price_cv", "after.hp_cubed")


@query("k21_expanded_pipeline")
def _(t: Tables):
    config = EncoderConfig(current_year=NOW, min_samples=MIN, horsepower=True, brand_onehot=True)
    fitted = en.expanded_pipeline(config).fit(train_rows(t))
    out = fitted.transform(test_rows(t))
    return out.select("url", "brand_price_cv", "is_traditional_fuel_premium", "hp_cubed", "`ohe_brand_Brand#10`")


SPLIT = "CAST(('0x' || substr(md5(concat_ws('|', '{seed}', url)), 1, 8)) AS BIGINT) % {n}"


@query("l1_split", sql(f"SELECT url, CAST({SPLIT.format(seed=42, n=1000)} < 200 AS INT) AS is_test FROM l", "url is_test"))
def _(t: Tables):
    return ev.split(t.listings, ["url"]).select("url", F.col("is_test").cast("int").alias("is_test"))


@query("l2_with_fold", sql(f"SELECT url, CAST({SPLIT.format(seed=42, n=5)} AS INT) AS fold FROM l", "url fold"))
def _(t: Tables):
    return ev.with_fold(t.listings, ["url"]).select("url", "fold")


@query("l3_with_es_slice", sql(f"SELECT url, CAST({SPLIT.format(seed=43, n=1000)} < 100 AS INT) AS is_es FROM l", "url is_es"))
def _(t: Tables):
    return ev.with_es_slice(t.listings, ["url"]).select("url", F.col("is_es").cast("int").alias("is_es"))


def encoded_pair(t: Tables):
    """Encoded and assembled train and test rows."""
    encoder = en.PriceEncoder(CONFIG).fit(train_rows(t))
    prepare = lambda df: en.assemble(encoder.transform(df).withColumn("log_price", F.ln("price")), FEATURES)
    return prepare(train_rows(t)), prepare(test_rows(t))


@query("l4_linear_price")
def _(t: Tables):
    train, test = (df.drop("features") for df in encoded_pair(t))
    model = boost.linear_price(train, FEATURES)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(test)
    return model.transform(rows).select("url", F.exp("prediction").alias("predicted"))


@query("l5_boosted_price")
def _(t: Tables):
    train, test = (df.drop("features") for df in encoded_pair(t))
    model = boost.boosted_price(train, FEATURES, rounds=ROUNDS, depth=3)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(test)
    return model.transform(rows).select("url", F.exp("prediction").alias("predicted"))


@query("l6_quantile_boost")
def _(t: Tables):
    train, test = encoded_pair(t)
    model = boost.QuantileBoost(0.85, rounds=200, depth=3, step=0.1, exact=False).fit(train)
    return model.transform(test).select("url", F.exp("prediction").alias("q85"))


def stopped_early(train):
    """Up to 5,000 rounds, as long as the rows kept aside gain from them."""
    watched = ev.with_es_slice(train, ["url"])
    return boost.QuantileBoost(0.5, rounds=5000, depth=3, validation_col="is_es", patience=10).fit(watched)


@query("l7_early_stopping")
def _(t: Tables):
    train, test = encoded_pair(t)
    model = stopped_early(train)
    return model.transform(test).select("url", F.exp("prediction").alias("q50")).withColumn("rounds", F.lit(model.best_iteration))


def loss_check(name: str, model_loss, constant_sql: str, build):
    """A query whose SQL gives the loss of the best constant over all rows that the model learned from; the model's must
    be lower."""
    @query(name, sql(f"SELECT count(*) AS n, {constant_sql} AS constant_loss, TRUE AS better FROM m", "n better", "constant_loss"))
    def _(t: Tables):
        scored_rows, constant = build(t)
        one = scored_rows.agg(
            F.count("*").alias("n"), F.avg(model_loss(F.col("price"), F.lit(constant))).alias("constant_loss"),
            F.avg(model_loss(F.col("price"), F.col("predicted"))).alias("loss"))
        return one.select("n", "constant_loss", (F.col("loss") < F.col("constant_loss")).alias("better"))


def pinball(alpha: float):
    return lambda y, q: F.greatest((y - q) * alpha, (y - q) * (alpha - 1))


def pinball_sql(alpha: float) -> str:
    c = f"(SELECT quantile_cont(price, {alpha}::DOUBLE) FROM m)"
    return f"avg(greatest((price - {c}) * {alpha}::DOUBLE, (price - {c}) * ({alpha}::DOUBLE - 1)))"


def squared(y, prediction):
    return F.pow(F.ln(y) - F.ln(prediction), 2)


SQUARED_SQL = "avg(pow(ln(price) - (SELECT avg(ln(price)) FROM m), 2))"


def quantile_of(t: Tables, alpha: float) -> float:
    return iv.quantile_table(t.market, [], {"c": ("price", alpha)}).first().c


def log_mean(t: Tables) -> float:
    return t.market.agg(F.exp(F.avg(F.ln("price")))).first()[0]


def _linear(t: Tables):
    train, _ = encoded_pair(t)
    model = boost.linear_price(train.drop("features"), FEATURES)
    return model.transform(train).withColumn("predicted", F.exp("prediction")), log_mean(t)


def _boosted(t: Tables):
    train, _ = encoded_pair(t)
    model = boost.boosted_price(train.drop("features"), FEATURES, rounds=ROUNDS, depth=3)
    return model.transform(train).withColumn("predicted", F.exp("prediction")), log_mean(t)


def _quantile(t: Tables):
    train, _ = encoded_pair(t)
    model = boost.QuantileBoost(0.85, rounds=ROUNDS, depth=3).fit(train)
    return model.transform(train).withColumn("predicted", F.exp("prediction")), quantile_of(t, 0.85)


def _stopped(t: Tables):
    train, _ = encoded_pair(t)
    model = stopped_early(train)
    return model.transform(train).withColumn("predicted", F.exp("prediction")), quantile_of(t, 0.5)


def _predicted(t: Tables):
    train, _ = encoded_pair(t)
    models = boost.fit_quantiles(train, rounds=ROUNDS, depth=3)
    return boost.predict_quantiles(train, models).withColumn("predicted", F.col("q15")), quantile_of(t, 0.15)


loss_check("l4_linear_price_loss", squared, SQUARED_SQL, _linear)
loss_check("l5_boosted_price_loss", squared, SQUARED_SQL, _boosted)
loss_check("l6_quantile_boost_loss", pinball(0.85), pinball_sql(0.85), _quantile)
loss_check("l7_early_stopping_loss", pinball(0.5), pinball_sql(0.5), _stopped)
loss_check("l9_predict_quantiles_loss", pinball(0.15), pinball_sql(0.15), _predicted)


CORRIDOR = f"WITH {UNSEEN}, " + """dm AS (SELECT * FROM u), mm AS (SELECT * FROM m),
  kk AS (SELECT DISTINCT brand, variant, year FROM dm),
  l0 AS (SELECT brand, variant, year, count(*) AS n, {q} FROM mm GROUP BY 1, 2, 3 HAVING count(*) >= 5),
  l1 AS (SELECT kk.brand, kk.variant, kk.year, count(*) AS n, {q} FROM kk JOIN mm ON mm.brand = kk.brand AND mm.variant = kk.variant
    AND mm.year BETWEEN kk.year - 1 AND kk.year + 1 GROUP BY 1, 2, 3 HAVING count(*) >= 5),
  l2 AS (SELECT brand, variant, count(*) AS n, {q} FROM mm GROUP BY 1, 2 HAVING count(*) >= 5),
  l3 AS (SELECT brand, count(*) AS n, {q} FROM mm GROUP BY 1 HAVING count(*) >= 5),
  l4 AS (SELECT count(*) AS n, {q} FROM mm),
  co AS (SELECT dm.url, dm.brand, dm.price, CASE WHEN l0.n IS NOT NULL THEN 0 WHEN l1.n IS NOT NULL THEN 1 WHEN l2.n IS NOT NULL THEN 2
      WHEN l3.n IS NOT NULL THEN 3 ELSE 4 END AS level, coalesce(l0.n, l1.n, l2.n, l3.n, l4.n) AS support, {c}
    FROM dm LEFT JOIN l0 ON l0.brand = dm.brand AND l0.variant = dm.variant AND l0.year = dm.year
    LEFT JOIN l1 ON l1.brand = dm.brand AND l1.variant = dm.variant AND l1.year = dm.year
    LEFT JOIN l2 ON l2.brand = dm.brand AND l2.variant = dm.variant LEFT JOIN l3 ON l3.brand = dm.brand CROSS JOIN l4)""".format(
    q="quantile_cont(price, 0.15) AS q15, median(price) AS q50, quantile_cont(price, 0.85) AS q85",
    c=", ".join(f"coalesce(l0.{x}, l1.{x}, l2.{x}, l3.{x}, l4.{x}) AS {x}" for x in ("q15", "q50", "q85")))


@query("l8_corridor", sql(f"{CORRIDOR} SELECT * FROM co", "url brand level support", "q15 q50 q85"))
def _(t: Tables):
    out = iv.corridor(train_rows(t), test_rows(t), min_n=5)
    return out.select("url", "brand", "level", "support", "q15", "q50", "q85")


@query("l9_predict_quantiles")
def _(t: Tables):
    train, test = encoded_pair(t)
    models = boost.fit_quantiles(train, rounds=ROUNDS, depth=3)
    return boost.predict_quantiles(test, models).select("url", "price", "q15", "q50", "q85")


@query("l10_residual_interval", sql(f"""
  {SCORED}, z AS (SELECT quantile_cont(price - q50, 0.05) lo, quantile_cont(price - q50, 0.95) hi FROM s)
  SELECT url, 'global' AS ci_type, greatest(q50 + lo, 0) AS ci_lower, q50 + hi AS ci_upper, (hi - lo) / 2 AS ci_margin FROM s, z""",
    "url ci_type", "ci_lower ci_upper ci_margin"))
def _(t: Tables):
    rows = scored(t)
    return iv.residual_interval(rows, rows, 0.9).select("url", "ci_type", "ci_lower", "ci_upper", "ci_margin")


@query("l11_residual_interval_by_brand", sql(f"""
  {SCORED}, z AS (SELECT quantile_cont(price - q50, 0.05) lo, quantile_cont(price - q50, 0.95) hi FROM s),
  o AS (SELECT brand, quantile_cont(price - q50, 0.05) blo, quantile_cont(price - q50, 0.95) bhi FROM s GROUP BY 1 HAVING count(*) >= 800)
  SELECT url, CASE WHEN blo IS NULL THEN 'global' ELSE 'brand' END AS ci_type, greatest(q50 + coalesce(blo, lo), 0) AS ci_lower,
    q50 + coalesce(bhi, hi) AS ci_upper, (coalesce(bhi, hi) - coalesce(blo, lo)) / 2 AS ci_margin FROM s CROSS JOIN z LEFT JOIN o USING (brand)""",
    "url ci_type", "ci_lower ci_upper ci_margin"))
def _(t: Tables):
    rows = scored(t)
    out = iv.residual_interval(rows, rows, 0.9, by="brand", min_n=800)
    return out.select("url", "ci_type", "ci_lower", "ci_upper", "ci_margin")


@query("l12_residual_stats", sql(f"""
  {SCORED} SELECT brand, count(*) AS n, avg(price - q50) AS mean_error, stddev_pop(price - q50) AS std_error,
    quantile_cont(price - q50, 0.975) - quantile_cont(price - q50, 0.025) AS ci_width FROM s GROUP BY 1 HAVING count(*) >= 700""",
    "brand n", "mean_error std_error ci_width"))
def _(t: Tables):
    return iv.residual_stats(scored(t), "brand", 700)


def corridor_predict(train, test):
    return iv.corridor(train, test, min_n=5)


@query("l13_cross_validate")
def _(t: Tables):
    """Five folds and three levels in the same passes; each fold's encoder sees the other folds only."""
    points = {"boosted": ev.Point(step=0.3, rounds=ROUNDS, depth=3)}
    return ev.cross_validate_boosted(with_variant(t.market), FEATURES, points, CONFIG, k=5).drop("point")


FOLD5 = f"CAST({SPLIT.format(seed=42, n=5)} AS INT)"


STUMP = ("car_age", "km", "horsepower")


@query("l13_cross_validate_stump", sql(f"""
  WITH r AS (SELECT {FOLD5} AS fold, price, ln(price) AS y, car_age::DOUBLE AS f0, km::DOUBLE AS f1, horsepower AS f2 FROM m),
  fo AS (SELECT DISTINCT fold AS k FROM r), st AS (SELECT k, median(y) AS start FROM fo JOIN r ON fold <> k GROUP BY 1),
  e AS (SELECT k, y - start AS e, CASE WHEN y - start < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS g, f0, f1, f2 FROM r JOIN st ON fold <> k),
  z AS (SELECT k, 0 AS i, f0 AS x, e, g FROM e UNION ALL SELECT k, 1, f1, e, g FROM e UNION ALL SELECT k, 2, f2, e, g FROM e),
  v AS (SELECT k, i, x, sum(g) AS g, count(*) AS n FROM z GROUP BY 1, 2, 3),
  w AS (SELECT k, i, x, sum(g) OVER a AS gl, sum(n) OVER a AS nl, sum(g) OVER b AS gt, sum(n) OVER b AS nt FROM v
        WINDOW a AS (PARTITION BY k, i ORDER BY x), b AS (PARTITION BY k, i)),
  s AS (SELECT k, i, x, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt AS gain FROM w WHERE nl >= 20 AND nt - nl >= 20),
  t AS (SELECT k, i, x FROM (SELECT *, max(gain) OVER (PARTITION BY k) AS top FROM s) WHERE gain >= top * (1 - 1e-9::DOUBLE)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY i, x) = 1),
  lf AS (SELECT t.k, t.i, t.x, median(e) FILTER (WHERE z.x <= t.x) AS low, median(e) FILTER (WHERE z.x > t.x) AS high FROM z JOIN t ON z.k = t.k AND z.i = t.i GROUP BY 1, 2, 3),
  p AS (SELECT fold, price, y, start + CASE WHEN CASE i WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END <= x THEN low ELSE high END AS q
        FROM r JOIN st ON st.k = fold JOIN lf ON lf.k = fold)
  SELECT fold, count(*) AS n_val, avg(abs(y - q)) / 2 AS pinball_q50, avg(abs(price - exp(q))) AS mae FROM p GROUP BY 1""",
    "fold n_val", "pinball_q50 mae"))
def _(t: Tables):
    """Cross validation with one split, which SQL can follow: each fold is scored by the best split of the other folds."""
    points = {"stump": ev.Point(step=1.0, rounds=1, depth=1)}
    scored = ev.cross_validate_boosted(with_variant(t.market), STUMP, points, CONFIG, k=5, exact=True)
    return scored.select("fold", "n_val", "pinball_q50", "mae")


@query("l13_fold_state", sql(f"""
  WITH r AS (SELECT *, {FOLD5} AS fold, ln(price) AS lp FROM m), f AS (SELECT DISTINCT fold FROM r)
  SELECT f.fold, brand, count(*) AS brand_count, avg(km) AS brand_avg_km, median(lp) AS brand_median_log_price, stddev_pop(lp) AS brand_std_log_price,
    quantile_cont(lp, 0.9) AS brand_p90_log_price FROM f JOIN r ON r.fold <> f.fold GROUP BY 1, 2 HAVING count(*) >= {MIN}""",
    "fold brand brand_count", "brand_avg_km brand_median_log_price brand_std_log_price brand_p90_log_price"))
def _(t: Tables):
    """The state of every fold's encoder, all from one table of counts, is that of an encoder fitted on the other folds."""
    rows = ev.with_fold(with_variant(t.market), ["url"])
    models = en.PriceEncoder(CONFIG).fit_folds(rows, "fold", 5)
    columns = ("brand", "brand_count", "brand_avg_km", "brand_median_log_price", "brand_std_log_price", "brand_p90_log_price")
    return union_all(*[
        m.state["brands"].where(F.col("brand_count") >= MIN).select(F.lit(i).alias("fold"), *columns) for i, m in enumerate(models)])


CV_FOLD = f"CAST({SPLIT.format(seed=42, n=3)} AS INT)"


@query("l13_cross_validate_corridor", sql(
    f"WITH r AS (SELECT *, {CV_FOLD} AS fold FROM m), " + ", ".join(
        f"""c{i} AS (SELECT brand, quantile_cont(price, 0.15) q15, median(price) q50, quantile_cont(price, 0.85) q85 FROM r WHERE fold <> {i} GROUP BY 1),
        s{i} AS (SELECT r.*, q15, q50, q85 FROM r JOIN c{i} USING (brand) WHERE fold = {i})""" for i in range(3))
    + " " + " UNION ALL ".join(f"""SELECT {i} AS fold, count(*) AS n_val, median(abs(price - q50) / greatest(price, 1) * 100) AS median_ape,
      avg((price BETWEEN q15 AND q85)::INT) * 100 AS coverage, avg(abs(price - q50)) AS mae FROM s{i}""" for i in range(3)),
    "fold n_val", "median_ape coverage mae"))
def _(t: Tables):
    def fit(train, test):
        spec = {"q15": ("price", 0.15), "q50": ("price", 0.5), "q85": ("price", 0.85)}
        return test.join(iv.quantile_table(train, ["brand"], spec), "brand")

    return ev.cross_validate(t.market, fit, k=3).select("fold", "n_val", "median_ape", "coverage", "mae")


# The whole grid: five steps by four numbers of rounds.
GRID = {"step": [0.05, 0.1, 0.2, 0.3, 0.5], "rounds": [5, 10, 15, 20]}


@query("l14_grid_search")
def _(t: Tables):
    """20 points x 3 levels x 3 folds; points with the same step are stages of the same models."""
    return ev.grid_search_boosted(with_variant(t.market), FEATURES, GRID, CONFIG, k=3, depth=3)[0]


@query("l14_grid_facts", sql(f"""
  WITH g AS (SELECT unnest({GRID['step']}::DOUBLE[]) AS step), h AS (SELECT unnest({GRID['rounds']}) AS rounds)
  SELECT step, rounds, (SELECT count(*) FROM m) AS n_val, TRUE AS best_is_least FROM g, h""", "rounds n_val best_is_least", "step"))
def _(t: Tables):
    """Every point is scored on every row, and the best one has the least mean error."""
    table, best = ev.grid_search_boosted(with_variant(t.market), FEATURES, GRID, CONFIG, k=3, depth=3)
    least, chosen = table.agg(F.min("mean_mae")).first()[0], best.first()
    return table.select("step", "rounds", "n_val", F.lit(chosen["mean_mae"] == least).alias("best_is_least"))


# Seven feature sets.
SPECS = {
    "age_km": ("car_age", "km"),
    "lean": ("car_age", "km", "horsepower"),
    "brand": ("car_age", "km", "horsepower", "brand_mean_log_price", "brand_std_log_price"),
    "model": ("car_age", "km", "horsepower", "model_mean_log_price", "model_iqr_log_price", "model_rank_within_brand"),
    "brand_and_model": FEATURES,
    "usage": (*FEATURES, "km_per_year", "log_km", "sqrt_age"),
    "full": tuple(dict.fromkeys((*LEAN_FEATURES, *FEATURES, "km_per_year", "log_km"))),
}


SPEC_CONFIG = replace(CONFIG, horsepower=False)


@query("l15_compare_specs")
def _(t: Tables):
    point = ev.Point(step=0.3, rounds=ROUNDS, depth=3)
    return ev.compare_specs_boosted(train_rows(t), test_rows(t), SPECS, SPEC_CONFIG, point)


@query("l15_specs_facts", sql(f"""
  WITH s AS (SELECT unnest({list(SPECS)}) AS spec), c AS (SELECT median(ln(price)) AS c FROM m)
  SELECT spec, (SELECT count(*) FROM m) AS n_val, (SELECT avg(abs(ln(price) - c)) / 2 FROM m, c) AS constant_loss, TRUE AS better FROM s""",
    "spec n_val better", "constant_loss"))
def _(t: Tables):
    """Each set's median model against the one constant that needs no features, on the rows both learned from."""
    table = ev.compare_specs_boosted(train_rows(t), train_rows(t), SPECS, SPEC_CONFIG, ev.Point(step=0.3, rounds=10, depth=3))
    logs = t.market.withColumn("y", F.ln("price"))
    middle = iv.quantile_table(logs, [], {"c": ("y", 0.5)}).first().c
    constant = logs.agg(F.avg(F.abs(F.col("y") - middle)) / 2).first()[0]
    return table.select("spec", "n_val", F.lit(constant).alias("constant_loss"), (F.col("pinball_q50") < constant).alias("better"))


@query("l6_first_tree", sql("""
  WITH r AS (SELECT ln(price) AS y, car_age::DOUBLE AS f0, km::DOUBLE AS f1, horsepower AS f2 FROM m), st AS (SELECT quantile_cont(y, 0.85) AS start FROM r),
  e AS (SELECT y - start AS e, CASE WHEN y - start < 0 THEN -0.15::DOUBLE ELSE 0.85::DOUBLE END AS g, f0, f1, f2, start FROM r, st),
  z AS (SELECT 0 AS i, f0 AS x, e, g, start FROM e UNION ALL SELECT 1, f1, e, g, start FROM e UNION ALL SELECT 2, f2, e, g, start FROM e),
  v AS (SELECT i, x, sum(g) AS g, count(*) AS n FROM z GROUP BY 1, 2),
  w AS (SELECT i, x, sum(g) OVER a AS gl, sum(n) OVER a AS nl, sum(g) OVER b AS gt, sum(n) OVER b AS nt FROM v
        WINDOW a AS (PARTITION BY i ORDER BY x), b AS (PARTITION BY i)),
  s AS (SELECT i, x, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt AS gain FROM w WHERE nl >= 20 AND nt - nl >= 20),
  t AS (SELECT i, x FROM s WHERE gain >= (SELECT max(gain) FROM s) * (1 - 1e-9::DOUBLE) ORDER BY i, x LIMIT 1)
  SELECT ['car_age', 'km', 'horsepower'][t.i + 1] AS feature, t.x AS cut, z.x > t.x AS above, count(*) AS n, any_value(start) AS start,
    quantile_cont(e, 0.85) AS leaf FROM z JOIN t ON z.i = t.i GROUP BY 1, 2, 3""", "feature above n", "cut start leaf"))
def _(t: Tables):
    """The first tree of a quantile model, one split deep: the split with the most gain, and the quantile of the residuals
    on either side."""
    rows = with_variant(t.market).select(F.ln("price").alias("log_price"), F.array(*[F.col(c).cast("double") for c in STUMP]).alias("features"))
    fitted = boost.QuantileBoost(0.85, rounds=1, depth=1, step=1.0).fit(rows).fitted
    tree = fitted.trees[0]
    cut = fitted.cuts[tree.feature[0]][tree.cut[0]]
    return t.spark.createDataFrame(
        [(STUMP[tree.feature[0]], cut, side == 1, int(tree.rows[1 + side]), fitted.start, tree.value[side]) for side in (0, 1)],
        "feature string, cut double, above boolean, n bigint, start double, leaf double")


@query("l6_leaf_shares", sql("SELECT count(*) AS n, 50 AS trees, TRUE AS leaves_are_quantiles FROM m", "n trees leaves_are_quantiles"))
def _(t: Tables):
    """50 rounds; in every leaf of the last tree, the share of residuals up to the leaf's value is the level."""
    train = prepared(t)
    model = boost.QuantileBoost(0.85, rounds=50, depth=3, step=0.1).fit(train)
    before, last = boost.QuantileBoostModel(model.fitted.first(49)), model.fitted.trees[-1]
    leaf = hist.predict(F.col("features"), [hist.HistModel(model.fitted.cuts, 0.0, [last])])
    scored = before.transform(train).withColumns({"leaf": F.get(leaf, F.lit(0)), "e": F.col("log_price") - F.col("prediction")})
    value = F.col("leaf") / 0.1
    # a quantile between two values has at most one of them more or less on its side, and equal ones
    leaves = scored.groupBy("leaf").agg(
        F.count("*").alias("n"), F.sum((F.col("e") < value - 1e-9).cast("int")).alias("below"), F.sum((F.col("e") <= value + 1e-9).cast("int")).alias("upto"))
    ok = (F.col("below") <= 0.85 * (F.col("n") - 1) + 1) & (F.col("upto") >= 0.85 * (F.col("n") - 1))
    return leaves.agg(F.sum("n").alias("n"), F.lit(len(model.fitted.trees)).alias("trees"), F.min(ok).alias("leaves_are_quantiles"))


def prepared(t: Tables):
    """Training rows with few plain features as an array, settled."""
    rows = with_variant(t.market).select(
        "url", "price", F.ln("price").alias("log_price"), F.array(*[F.col(c).cast("double") for c in STUMP]).alias("features"))
    return settle(rows)


@query("l16_importances")
def _(t: Tables):
    train, _test = encoded_pair(t)
    model = boost.QuantileBoost(0.5, rounds=ROUNDS, depth=3).fit(train)
    return boost.importances(model.feature_importances(len(FEATURES)), FEATURES, t.spark)


@query("l16_importance_facts", sql(
    "SELECT feature, feature <> 'nothing' AS used, TRUE AS whole FROM (SELECT unnest(['car_age', 'km', 'horsepower', 'nothing']) AS feature)",
    "feature used whole"))
def _(t: Tables):
    """Shares add up to 1; a feature that is the same in all rows has none."""
    rows = prepared(t).withColumn("features", F.array_append("features", F.lit(1.0)))
    shares = boost.QuantileBoost(0.5, rounds=ROUNDS, depth=3).fit(rows).feature_importances(4)
    table = boost.importances(shares, [*STUMP, "nothing"], t.spark)
    return table.select("feature", (F.col("importance") > 0).alias("used"), F.lit(abs(sum(shares) - 1) < 1e-9).alias("whole"))


@query("l17_contributions")
def _(t: Tables):
    train, test = encoded_pair(t)
    model = boost.QuantileBoost(0.5, rounds=ROUNDS, depth=3).fit(train)
    explained = model.explain(test)
    return explained.select("url", "base_value", *[F.get("contributions", F.lit(i)).alias(f"of_{f}") for i, f in enumerate(FEATURES)])


@query("l17_contributions_add_up", sql("SELECT url, TRUE AS adds_up, TRUE AS unused_is_0 FROM d", "url adds_up unused_is_0"))
def _(t: Tables):
    """For every row, the base value and what the features add are the prediction; a constant feature adds nothing."""
    model = boost.QuantileBoost(0.85, rounds=ROUNDS, depth=3).fit(prepared(t).withColumn("features", F.array_append("features", F.lit(1.0))))
    rows = with_variant(t.declared).select("url", F.array(*[F.col(c).cast("double") for c in STUMP], F.lit(1.0)).alias("features"))
    explained = model.transform(model.explain(rows))
    total = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x)
    return explained.select("url", (F.abs(total - F.col("prediction")) < 1e-9).alias("adds_up"), (F.get("contributions", F.lit(3)) == 0).alias("unused_is_0"))


@query("l17_stump_contributions", sql("""
  WITH r AS (SELECT ln(price) AS y, km::DOUBLE AS x FROM m), mean AS (SELECT avg(y) AS start FROM r),
  v AS (SELECT x, sum(y - start) AS g, count(*) AS n FROM r, mean GROUP BY 1),
  w AS (SELECT x, sum(g) OVER a AS gl, sum(n) OVER a AS nl, sum(g) OVER () AS gt, sum(n) OVER () AS nt FROM v WINDOW a AS (ORDER BY x)),
  s AS (SELECT x, gl / nl AS low, (gt - gl) / (nt - nl) AS high, nl, nt, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt AS gain
        FROM w WHERE nl >= 20 AND nt - nl >= 20),
  t AS (SELECT * FROM s WHERE gain >= (SELECT max(gain) FROM s) * (1 - 1e-9::DOUBLE) ORDER BY x LIMIT 1),
  b AS (SELECT *, (nl * low + (nt - nl) * high) / nt AS mean FROM t)
  SELECT url, start + mean AS base_value, CASE WHEN km <= x THEN low ELSE high END - mean AS of_km FROM d, b, mean""",
    "url", "base_value of_km"))
def _(t: Tables):
    """One split on one feature: its contribution is the leaf's value less the mean over the training rows."""
    rows = with_variant(t.market).select(F.ln("price").alias("log_price"), F.array(F.col("km").cast("double")).alias("features"))
    model = boost.QuantileBoost(None, rounds=1, depth=1, step=1.0).fit(rows)
    declared = t.declared.select("url", F.array(F.col("km").cast("double")).alias("features"))
    return model.explain(declared).select("url", "base_value", F.get("contributions", F.lit(0)).alias("of_km"))


@query("l17_permutation_importance")
def _(t: Tables):
    train, test = encoded_pair(t)
    model = boost.QuantileBoost(0.5, rounds=ROUNDS, depth=3).fit(train)

    def predict(rows):
        return model.transform(en.assemble(rows, FEATURES)).withColumn("q50", F.exp("prediction"))

    return ev.permutation_importance(
        predict, test.select("price", *FEATURES), FEATURES, ev.pinball_loss("price", "q50", 0.5))


@query("q7_monotone", sql("""
  SELECT url, TRUE AS falls_with_km, TRUE AS rises_with_power FROM d""", "url falls_with_km rises_with_power"))
def _(t: Tables):
    """Price never rises with mileage and never falls with power: each row against itself with more of either."""
    model = boost.QuantileBoost(0.5, rounds=ROUNDS, depth=4, monotone={1: -1, 2: 1}).fit(prepared(t))
    rows = with_variant(t.declared)
    age, km, power = (F.col(c).cast("double") for c in STUMP)
    out = rows.select("url", F.array(age, km, power).alias("features"), F.array(age, km + 4000.0, power).alias("farther"), F.array(age, km, power + 10.0).alias("stronger"))
    scored = {c: F.get(hist.predict(F.col(c), [model.fitted]), F.lit(0)) for c in ("features", "farther", "stronger")}
    return out.select("url", *[v.alias(c) for c, v in scored.items()]).select(
        "url", (F.col("farther") <= F.col("features")).alias("falls_with_km"), (F.col("stronger") >= F.col("features")).alias("rises_with_power"))


@query("l18_bundle_unchanged", sql("SELECT url, TRUE AS same FROM d", "url same"))
def _(t: Tables):
    """Predictions before saving and after loading."""
    encoder = en.PriceEncoder(CONFIG).fit(train_rows(t))
    train = en.assemble(encoder.transform(train_rows(t)).withColumn("log_price", F.ln("price")), FEATURES)
    models, path = boost.fit_quantiles(train, rounds=ROUNDS, depth=2), scratch_path(t.spark, "bundle")
    boost.save_bundle(t.spark, path, encoder, models, FEATURES)
    loaded, again, features = boost.load_bundle(t.spark, path)
    rows, names = test_rows(t), ("q15", "q50", "q85")
    before = boost.predict_quantiles(en.assemble(encoder.transform(rows), FEATURES), models)
    before = before.select(*rows.columns, *[F.col(c).alias(f"saved_{c}") for c in names])
    after = boost.predict_quantiles(en.assemble(loaded.transform(before), features), again)
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"saved_{c}"))
    return after.select("url", same.alias("same"))


@query("l18_bundle")
def _(t: Tables):
    encoder = en.PriceEncoder(CONFIG).fit(train_rows(t))
    train = en.assemble(encoder.transform(train_rows(t)).withColumn("log_price", F.ln("price")), FEATURES)
    path = scratch_path(t.spark, "bundle")
    boost.save_bundle(t.spark, path, encoder, boost.fit_quantiles(train, rounds=ROUNDS, depth=3), FEATURES)
    encoder, models, features = boost.load_bundle(t.spark, path)
    return boost.predict_quantiles(en.assemble(encoder.transform(test_rows(t)), features), models).select("url", "q15", "q50", "q85")


@query("l19_predict_interval", sql(
    f"{CORRIDOR} SELECT url, q15, q85, q85 - q15 AS width, (q85 - q15) / 2 AS margin, (q15 + q85) / 2 AS centre FROM co",
    "url", "q15 q85 width margin centre"))
def _(t: Tables):
    out = iv.predict_interval(test_rows(t), train_rows(t), min_n=5)
    return out.select("url", "q15", "q85", "width", "margin", "centre")


HELD = f"{SPLIT.format(seed=42, n=5)} = 0"
AGE3 = "CASE WHEN car_age BETWEEN 0 AND 2 THEN '0-2' WHEN car_age BETWEEN 3 AND 5 THEN '3-5' ELSE '6-10' END"


@query("q1_conformal_by_age", sql(f"""
  {SCORED}, x AS (SELECT *, {AGE3} AS age_bucket, {HELD} AS held FROM s), h AS (SELECT age_bucket, price - q85 AS score,
    row_number() OVER (PARTITION BY age_bucket ORDER BY price - q85) AS rn, count(*) OVER (PARTITION BY age_bucket) AS n FROM x WHERE held),
  o AS (SELECT age_bucket, score AS off FROM h WHERE rn = least(n, ceil(0.85::DOUBLE * (n + 1))))
  SELECT url, age_bucket, q85, q85 + off AS q85_conformal FROM x JOIN o USING (age_bucket) WHERE NOT held""",
    "url age_bucket", "q85 q85_conformal"))
def _(t: Tables):
    out = iv.conformal_by_age(scored(t), ["url"], "price", "car_age", {"q85": 0.85})
    return out.select("url", "age_bucket", "q85", "q85_conformal")


@query("q1_conformal_coverage", sql(f"""
  {SCORED}, x AS (SELECT *, {AGE3} AS age_bucket, {HELD} AS held FROM s),
  lo AS (SELECT age_bucket, price - q15 AS score, row_number() OVER (PARTITION BY age_bucket ORDER BY price - q15) AS rn,
    count(*) OVER (PARTITION BY age_bucket) AS n FROM x WHERE held),
  hi AS (SELECT age_bucket, price - q85 AS score, row_number() OVER (PARTITION BY age_bucket ORDER BY price - q85) AS rn,
    count(*) OVER (PARTITION BY age_bucket) AS n FROM x WHERE held),
  a AS (SELECT age_bucket, score AS lo FROM lo WHERE rn = greatest(1, floor(0.15::DOUBLE * (n + 1)))),
  b AS (SELECT age_bucket, score AS hi FROM hi WHERE rn = least(n, ceil(0.85::DOUBLE * (n + 1))))
  SELECT age_bucket, count(*) AS n, avg((price BETWEEN q15 + lo AND q85 + hi)::INT) * 100 AS coverage_pct,
    avg((price < q15 + lo)::INT) * 100 AS below_pct, avg((price > q85 + hi)::INT) * 100 AS above_pct
  FROM x JOIN a USING (age_bucket) JOIN b USING (age_bucket) WHERE NOT held GROUP BY 1""",
    "age_bucket n", "coverage_pct below_pct above_pct"))
def _(t: Tables):
    out = iv.conformal_by_age(scored(t), ["url"], "price", "car_age", {"q15": 0.15, "q85": 0.85})
    return coverage(out, "price", "q15_conformal", "q85_conformal", ["age_bucket"])


@query("q2_confidence_tier", sql("""
  WITH c AS (SELECT brand, variant, year, count(*) AS n FROM m GROUP BY 1, 2, 3)
  SELECT url, coalesce(n, 0) AS n_support, CASE WHEN n >= 6 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM d LEFT JOIN c USING (brand, variant, year)""", "url n_support confidence"))
def _(t: Tables):
    out = iv.confidence_tier(t.declared, t.market, ["brand", "variant", "year"], 2, 6)
    return out.select("url", "n_support", "confidence")


@query("q3_inverse_frequency_weights", sql("""
  WITH c AS (SELECT variant, count(*) AS n FROM l GROUP BY 1)
  SELECT url, least(1.05, (SELECT avg(n) FROM c) / n) AS weight FROM l JOIN c USING (variant)""", "url", "weight"))
def _(t: Tables):
    return iv.inverse_frequency_weights(t.listings, "variant", 1.05).select("url", "weight")


@query("q4_plausible_km", sql("""
  WITH x AS (SELECT url, km / car_age > 60000 AS hi, car_age >= 7 AND km / car_age < 1000 AS lo FROM l)
  SELECT url, CAST(hi AS INT) AS km_too_high, CAST(lo AS INT) AS km_too_low, CAST(NOT hi AND NOT lo AS INT) AS km_plausible FROM x""",
    "url km_too_high km_too_low km_plausible"))
def _(t: Tables):
    flags = plausible_km("km", "car_age", lo_from_age=7)
    names = ["km_too_high", "km_too_low", "km_plausible"]
    return t.aged.select("url", *flags).withColumns({n: F.col(n).cast("int") for n in names})


@query("q5_share_drift", sql("""
  WITH a AS (SELECT energie, count(*) * 100.0 / sum(count(*)) OVER () AS share_a FROM l WHERE snapshot = 'F' GROUP BY 1),
  b AS (SELECT energie, count(*) * 100.0 / sum(count(*)) OVER () AS share_b FROM l WHERE snapshot = 'O' GROUP BY 1)
  SELECT energie, share_a, share_b, share_b - share_a AS change_points FROM a JOIN b USING (energie)""",
    "energie", "share_a share_b change_points"))
def _(t: Tables):
    old, new = (t.listings.where(F.col("snapshot") == s) for s in ("F", "O"))
    return quality.share_drift(old, new, "energie")


@query("q6_power_ratios", sql("""
  SELECT url, horsepower / (car_age + 1) AS hp_per_age, horsepower / (km + 1000) * 1000000 AS hp_per_million_km, horsepower * car_age AS hp_x_age,
    horsepower / avg(horsepower) OVER (PARTITION BY brand) AS hp_vs_brand FROM l""", "url", "hp_per_age hp_per_million_km hp_x_age hp_vs_brand"))
def _(t: Tables):
    rows = stats.with_group_stat(power_ratios(t.aged), ["brand"], "horsepower", "avg", "brand_hp")
    return rows.select(
        "url", "hp_per_age", (F.col("hp_per_km") * 1_000_000).alias("hp_per_million_km"), "hp_x_age", (F.col("horsepower") / F.col("brand_hp")).alias("hp_vs_brand"))

import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotwise.config import EncoderConfig, LEAN_FEATURES
from lotwise.learning import boost, encode as en, evaluate as ev

CONFIG = EncoderConfig(min_samples=5)


@pytest.fixture(scope="module")
def cars(spark):
    rng = random.Random(11)
    data = []
    for i in range(900):
        brand = rng.choice(["aa", "bb", "cc"])
        model, year, km = rng.choice(["m1", "m2", "m3"]), rng.randint(2005, 2025), rng.uniform(0, 200_000)
        price = math.exp(9 + 0.4 * "abc".index(brand[0]) + 0.05 * (year - 2015) - km / 400_000 + rng.gauss(0, 0.2))
        data.append((f"u{i}", brand, model, year, km, float(rng.randint(50, 300)), rng.choice(["Diesel", "Essence", None]), price))
    data += [("r1", "rare", "m9", 2020, 10.0, 90.0, "Diesel", 20000.0)]
    schema = "url string, brand string, model string, year int, km double, horsepower double, energie string, price double"
    return spark.createDataFrame(data, schema)


def test_state_ignores_other_rows(spark, cars):
    train, test = cars.where("url < 'u5'"), cars.where("url >= 'u5'")
    model = en.PriceEncoder(CONFIG).fit(train)
    before = sorted(map(tuple, model.state["brands"].select("brand", "brand_mean_log_price").collect()))
    model.transform(test.withColumn("price", F.lit(1e12))).count()
    again = en.PriceEncoder(CONFIG).fit(train)
    assert sorted(map(tuple, again.state["brands"].select("brand", "brand_mean_log_price").collect())) == before


def test_unseen_and_rare_entities_fall_back(spark, cars):
    model = en.PriceEncoder(CONFIG).fit(cars)
    new = spark.createDataFrame(
        [("n", "new", "zz", 2020, 5.0, 80.0, None, 1.0), ("r", "rare", "m9", 2026, 5.0, 80.0, None, 1.0)], cars.schema)
    rows = {r.url: r for r in model.transform(new).collect()}
    g = model.state["globals"].first()
    n, r = rows["n"], rows["r"]
    assert n.brand_mean_log_price == pytest.approx(g.global_mean) and n.model_count == 0 and n.model_rank_within_brand == 0
    assert n.brand_p25_log_price == pytest.approx(g.global_mean - 0.674 * g.global_std)
    assert n.brand_median_km == pytest.approx(g.global_km_mean) and n.brand_top25_price == 0
    assert r.brand_mean_log_price == pytest.approx(g.global_mean) and r.brand_avg_km == 10.0 and r.model_count == 1
    assert r.car_age == -1 and r.km_per_year == 5.0 and r.sqrt_age == 0.0
    assert set(LEAN_FEATURES) <= set(model.transform(new).columns)


def test_transform_keeps_every_row(cars):
    out = en.PriceEncoder(CONFIG).fit(cars.limit(50)).transform(cars)
    assert out.count() == cars.count()
    matrix = en.lean_matrix(out)
    assert matrix.columns == list(LEAN_FEATURES)
    assert matrix.dropna().count() == cars.count()


def test_saved_encoder_gives_the_same(spark, cars, tmp_path):
    model = en.PriceEncoder(EncoderConfig(fuel_onehot=True)).fit(cars)
    model.save(str(tmp_path))
    loaded = en.PriceEncoderModel.load(spark, str(tmp_path))
    columns = ["url", "brand_mean_log_price", "model_iqr_log_price", "energie_Essence"]
    assert sorted(map(tuple, loaded.transform(cars).select(*columns).collect())) == sorted(
        map(tuple, model.transform(cars).select(*columns).collect()))


def test_onehot_drops_the_first_level(spark, cars):
    model = en.OneHot("brand").fit(cars)
    assert model.columns == ["brand_bb", "brand_cc", "brand_rare"]
    with pytest.raises(ValueError, match="more than 2 levels"):
        en.OneHot("brand", max_levels=2).fit(cars)
    fitted = en.sparse_onehot("brand", "v", cars).fit(cars)
    new = spark.createDataFrame([("aa",), ("bb",), ("zz",)], "brand string")
    assert [sum(r[0]) for r in fitted.transform(new).select(vector_to_array("v")).collect()] == [0.0, 1.0, 0.0]


def test_standardised_columns(cars):
    out = en.Standardize().fit(cars).transform(cars)
    row = out.agg(F.avg("km"), F.stddev_pop("km"), F.min("year")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == 2005


def test_folds_cover_the_input(cars):
    folded = ev.with_fold(cars, ["url"], 5)
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == cars.count() and min(sizes) > 100


@pytest.fixture(scope="module")
def encoded(cars):
    encoder = en.PriceEncoder(CONFIG).fit(cars)
    features = ["car_age", "km", "brand_mean_log_price"]
    return encoder, en.assemble(encoder.transform(cars).withColumn("log_price", F.ln("price")), features), features


def test_boosting_beats_a_constant_and_orders_quantiles(spark, encoded, tmp_path):
    encoder, rows, features = encoded
    rows = rows.cache()
    models = boost.fit_quantiles(rows, {"q15": 0.15, "q85": 0.85}, rounds=6, depth=3, step=0.5, settle_every=3)
    scored = boost.predict_quantiles(rows, models)
    share = scored.agg(
        F.avg((F.col("price") <= F.col("q15")).cast("int")), F.avg((F.col("price") <= F.col("q85")).cast("int"))).first()
    assert share[0] == pytest.approx(0.15, abs=0.06) and share[1] == pytest.approx(0.85, abs=0.06)
    flat = rows.agg(F.percentile("log_price", 0.85)).first()[0]
    e = lambda c: F.col("log_price") - c
    loss = lambda c: F.avg(F.when(e(c) >= 0, 0.85 * e(c)).otherwise(-0.15 * e(c)))
    fitted, constant = scored.agg(loss(F.col("q85_log")), loss(F.lit(flat))).first()
    assert fitted < 0.8 * constant
    boost.save_bundle(spark, str(tmp_path), encoder, models, features)
    _, loaded, names = boost.load_bundle(spark, str(tmp_path))
    same = boost.predict_quantiles(rows, loaded).agg(F.sum("q15"), F.sum("q85")).first()
    assert names == features and same == scored.agg(F.sum("q15"), F.sum("q85")).first()


def test_early_stopping_keeps_the_best_rounds(encoded):
    _, rows, _ = encoded
    noise = rows.withColumn("log_price", F.rand(1)).cache()
    model = boost.QuantileBoost(
        0.5, rounds=8, depth=4, step=1.0, min_rows=1, validation_col="is_es", patience=2).fit(ev.with_es_slice(noise, ["url"], 0.5))
    assert model.best_iteration < 8


def test_permuting_the_used_feature_hurts_most(encoded):
    _, rows, _ = encoded

    def predict(df):
        return df.withColumn("p", F.exp(F.col("brand_mean_log_price")))

    data = rows.select("price", "car_age", "brand_mean_log_price")
    table = ev.permutation_importance(predict, data, ["car_age", "brand_mean_log_price"], ev.pinball_loss("price", "p", 0.5)).collect()
    assert table[0].feature == "brand_mean_log_price" and table[0].delta_loss > 0
    assert table[1].delta_loss == pytest.approx(0)

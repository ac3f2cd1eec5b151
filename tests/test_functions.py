import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotwise.functions import features as fx, parse


def values(spark, data, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize("function, texts, wanted", [
    (parse.parse_money, ["25,000 €", "25 000 €", "", "1.2.3", None, "price"], [25000.0, 25000.0, None, None, None, None]),
    (parse.parse_km, ["150,000 km", "12km", "n/a", None], [150000.0, 12.0, None, None]),
    (parse.parse_hp, ["150 Ch", "n.c.", " 90 Ch ", None], [150.0, None, 90.0, None]),
    (parse.parse_digits, ["a1b2", "", "none"], [12.0, None, None]),
    (parse.first_int, ["v12b3", "none", None], [12, None, None]),
    (parse.currency, ["12 €", "EUR"], [" €", "EUR"]),
    (parse.year_of_text, ["2019-05-01", "soon", None], [2019, None, None]),
    (parse.parse_date, ["2025-02-30T1", "2025-02-28T1", "x"], [None, dt.date(2025, 2, 28), None]),
    (parse.normalize_text, ["Citroën DS-3 Škoda", "  C-Max ", "AUTRE", None, ""], ["citroen ds3 koda", "cmax", "autre", None, ""]),
    (parse.safe_name, ["a b-c"], ["a_b_c"]),
])
def test_parsing(spark, function, texts, wanted):
    assert values(spark, texts, function("x")) == wanted


def test_try_num_keeps_whole_numbers_written_as_decimals(spark):
    assert values(spark, ["2020.0", "x", None], parse.try_num("x", "int")) == [2020, None, None]


def test_rank_of_rejects_unknown_labels(spark):
    assert values(spark, ["oct", "dec"], parse.rank_of("x", {"oct": 0, "dec": 1})) == [0, 1]
    with pytest.raises(Exception, match="unmapped label"):
        values(spark, ["jan"], parse.rank_of("x", {"oct": 0}))


def test_keyword_flags(spark):
    fuels = ["Électrique", "Hybride essence", "Diesel", "GPL", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fuels)], "i int, x string").orderBy("i")
    rows = df.select(*parse.keyword_flags("x")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 1, 0), (0, 0, 0, 0)]


def test_fill_and_clip(spark):
    assert values(spark, [None, float("nan"), 3.0], parse.fill_number("x"), "double") == [0.0, 0.0, 3.0]
    assert values(spark, [1.0, 5.0, 9.0, None], parse.clip("x", 2.0, 8.0), "double") == [2.0, 5.0, 8.0, None]


def test_age_edges(spark):
    label, order = fx.age_bucket("x")
    ages = [0, 2, 3, 20, 21, -1, 500, None]
    assert values(spark, ages, label, "int") == ["0-2", "0-2", "3-5", "16-20", "21+", None, None, None]
    assert values(spark, ages, order, "int") == [0, 0, 1, 4, 5, None, None, None]
    years = [2025, 2023, 2022, 2010, 2009, 2026]
    assert values(spark, years, fx.age_category("x", 2025), "int") == [
        "new_0-2yr", "new_0-2yr", "recent_3-5yr", "older_11-15yr", "very_old_16+yr", "new_0-2yr"]
    assert values(spark, [2024, 2023, 2026], fx.newness_flags("x", 2025)[0], "int") == [True, False, True]


def test_km_per_year_at_age_zero(spark):
    ages = [0, -1, 2]
    assert values(spark, ages, fx.km_per_year(F.lit(100.0), "x"), "int") == [100.0, 100.0, 50.0]
    assert values(spark, ages, fx.km_per_year(F.lit(100.0), "x", "plus_one"), "int")[:2] == [100.0, None]


def test_log_target_drops_what_has_no_logarithm(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "price double")
    assert fx.log_target(df).count() == 1
    assert fx.log_target(df, kind="log1p").count() == 2

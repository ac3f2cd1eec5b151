import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lotwise.config import CleaningConfig
from lotwise.operators import intervals, match, metrics, quality, rows, stats, validate, windows
from lotwise.plans import cleaning, snapshots
from lotwise.sources import files

# Declared, predicted and market figures with their published gap and tier.
GOLDEN = [
    (6024.2445, 9731.65121438875, 12123.631910990562, 12524.190178843613, None, None, 0, 50.3099026411485, "RED"),
    (10139.326500000001, 13359.656241910978, 15990.161831068297, 18615.18974740383, 13350.0, 20434.5, 1476, 36.59021961679173, "RED"),
    (15088.6005, 15165.449789249542, 17432.85391586, 20828.54487604948, 13500.0, 20990.0, 261, 13.447330122621246, "ORANGE"),
    (16925.4195, 12314.884356640645, 21050.569844478956, 26512.964661960217, None, None, 0, 19.596383256868844, "GREEN"),
    (109106.34, 100351.05837270437, 124527.08493816381, 144714.12825382015, 96900.0, 164990.0, 121, 12.383446497459783, "GREEN"),
    (3390.0, 3966.6691537928014, 4035.9089491894892, 6181.464115979546, 3499.0, 6071.800000000001, 39, 16.004051561153375, "RED"),
]


def test_published_tiers(spark):
    df = spark.createDataFrame(
        GOLDEN, "declared_price double, pred_q15 double, pred_q50 double, pred_q85 double, train_p10 double, "
        "train_p90 double, training_sample_size int, gap double, tier string")
    for r in validate.assign_tier(df).collect():
        assert r["color_tier"] == r["tier"] and r["gap_pct"] == pytest.approx(r["gap"], rel=1e-12)


def listing(spark, groups):
    data = [(b, y, float(1000 + i), float(10 * i)) for (b, y), n in groups.items() for i in range(n)]
    return spark.createDataFrame(data, "brand string, year int, price double, km double")


def test_fence_origins_at_the_limits(spark):
    groups = {("a", 2000): 50, ("a", 2010): 49, ("b", 2000): 9, ("c", 2000): 5, ("c", 2001): 5, ("d", 2000): 10}
    df = quality.prepare_fences(listing(spark, groups))
    bounds = {(r.brand, r.year): r.source for r in quality.iqr_bounds(df, "brand", "year", {"log_price1p": 1.5, "km": 1.5}).collect()}
    assert bounds == {
        ("a", 2000): "brand_year", ("a", 2010): "brand_year_pm1", ("b", 2000): "no_bound",
        ("c", 2000): "brand_year_pm1", ("c", 2001): "brand_year_pm1", ("d", 2000): "brand_year_pm1"}
    measures = {"log_price1p": 1.5, "km": 1.5}
    assert quality.iqr_filter_pooled(df, "brand", "year", measures).where("brand = 'b'").count() == 0
    assert quality.iqr_filter_pooled(df, "brand", "year", measures, sparse="keep").where("brand = 'b'").count() == 9


def test_clean_counts_each_stage(spark):
    good = [("u", "12 000 €", "Peugeot", "208", "2015", "10,000 km", "Diesel", f"{100 + i % 3} Ch") for i in range(60)]
    bad = [
        ("u", "", "Peugeot", "208", "2015", "1 km", "Diesel", "100 Ch"), ("u", "1 €", "Peugeot", "208", "2015", "1 km", None, "100 Ch"),
        ("u", "9000 €", "Peugeot", "208", "1980", "1 km", None, "100 Ch"), ("u", "9000 €", "Peugeot", "AUTRE", "2015", "1 km", None, "100 Ch"),
        ("u", "9000 €", "Peugeot", "208", "2015", "1 km", None, "49 Ch"), ("u", "9000 €", "Peugeot", "208", "2015", "1 km", None, "n.c."),
        ("u", "9000 €", "Rare", "x", "2015", "1 km", None, "100 Ch"),
    ]
    names = ["url", "price", "marque", "modele", "annee_modele", "kilometrage", "energie", "puissance_din"]
    raw = spark.createDataFrame(good + bad, ", ".join(f"{n} string" for n in names))
    config = CleaningConfig(price_floor=500, min_brand_count=10)
    stages = cleaning.cleaning_stages(raw, config)
    counted = [r.n_rows for r in cleaning.stage_counts(stages).orderBy("step").collect()]
    assert counted == [66, 65, 64, 63, 61, 60, 60]
    assert stages["clean"].columns == list(cleaning.CLEAN_COLUMNS)
    assert cleaning.clean(raw, config, lazy=True).count() == 60


def test_observation_counts_rows(spark):
    watched, seen = cleaning.with_stats(spark.range(7), "seven")
    watched.collect()
    assert seen.get == {"n": 7}


def test_dedup_is_decided_on_ties_and_null_keys(spark):
    data = [("a", "2025-01-01", 2.0), ("a", "2025-01-01", 1.0), (None, None, 5.0), (None, "2025-01-01", 6.0), ("b", None, 3.0)]
    df = spark.createDataFrame(data, "url string, index_date string, price double")
    for n in (1, 5):
        found = {r.url: r.price for r in snapshots.dedup_latest(df.repartition(n)).collect()}
        assert found == {"a": 1.0, None: 6.0, "b": 3.0}


def test_merge_prefers_the_newest_snapshot(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "url string, price double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "url string, price double")
    merged = snapshots.merge_snapshots({"old": old, "new": new})
    assert sorted((r.url, r.price, r.snapshot) for r in merged.collect()) == [("a", 1.0, "old"), ("b", 3.0, "new"), ("c", 4.0, "new")]
    row = snapshots.overlap_accounting({"old": old, "new": new}).first()
    assert (row.n_listed, row.n_union, row.n_overlap, row.kept_old, row.kept_new) == (4, 3, 1, 1, 2)


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("url"), F.col("id").alias("ts"))
    plan = windows.latest_per_key(df, "url", "ts")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_no_cross_product_in_plans(spark, sf_dir):
    from lotwise.plans.all_queries import QUERIES

    for name in ("d14_market_share", "g8_band_join", "g12_lookalikes", "f7_with_share", "j9_group_mid_frequency", "l8_corridor"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_lookup_is_settled_and_broadcast(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kept = quality.drop_rare(df, "l_returnflag", 2000)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_lookalikes_equal_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["Abc", "", "abc"]
    data = [(rng.choice("xy"), n) for n in names]
    wanted = Counter()
    per_group = {g: sorted({n for h, n in data if h == g and n.strip()}) for g in "xy"}
    for g, members in per_group.items():
        for a, b in itertools.combinations(members, 2):
            if a.lower()[:3] == b.lower()[:3] and abs(len(a) - len(b)) <= 2:
                wanted[(g, *sorted((a, b)))] += 1
    found = match.lookalikes(spark.createDataFrame(data, "g string, n string"), "g", "n").collect()
    assert Counter((r.g, r.name_a, r.name_b) for r in found) == wanted
    counts = match.lookalike_counts(spark.createDataFrame(data, "g string, n string"), "g", "n").collect()
    assert {r.g: r.n_lookalikes for r in counts} == Counter(g for g, _, _ in wanted.elements())


@pytest.mark.parametrize("strategy", ["plain", "ranked"])
def test_band_join_equals_brute_force(spark, strategy):
    import numpy as np

    rng = random.Random(9)
    market = [(rng.choice("ab"), 2000 + rng.randint(0, 9), float(rng.randint(1, 30))) for _ in range(400)]
    decl = [(i, rng.choice("abc"), 2000 + rng.randint(0, 12)) for i in range(40)]
    m = spark.createDataFrame(market, "brand string, year int, price double")
    d = spark.createDataFrame(decl, "id int, brand string, year int")
    out = match.band_join(d, m, ["brand"], "year", 2, {"p10": ("price", 0.1)}, strategy=strategy).collect()
    assert len(out) == 40
    for r in out:
        pool = [p for b, y, p in market if b == r.brand and abs(y - r.year) <= 2]
        assert r.n == len(pool)
        assert (r.p10 is None) if not pool else r.p10 == pytest.approx(np.quantile(pool, 0.1))


def test_ecdf_equals_sorting(spark):
    rng = random.Random(1)
    values = [rng.expovariate(0.01) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "e double")
    for r in stats.ecdf(df, "e", 1.0, cells=7).collect():
        assert r.share == pytest.approx(sum(v <= r.value for v in values) / 500)


def test_bins_cover_everything(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.0,), (10.0,), (1e9,), (None,)], "v double")
    found = {r.bin: r.n for r in stats.binned(df, "v", [0, 10], ["low", "high"]).collect()}
    assert found == {"low": 2, "high": 2}
    clipped = stats.histogram(df, "v", 0, 10, 5).collect()
    assert sum(r.n for r in clipped) == 5 and {r.bin for r in clipped} == {0, 4}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    first = {r.id for r in stats.sample_n(df, 50, ["id"]).collect()}
    again = {r.id for r in stats.sample_n(df.repartition(9), 50, ["id"]).collect()}
    assert len(first) == 50 and first == again


def test_bounds_and_nulls(spark):
    df = spark.createDataFrame([(49.0,), (50.0,), (1000.0,), (1001.0,), (None,)], "hp double")
    assert rows.bound(df, "hp", 50, 1000).count() == 2
    assert rows.bound(df, "hp", 50, 1000, keep_null=True).count() == 3
    counts = rows.bound_counts(df, "hp", 50, 1000).first()
    assert tuple(counts) == (5, 1, 1, 1, 2)
    names = spark.createDataFrame([("AUTRE", "x"), (None, "x"), ("a", "b")], "brand string, model string")
    assert rows.drop_placeholder(names, ["brand", "model"], "autre").count() == 1


def test_metrics_identities(spark):
    rng = random.Random(2)
    data = [(p := rng.uniform(1000, 50000), p * rng.uniform(0.8, 1.3)) for _ in range(300)]
    df = spark.createDataFrame(data, "y double, p double")
    logs = df.select(F.ln("y").alias("ly"), F.ln("p").alias("lp"))
    half = metrics.regression_metrics(logs, "ly", "lp").first().mae / 2
    assert metrics.pinball(df, "y", "p", 0.5).first().pinball == pytest.approx(half)
    perfect = metrics.regression_metrics(df, "y", "y").first()
    assert (perfect.mae, perfect.r2) == (0.0, 1.0)


def test_crossings_are_named(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 3.0), (1.0, 4.0, 3.0), (3.0, 2.0, 1.0)], "a double, b double, c double")
    summary, listed = metrics.crossings(df, ["a", "b", "c"])
    assert summary.first().n_crossings == 3 and summary.first().n_negative_width == 1
    assert sorted(r.issue for r in listed.collect()) == ["a > b", "b > c", "both"]


def test_conformal_covers_its_calibration_rows(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.gauss(0, 10)) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, y double").withColumn("q85", F.lit(0.0))
    fixed = intervals.conformal_correct(df, df, "g", "y", {"q85": 0.85})
    for r in fixed.groupBy("g").agg(F.avg((F.col("y") <= F.col("q85_conformal")).cast("int")).alias("share")).collect():
        assert 0.85 <= r.share <= 0.87


def test_weights_are_capped(spark):
    df = spark.createDataFrame([("a",)] * 99 + [("b",)], "k string")
    found = {r.k: r.weight for r in intervals.inverse_frequency_weights(df, "k").distinct().collect()}
    assert found["b"] == 5.0 and found["a"] == pytest.approx(50 / 99)


def test_files(spark, tmp_path):
    good, empty, odd = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c d.csv"
    good.write_text("url,price\nu1,1\nu2,2\n")
    empty.write_text("")
    odd.write_text("price,other,url\n3,x,u3\n")
    (tmp_path / "e.csv").write_text("url\nu4\n")
    df, skipped = files.read_validated(spark, str(tmp_path), ["url", "price"])
    assert sorted((r.url, r.price) for r in df.collect()) == [("u1", "1"), ("u2", "2"), ("u3", "3")]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in skipped.collect()} == {"b.csv": "empty file", "e.csv": "missing: price"}


QUOTED = 'url,marque,price\nu1,"say ""hi"", ok",10\nu2,"two\nlines",20\n'


def test_quotes_and_line_breaks(spark, tmp_path):
    """In every reader, for a folder, a file and a glob."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(QUOTED)
    columns, want = ["url", "marque", "price"], [("u1", 'say "hi", ok', "10"), ("u2", "two\nlines", "20")]
    for path in (str(folder), str(folder / "a.csv"), str(tmp_path / "*" / "*.csv"), str(tmp_path / "i*")):
        for frame in (
            files.read_listings(spark, path, columns), files.read_listings(spark, path, columns, "skip"),
            files.read_with_rejects(spark, path, columns)[0], files.read_validated(spark, path, columns)[0],
            files.read_ragged(spark, path, columns),
        ):
            assert sorted(tuple(r) for r in frame.select(*columns).collect()) == want
    written = files.write_csv(spark.createDataFrame(want, "url string, marque string, price string"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in files.read_listings(spark, written, columns).collect()) == want
    assert files.read_validated(spark, str(folder), ["other"])[1].first().reason == "missing: other"


def test_header_probe_scans_no_content(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"a,b{i}\n" + "1,2\n" * 10)
    probed = files.probe_headers(spark, str(tmp_path))
    assert sorted(r.header for r in probed.collect()) == [f"a,b{i}" for i in range(5)]
    assert "FileScan" not in probed._jdf.queryExecution().executedPlan().toString()


def test_crosswalk_multiplies_no_rows(spark):
    from lotwise.functions.parse import crosswalk

    mapping = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "old string, new string")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert Counter(r.k for r in crosswalk(df, "k", mapping).collect()) == Counter(["x", "z", "c", None])


def test_null_is_a_key(spark):
    df = spark.createDataFrame([(None,)] * 5 + [("a",)] * 4 + [("b",)], "k string")
    assert Counter(r.k for r in quality.drop_rare(df, "k", 4).collect()) == Counter([None] * 5 + ["a"] * 4)
    assert Counter(r.k for r in stats.keep_top_groups(df, "k", 1).collect()) == Counter([None] * 5)


def test_scope_deletes_its_tables(spark, tmp_path):
    import os

    from lotwise import scale

    folder = scale.scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scale.scratch_scope(spark):
        assert scale.settle(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) <= before


def test_lower_conformal_rank_rounds_down(spark):
    df = spark.createDataFrame([("g", float(i), 0.0) for i in range(1, 11)], "g string, y double, q double")
    offsets = {a: intervals.conformal_offsets(df, "g", "y", "q", a).first().offset for a in (0.05, 0.15, 0.25, 0.85, 0.99)}
    assert offsets == {0.05: 1.0, 0.15: 1.0, 0.25: 2.0, 0.85: 10.0, 0.99: 10.0}


def test_ragged_rows_are_cut(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2,3\n4\n")
    found = sorted((r.a, r.b) for r in files.read_ragged(spark, str(tmp_path), ["a", "b"]).collect())
    assert found == [("1", "2"), ("4", None)]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="brand, price"):
        files.resolve_columns(spark.range(1), {"price": ("prix",), "brand": ()})


def test_snapshot_tasks_hold_so_many_rows_at_most(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "ROWS_IN_PART", 10)
    rows = [(f"u{i % 150}" if i % 50 else None, f"2020-01-{i % 28 + 1:02d}", float(i)) for i in range(300)]
    old, new = (spark.createDataFrame(r, "url string, index_date string, price double") for r in (rows, rows[:40]))
    latest = snapshots.dedup_latest(old)
    merged = snapshots.merge_snapshots({"old": latest, "new": snapshots.dedup_latest(new)})
    for df, parts in ((latest, 30), (merged, 18)):
        per_part = df.groupBy(F.spark_partition_id().alias("p")).count()
        assert per_part.count() > parts / 2
        assert df.select("url").distinct().count() == df.count() == 148
    one = snapshots.overlap_accounting({"old": old, "new": new}).first()
    assert (one.n_union, one.n_overlap, one.kept_new) == (148, 40, 40)

"""Price corridors from comparables, residual intervals and their calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.config import AGE_BUCKETS, QUANTILES
from lotwise.functions.features import age_bucket
from lotwise.operators.keys import hash_bucket, join_on, with_one_row
from lotwise.operators.quantiles import quantile_table, rollup_quantiles
from lotwise.operators.stats import n_rows
from lotwise.scale import settle


def corridor(
    train: DataFrame, df: DataFrame, price: str = "price", brand: str = "brand", model: str = "model",
    year: str = "year", qs: Mapping[str, float] = QUANTILES, min_n: int = 10, *, strategy=None,
) -> DataFrame:
    """Empirical quantiles of comparable training rows, backing off until there are enough.

    Levels: (brand, model, year), the same within ±1 year, (brand, model),
    brand, all rows. `level` tells which one a row got, `support` its size. All
    levels come from one table of counts; rows with a null key have only the
    levels without it. `strategy` names another quantile engine (see there).
    """
    known = train.where(F.col(price).isNotNull()).select(
        F.col(brand).alias("_b"), F.col(model).alias("_m"), F.col(year).alias("_y"), F.col(price).alias("_p"))
    spec = {f"_{name}": ("_p", q) for name, q in qs.items()}
    b, m, y = F.col("_b"), F.col("_m"), F.col("_y")

    def group(level: int, *keys: Column) -> Column:
        types = known.schema
        full = [*keys, *[F.lit(None)] * (3 - len(keys))]
        return F.struct(F.lit(level).alias("_level"), *[
            c.cast(types[name].dataType).alias(name) for c, name in zip(full, ("_b", "_m", "_y"))])

    coarse = [group(2, b, m), group(3, b), group(4)]
    near = F.transform(F.sequence(y - 1, y + 1), lambda other: group(1, b, m, other))
    groups = F.concat(F.array(group(0, b, m, y), *coarse), F.coalesce(near, F.array().cast(known.select(near).schema[0].dataType)))

    asked = settle(df.select(F.col(brand).alias("_b"), F.col(model).alias("_m"), F.col(year).alias("_y")).distinct())
    # a null key has no comparables
    has = [b.isNotNull() & m.isNotNull() & y.isNotNull()] * 2 + [b.isNotNull() & m.isNotNull(), b.isNotNull(), F.lit(True)]
    offers = F.filter(F.array(*[
        F.when(ok, g) for ok, g in zip(has, [group(0, b, m, y), group(1, b, m, y), *coarse])]), lambda g: g.isNotNull())
    offered = asked.select(F.struct("_b", "_m", "_y").alias("_key"), F.inline(offers))
    fields = ["_level", "_b", "_m", "_y"]
    if strategy is None:
        table = rollup_quantiles(known, ["_b", "_m", "_y"], groups, spec, n="_n", wanted=settle(offered.select(*fields).distinct()))
    else:
        table = quantile_table(known.select(F.inline(groups), "_p"), fields, spec, aggs=[n_rows("_n")], strategy=strategy)
    enough = table.where((F.col("_n") >= min_n) | (F.col("_level") == 4))
    best = join_on(offered, enough, fields).groupBy("_key").agg(
        F.min_by(F.struct("_level", "_n", *spec), "_level").alias("_best"))
    chosen = settle(best.select(
        F.col("_key._b").alias("_b"), F.col("_key._m").alias("_m"), F.col("_key._y").alias("_y"),
        *[F.col(f"_best.{c}").alias(f"_of{c}") for c in ("_level", "_n", *spec)]))
    same = F.col(brand).eqNullSafe(F.col("_b")) & F.col(model).eqNullSafe(F.col("_m")) & F.col(year).eqNullSafe(F.col("_y"))
    out = df.drop(*qs, "support", "level").join(chosen, same, "left")
    return out.select(
        *[c for c in df.columns if c not in (*qs, "support", "level")], F.coalesce("_of_level", F.lit(4)).alias("level"),
        *[F.col(f"_of_{q}").alias(q) for q in qs], F.coalesce("_of_n", F.lit(0)).cast("bigint").alias("support"))


def predict_interval(df: DataFrame, model: DataFrame, **levels) -> DataFrame:
    """Corridor prediction with width, margin and centre; the same for one row or many."""
    scored = corridor(model, df, **levels)
    width = F.col("q85") - F.col("q15")
    return scored.withColumns({
        "width": width, "margin": width / 2, "centre": (F.col("q15") + F.col("q85")) / 2,
    })


def residual_interval(
    scored: DataFrame, df: DataFrame, confidence: float = 0.95, y: str = "price", pred: str = "q50",
    by: str | None = None, min_n: int = 10, *, strategy=None,
) -> DataFrame:
    """Predictions plus the residual quantiles of the scored rows, never below zero.

    With `by`, a group of at least `min_n` scored rows uses its own residuals.
    """
    tail = (1 - confidence) / 2
    residuals = scored.dropna(subset=[y, pred]).withColumn("_res", F.col(y) - F.col(pred))
    spec = {"_lo": ("_res", tail), "_hi": ("_res", 1 - tail)}
    whole = quantile_table(residuals, [], spec, strategy=strategy)
    out = with_one_row(df, whole.withColumnsRenamed({"_lo": "_glo", "_hi": "_ghi"}))
    kind = F.lit("global")
    lo, hi = F.col("_glo"), F.col("_ghi")
    if by:
        own = quantile_table(residuals, [by], spec, aggs=[n_rows("_n")], strategy=strategy)
        out = join_on(out, own.where(F.col("_n") >= min_n), [by], "left")
        kind = F.when(F.col("_n").isNotNull(), F.lit(by)).otherwise("global")
        lo, hi = F.coalesce("_lo", "_glo"), F.coalesce("_hi", "_ghi")
    p = F.col(pred)
    return out.withColumns({
        "ci_lower": F.greatest(p + lo, F.lit(0.0)), "ci_upper": p + hi,
        "ci_margin": (hi - lo) / 2, "ci_type": kind,
    }).drop("_glo", "_ghi", "_lo", "_hi", "_n")


def residual_stats(
    scored: DataFrame, by: str, min_n: int = 5, y: str = "price", pred: str = "q50", *, strategy=None
) -> DataFrame:
    """Per group: mean and spread of the residuals and the width of their central 95 %."""
    residuals = scored.dropna(subset=[y, pred]).withColumn("_res", F.col(y) - F.col(pred))
    return (
        quantile_table(
            residuals, [by], {"_lo": ("_res", 0.025), "_hi": ("_res", 0.975)},
            aggs=[n_rows(), F.avg("_res").alias("mean_error"), F.stddev_pop("_res").alias("std_error")],
            strategy=strategy,
        )
        .where(F.col("n") >= min_n)
        .withColumn("ci_width", F.col("_hi") - F.col("_lo")).drop("_lo", "_hi")
    )


def conformal_offsets(
    calibration: DataFrame, group: str, y: str, q: str, alpha: float, min_n: int = 1, *, strategy=None
) -> DataFrame:
    """Per group, what to add to the quantile `q` so that a share `alpha` of values lies below.

    The score is y - q. The rank is that of n + 1 scores, rounded away from the middle: up for an upper quantile, down
    (to the first at least) for a lower one.
    """
    scores = calibration.dropna(subset=[y, q]).withColumn("_score", F.col(y) - F.col(q))
    return _conformal_rank(scores, group, alpha, min_n)


def _conformal_rank(scores: DataFrame, group: str, alpha: float, min_n: int) -> DataFrame:
    """The alpha·(n+1)-th smallest score of each group, rounded up (down if alpha is below a half), from value counts.

    Ranks come from two-level running counts (coarse value cell, then value), so
    a large group is not sorted in one task.
    """
    counts = scores.groupBy(group, "_score").agg(n_rows("_c"))
    cell = F.floor(F.signum("_score") * F.log2(F.abs("_score") + 1) * 16)
    counts = counts.withColumn("_cell", cell)
    cells = counts.groupBy(group, "_cell").agg(F.sum("_c").alias("_cc"))
    over_cells = Window.partitionBy(group).orderBy("_cell")
    rank = F.lit(alpha) * (F.col("_n") + 1)
    wanted = F.least(F.col("_n"), F.ceil(rank)) if alpha >= 0.5 else F.greatest(F.lit(1), F.floor(rank))
    hit = (
        cells.withColumn("_upto", F.sum("_cc").over(over_cells))
        .withColumn("_n", F.sum("_cc").over(Window.partitionBy(group)))
        .where((F.col("_n") >= min_n) & (wanted <= F.col("_upto")) & (wanted > F.col("_upto") - F.col("_cc")))
        .select(group, "_cell", (wanted - (F.col("_upto") - F.col("_cc"))).alias("_k"), F.col("_n").alias("n_cal"))
    )
    inside = Window.partitionBy(group, "_cell").orderBy("_score")
    return (
        join_on(counts, hit, [group, "_cell"])
        .withColumn("_seen", F.sum("_c").over(inside))
        .where(F.col("_seen") >= F.col("_k"))
        .groupBy(group).agg(F.min("_score").alias("offset"), F.max("n_cal").alias("n_cal"))
    )


def conformal_correct(
    df: DataFrame, calibration: DataFrame, group: str, y: str, targets: Mapping[str, float], min_n: int = 1
) -> DataFrame:
    """Split-conformal correction of each quantile column per group; unseen groups keep theirs."""
    out = df
    for q, alpha in targets.items():
        table = settle(conformal_offsets(calibration, group, y, q, alpha, min_n).select(
            group, F.col("offset").alias(f"_off_{q}")
        ))
        out = join_on(out, table, [group], "left").withColumn(
            f"{q}_conformal", F.col(q) + F.coalesce(F.col(f"_off_{q}"), F.lit(0.0))
        ).drop(f"_off_{q}")
    return out


def conformal_by_age(
    df: DataFrame, key: Sequence[str], y: str, age: str, targets: Mapping[str, float],
    calibration_share: int = 5, seed: int = 42, buckets=AGE_BUCKETS,
) -> DataFrame:
    """Hold out 1/`calibration_share` of the keys, correct the rest per age bucket."""
    rows = df.withColumn("age_bucket", age_bucket(age, buckets)[0])
    held_out = hash_bucket(key, calibration_share, seed) == 0
    return conformal_correct(rows.where(~held_out), rows.where(held_out), "age_bucket", y, targets)


def confidence_tier(
    df: DataFrame, train: DataFrame, keys: Sequence[str], low: int = 10, high: int = 50
) -> DataFrame:
    """Trust in a prediction by the number of training rows with the same key."""
    support = settle(train.groupBy(*keys).agg(n_rows("n_support")))
    n = F.coalesce(F.col("n_support"), F.lit(0))
    return df.join(support, list(keys), "left").withColumn("n_support", n).withColumn(
        "confidence", F.when(F.col("n_support") >= high, "high").when(F.col("n_support") >= low, "medium").otherwise("low")
    )


def inverse_frequency_weights(df: DataFrame, key: str, cap: float = 5.0) -> DataFrame:
    """Weight of a row: mean group size over its group's size, at most `cap`."""
    counts = df.groupBy(key).agg(n_rows("_n"))
    mean = counts.agg(F.avg("_n").alias("_mean"))
    weights = with_one_row(counts, mean).select(
        key, F.least(F.lit(cap), F.col("_mean") / F.col("_n")).alias("weight")
    )
    return join_on(df, settle(weights), [key], "left")

"""Aggregates, profiles, histograms and ranked reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations as pairs

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.operators.keys import join_on, total_order, with_one_row
from lotwise.operators.quantiles import quantile_table
from lotwise.scale import settle



def n_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(n_rows()).orderBy(F.desc("n"), *keys)


def distinct_profile(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows, distinct values per column, and rows beyond the first of their value.

    Each exact count is its own two-step aggregate, so no value is multiplied
    across columns and a hot value collapses before the shuffle.
    """
    if approximate:
        one = df.agg(n_rows("n_rows"), *[F.approx_count_distinct(c).alias(c) for c in cols])
        return one.select(
            "n_rows",
            F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unique")) for c in cols])),
        ).select("column", "n_rows", "n_unique", (F.col("n_rows") - F.col("n_unique")).alias("n_duplicate"))
    out = None
    for c in cols:
        per_value = df.groupBy(c).agg(n_rows())
        row = per_value.agg(
            F.lit(c).alias("column"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            n_rows("n_unique"),
        ).withColumn("n_duplicate", F.col("n_rows") - F.col("n_unique"))
        out = row if out is None else out.unionByName(row)
    return out


def group_stats(df: DataFrame, keys: Sequence[str], col: str, *, strategy: str | None = None) -> DataFrame:
    c = F.col(col).cast("double")
    return quantile_table(
        df, keys, {"median": (col, 0.5)},
        aggs=[
            n_rows(), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ],
        strategy=strategy,
    )


def describe(df: DataFrame, cols: Sequence[str], *, by: Sequence[str] = (), strategy: str | None = None) -> DataFrame:
    """One row per column (and group): count, nulls, mean, std, min, quartiles, max."""
    by = list(by)
    spec = {f"{c}|{n}": (c, q) for c in cols for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [
            F.count(c).alias(f"{c}|n"), F.count_if(F.col(c).isNull()).alias(f"{c}|n_null"),
            F.avg(v).alias(f"{c}|mean"), F.stddev_samp(v).alias(f"{c}|std"),
            F.min(v).alias(f"{c}|min"), F.max(v).alias(f"{c}|max"),
        ]
    wide = quantile_table(df, by, spec, aggs=aggs, strategy=strategy)
    fields = ("n", "n_null", "mean", "std", "min", "p25", "p50", "p75", "max")
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{f}`").alias(f) for f in fields]) for c in cols
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def value_counts(df: DataFrame, col: str, k: int | None = None, share: bool = True) -> DataFrame:
    """Counts of each value, most frequent first, with the share of all rows."""
    counts = df.groupBy(col).agg(n_rows())
    if share:
        total = counts.agg(F.sum("n").alias("total"))
        counts = with_one_row(counts, total).select(
            col, "n", F.try_divide("n", "total").alias("share")
        )
    ranked = counts.orderBy(F.desc("n"), F.asc(col))
    return ranked if k is None else ranked.limit(k)


def recount(df: DataFrame, date_col: str, fine: str = "month", coarse: str = "year") -> DataFrame:
    """Counts per coarse period, summed from counts per fine period, with the number of these."""
    day = F.to_date(F.col(date_col))
    per_fine = df.groupBy(F.trunc(day, fine).alias("_fine")).agg(n_rows())
    return per_fine.groupBy(F.to_date(F.trunc("_fine", coarse)).alias("period")).agg(
        F.sum("n").alias("n"), n_rows("n_fine"), F.max("n").alias("max_fine")
    )


def rate_by(df: DataFrame, keys: Sequence[str], flag: Column | str) -> DataFrame:
    f = F.col(flag) if isinstance(flag, str) else flag
    return df.groupBy(*keys).agg(
        n_rows("n_total"),
        F.count_if(f).alias("n_flagged"),
        (F.count_if(f) * 100.0 / F.count(F.lit(1))).alias("pct"),
    )


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(n_rows("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols])
    return one.select("n_rows", F.inline(rows)).select(
        "column", "n_null",
        F.try_divide((F.col("n_rows") - F.col("n_null")) * 100.0, F.col("n_rows")).alias("complete_pct"),
    )


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, from one aggregate."""
    couples = list(pairs(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(couples)])
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(couples)
    ]
    return one.select(F.inline(F.array(*rows)))


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept")
    )


def trend2(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares parabola y = c0 + c1·x + c2·x², in closed form from sums around the mean of x."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    around = with_one_row(points, points.agg(F.avg("x").alias("mx"))).withColumn("u", F.col("x") - F.col("mx"))
    u, v = F.col("u"), F.col("y")
    sums = around.agg(
        F.first("mx").alias("mx"), F.count("*").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"),
        F.sum(u * u * u * u).alias("s4"), F.sum(v).alias("sy"), F.sum(u * v).alias("suy"), F.sum(u * u * v).alias("su2y"))
    c = F.expr("(su2y - s2 * sy / n - s3 * suy / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2)")
    solved = sums.withColumn("c", c).withColumns({"b": F.expr("(suy - s3 * c) / s2"), "a": F.expr("(sy - s2 * c) / n")})
    return solved.select(
        F.expr("a - b * mx + c * mx * mx").alias("c0"), F.expr("b - 2 * c * mx").alias("c1"), F.col("c").alias("c2"))


def bin_label(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open bins [e0, e1), …; a label beyond the last edge takes the rest."""
    chain = F.when(c < edges[0], F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        upper = c < edges[i + 1] if i + 1 < len(edges) else F.lit(True)
        chain = chain.when(c.isNotNull() & upper, label)
    return chain


def binned(
    df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str],
    aggs: Sequence[Column] = (), by: Sequence[str] = (),
) -> DataFrame:
    label = bin_label(F.col(col), edges, labels)
    return (
        df.withColumn("bin", label).where("bin is not null")
        .groupBy(*by, "bin").agg(n_rows(), *aggs)
    )


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts; values outside are clipped into the end bins."""
    c = F.least(F.greatest(F.col(col).cast("double"), F.lit(float(lo))), F.lit(float(hi)))
    width = (hi - lo) / bins
    number = F.least(F.floor((c - lo) / width), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, number.alias("bin")).agg(n_rows())
        .withColumn("left_edge", F.col("bin") * width + lo)
    )


def density(
    df: DataFrame, col: str, grid: Sequence[float], bandwidth: float, by: Sequence[str] = (), cells: int = 20
) -> DataFrame:
    """Gaussian density at the grid points.

    Values are counted on cells of bandwidth/`cells` first, so a task handles
    cells and grid points, not rows.
    """
    step = bandwidth / cells
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, F.round(F.col(col).cast("double") / step).cast("bigint").alias("_cell"))
        .agg(n_rows("_c"))
    )
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    z = (F.col("x") - F.col("_cell") * step) / bandwidth
    kernel = F.exp(-0.5 * z * z) / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    return (
        counts.withColumn("x", points)
        .groupBy(*by, "x")
        .agg((F.sum(kernel * F.col("_c")) / F.sum("_c")).alias("density"))
    )


def ecdf(df: DataFrame, col: str, step: float = 1.0, cells: int = 1000) -> DataFrame:
    """Share of rows at or below each value, values rounded up to `step`.

    Running sums go in two levels — inside blocks of `cells` steps, then over
    block totals — so no window spans all the values.
    """
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.ceil(F.col(col) / step).alias("_k")).agg(n_rows())
        .withColumn("_block", F.floor(F.col("_k") / cells))
    )
    blocks = counts.groupBy("_block").agg(F.sum("n").alias("_bn"))
    order = Window.orderBy("_block")
    offsets = blocks.select(
        F.col("_block").alias("_ob"),
        (F.sum("_bn").over(order) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(Window.partitionBy()).alias("_total"),
    )
    inside = F.sum("n").over(Window.partitionBy("_block").orderBy("_k"))
    return (
        counts.withColumn("_inside", inside)
        .join(offsets, F.col("_block") == F.col("_ob"))
        .select(
            (F.col("_k") * step).cast("double").alias("value"), "n",
            ((F.col("_before") + F.col("_inside")) / F.col("_total")).alias("share"),
        )
    )


def pivot(df: DataFrame, row: str | Sequence[str], col: str, values: Sequence[str], agg: Column) -> DataFrame:
    """Rows × listed column values, in the order listed."""
    keys = [row] if isinstance(row, str) else list(row)
    return df.groupBy(*keys).pivot(col, list(values)).agg(agg)


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    v, w = F.col(value), F.col(weight)
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias("weighted_mean")
    )


def mean_std(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(n_rows(), *aggs)


def distribution_stats(
    df: DataFrame, keys: Sequence[str], col: str, min_n: int = 5, *, strategy: str | None = None
) -> DataFrame:
    """Quantiles and IQR of ln(col) per group of at least `min_n` rows."""
    logs = df.where(F.col(col) > 0).withColumn("_ln", F.ln(col))
    spec = {f"p{p}": ("_ln", p / 100) for p in (25, 50, 75, 90, 95)}
    return (
        quantile_table(logs, keys, spec, aggs=[n_rows()], strategy=strategy)
        .where(F.col("n") >= min_n)
        .withColumn("iqr", F.col("p75") - F.col("p25"))
    )


def price_cv(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    c = F.col(col).cast("double")
    return df.groupBy(*keys).agg((F.stddev_samp(c) / (F.avg(c) + 1)).alias("cv"))


def funnel(stages: Mapping[str, DataFrame], brand: str = "brand", model: str = "model") -> DataFrame:
    """Rows, brands and models after each named stage."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        per_pair = df.groupBy(brand, model).agg(n_rows())
        row = per_pair.agg(
            F.lit(i).alias("step"), F.lit(name).alias("stage"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.countDistinct(brand).alias("n_brands"), F.countDistinct(model).alias("n_models"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def group_size_report(df: DataFrame, keys: Sequence[str], threshold: int, by: str | None = None) -> DataFrame:
    """Groups, small groups and the rows in each kind; optionally per value of one key."""
    sizes = df.groupBy(*keys).agg(n_rows())
    small = F.col("n") < threshold
    spec = {"median_size": ("n", 0.5)}
    return quantile_table(
        sizes, [by] if by else [], spec,
        aggs=[
            n_rows("n_groups"), F.count_if(small).alias("n_small"),
            F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("rows_small"),
            F.coalesce(F.sum(F.when(~small, F.col("n"))), F.lit(0)).alias("rows_large"),
        ],
    )


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, by seeded hash order; only n rows per task leave the map side."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(*total_order(df, [draw])).limit(n)


def five_number(
    df: DataFrame, by: Sequence[str], col: str, whisker: float = 1.5, *, strategy: str | None = None
) -> DataFrame:
    """Quartiles, whisker ends inside the fences, and the number of outliers."""
    spec = {"q1": (col, 0.25), "median": (col, 0.5), "q3": (col, 0.75)}
    quartiles = quantile_table(df, by, spec, strategy=strategy).withColumn(
        "_reach", (F.col("q3") - F.col("q1")) * whisker
    )
    c = F.col(col).cast("double")
    inside = c.between(F.col("q1") - F.col("_reach"), F.col("q3") + F.col("_reach"))
    return (
        join_on(df.where(F.col(col).isNotNull()), quartiles, list(by))
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            n_rows(), F.min(F.when(inside, c)).alias("low"), F.max(F.when(inside, c)).alias("high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def keep_top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n most frequent groups; ties go to the smaller key, null is a key of its own."""
    top = df.groupBy(key).agg(n_rows()).orderBy(F.desc("n"), F.asc(key)).limit(n)
    return join_on(df, settle(top.select(key)), [key], "left_semi")


def extremes(df: DataFrame, col: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The n highest and n lowest rows, with the end they come from."""
    high = df.orderBy(F.desc_nulls_last(col), *tie).limit(n).withColumn("end", F.lit("high"))
    low = df.orderBy(F.asc_nulls_last(col), *tie).limit(n).withColumn("end", F.lit("low"))
    return high.unionByName(low)


def label_order(col: str, labels: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col)).cast("int")


def order_by_labels(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    return df.withColumn("label_order", label_order(col, labels)).orderBy("label_order")


def best_row(
    df: DataFrame, metric: str, by: Sequence[str] = (), tie: Sequence[str] = (), largest: bool = False
) -> DataFrame:
    """The row with the smallest (or largest) metric, over all or per group."""
    first = F.desc_nulls_last(metric) if largest else F.asc_nulls_last(metric)
    order = total_order(df, [first, *[F.asc(t) for t in tie]])
    if not by:
        return df.orderBy(*order).limit(1)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def order_latest(df: DataFrame, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), *tie)


def market_share(
    df: DataFrame, key: str, rare: int = 50, common: int = 2000
) -> DataFrame:
    """Each row with the count and share of its group, and rare / common flags."""
    counts = df.groupBy(key).agg(n_rows(f"{key}_count"))
    total = counts.agg(F.sum(f"{key}_count").alias("_total"))
    shares = with_one_row(counts, total).select(
        key, f"{key}_count",
        F.try_divide(f"{key}_count", "_total").alias(f"{key}_market_share"),
        (F.col(f"{key}_count") < rare).cast("int").alias(f"is_rare_{key}"),
        (F.col(f"{key}_count") > common).cast("int").alias(f"is_common_{key}"),
    )
    return join_on(df, settle(shares), [key], "left")


def with_group_stat(
    df: DataFrame, keys: Sequence[str], col: str, stat: str, out: str | None = None
) -> DataFrame:
    """A group statistic ('median', 'avg', 'count', …) beside every row of the group.

    Aggregated first and joined back: a window would pull a hot group into one task.
    """
    out = out or f"{col}_{stat}"
    if stat == "median":
        table = quantile_table(df, keys, {out: (col, 0.5)})
    else:
        table = settle(df.groupBy(*keys).agg(getattr(F, stat)(F.col(col)).alias(out)))
    return join_on(df, table, list(keys), "left")


def with_share(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of all rows held by the row's group."""
    counts = df.groupBy(*keys).agg(n_rows("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    shares = with_one_row(counts, total).select(*keys, F.try_divide("_n", "_total").alias("share"))
    return join_on(df, settle(shares), list(keys), "left")


def relative_flags(
    df: DataFrame, key: str, col: str, lo: float = 0.25, hi: float = 0.9, *, strategy: str | None = None
) -> DataFrame:
    """Is the value below the low or above the high quantile of its group?"""
    table = quantile_table(df, [key], {"_lo": (col, lo), "_hi": (col, hi)}, strategy=strategy)
    return (
        join_on(df, table, [key], "left")
        .withColumn(f"is_high_{col}_within_{key}", (F.col(col) > F.col("_hi")).cast("int"))
        .withColumn(f"is_low_{col}_within_{key}", (F.col(col) < F.col("_lo")).cast("int"))
        .drop("_lo", "_hi")
    )


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate beside every row."""
    return with_one_row(df, scalars)


def combinations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()

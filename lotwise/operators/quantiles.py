"""Exact quantiles per group, with linear interpolation.

How a group is treated depends on its own number of rows and on nothing else. A
group of up to ROWS_IN_CELL rows is one sort: Spark's ``percentile``. The rows of
a larger one are counted per (group, value cell), with a partial count in each
task; cells follow the logarithm of the value. The counts say which cells hold a
wanted rank, and only the rows of these are shuffled, collapsed by value and
sorted. Cells with more than ROWS_IN_CELL rows are cut again, by their own range
of values, until none that is sorted holds more, so neither a group that owns a
third of all rows nor values close together gather in one task. The input is read
two or three times and has to give the same rows each time: settle samples and
other random frames first. Counts are settled when the table is asked for; the
rest runs with whatever uses it.

`rollup_quantiles` answers many groupings of the same rows at once: one table of
counts per finest group and cell, of which all others are sums.

Strategies that can be asked for by name: ``ranked``, cells for every group;
``plain``, ``percentile`` for every group; ``approx``, ``percentile_approx``, for
callers who accept an error bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.operators.keys import join_on
from lotwise.scale import settle

Spec = Mapping[str, tuple[str, float]]

# Cells per factor e of a value, and the size below which values share one cell.
CELLS_PER_E, SMALLEST = 64, 1e-6
# A cell with more distinct values is cut into so many parts of its range, again and again.
ROWS_IN_CELL, PARTS = 200_000, 1024


def quantile_table(
    df: DataFrame,
    keys: Sequence[str],
    spec: Spec,
    *,
    aggs: Sequence[Column] = (),
    weight: str | None = None,
    strategy: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group: keys, `aggs`, then the named quantiles.

    `spec` maps an output name to (column, q). `weight` is a row multiplicity.
    """
    keys = list(keys)
    if strategy is None:
        return _by_size(df, keys, spec, list(aggs), weight)
    if strategy == "ranked":
        return _ranked(df, keys, spec, list(aggs), weight)
    if strategy not in ("plain", "approx"):
        raise ValueError(f"unknown quantile strategy {strategy!r}")
    return _by_aggregate(df, keys, spec, list(aggs), weight, strategy, accuracy)


def _columns_of(spec: Spec) -> list[str]:
    return list(dict.fromkeys(column for column, _ in spec.values()))


def _by_aggregate(df, keys, spec, aggs, weight, strategy, accuracy) -> DataFrame:
    wanted = {c: [q for col, q in spec.values() if col == c] for c in _columns_of(spec)}

    def vector(c: str) -> Column:
        qs = F.array(*[F.lit(q) for q in wanted[c]])
        value = F.col(c).cast("double")
        if strategy == "approx":
            return F.percentile_approx(value, qs, accuracy)
        return F.percentile(value, qs, F.col(weight) if weight else F.lit(1))

    grouped = df.groupBy(*keys).agg(
        *aggs, *[vector(c).alias(f"__v{i}") for i, c in enumerate(wanted)]
    )
    position = {c: i for i, c in enumerate(wanted)}
    picks = [
        F.get(F.col(f"__v{position[c]}"), F.lit(wanted[c].index(q))).alias(name)
        for name, (c, q) in spec.items()
    ]
    own = [c for c in grouped.columns if not c.startswith("__v")]
    return grouped.select(*own, *picks)


def _cell(value: Column) -> Column:
    """A whole number that never falls as the value grows; NaN comes last."""
    size = F.floor(F.log1p(F.abs(value) / SMALLEST) * CELLS_PER_E)
    return F.when(F.isnan(value), F.lit(1 << 40)).otherwise(F.signum(value).cast("bigint") * F.least(size, F.lit(1 << 39)))


def _by_size(df, keys, spec, aggs, weight) -> DataFrame:
    """Small groups by one sort each, large ones by cells."""
    sizes = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")))
    large = F.col("__rows") > ROWS_IN_CELL
    count = sizes.agg(F.count_if(large).alias("large"), F.count_if(~large).alias("small")).first()
    if not count.large:
        return _by_aggregate(df, keys, spec, aggs, weight, "plain", 0)
    if not count.small:
        return _ranked(df, keys, spec, aggs, weight)
    parts = [join_on(df, sizes.where(which).select(*keys), keys, "left_semi") for which in (~large, large)]
    return _by_aggregate(parts[0], keys, spec, aggs, weight, "plain", 0).unionByName(_ranked(parts[1], keys, spec, aggs, weight))


def _long(df, keys, columns: Sequence[str], weight: str | None) -> DataFrame:
    """A row per row and measure: its number, value, weight and cell."""
    weighted = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    measures = F.array(*[
        F.struct(F.lit(i).alias("__m"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(columns)
    ])
    return df.select(*keys, weighted.alias("__w"), F.inline(measures)).withColumn("__r", _cell(F.col("__v")))


def _counted() -> Column:
    return F.sum(F.when(F.col("__v").isNotNull(), F.col("__w")).otherwise(0))


def _ranks(q: float) -> tuple[Column, Column, Column]:
    at = F.lit(q) * (F.col("__n") - 1)
    return F.floor(at), F.ceil(at), at


def _covers(rank: Column, start: Column, size: Column) -> Column:
    return (rank >= start) & (rank < start + size)


def _holds_a_rank(spec: Spec) -> Column:
    columns, hit = _columns_of(spec), F.col("__n") == 0
    for c, q in spec.values():
        low, high, _ = _ranks(q)
        mine = F.col("__m") == columns.index(c)
        start, size = F.col("__base"), F.col("__rc")
        hit = hit | (mine & (_covers(low, start, size) | _covers(high, start, size)))
    return hit


def _hit_cells(cells: DataFrame, keys: Sequence[str], spec: Spec) -> DataFrame:
    """The cells (keys, __m, __r, __rc rows by weight, __rows, __lo, __hi) that hold a wanted rank, with the number of
    rows before them and in all, settled."""
    series = [*keys, "__m"]
    before = Window.partitionBy(*series).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        cells.withColumn("__base", F.coalesce(F.sum("__rc").over(before), F.lit(0)))
        .withColumn("__n", F.sum("__rc").over(Window.partitionBy(*series)))
    )
    return settle(ranked.where(_holds_a_rank(spec)).select(*series, "__r", "__base", "__n", "__rows", "__lo", "__hi"))


def _picked(values: DataFrame, needed: DataFrame, keys: Sequence[str], spec: Spec) -> DataFrame:
    """The quantiles, from the distinct values (with counts __c) of the rows in the cells `needed`."""
    columns, series = _columns_of(spec), [*keys, "__m"]
    kept = [*series, "__r", "__base", "__n"]

    def most() -> int:
        return needed.agg(F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__rows")))).first()[0] or 0

    if most() > ROWS_IN_CELL:
        values = settle(values)
    while most() > ROWS_IN_CELL:
        # cut every cell by its range; a part is again a cell, with its own range
        bounds = needed.select(*series, "__r", "__lo", "__hi")
        inside = join_on(values, bounds, [*series, "__r"])
        width = F.col("__hi") - F.col("__lo")
        part = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width * PARTS), F.lit(PARTS - 1))).otherwise(0)
        inside = inside.withColumn("__part", part)
        at = Window.partitionBy(*series, "__r").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = inside.groupBy(*kept, "__part").agg(
            F.sum("__c").alias("__rc"), F.count("__v").alias("__rows"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        parts = parts.withColumn("__start", F.col("__base") + F.coalesce(F.sum("__rc").over(at), F.lit(0)))
        hit = parts.drop("__base").withColumnRenamed("__start", "__base").where(_holds_a_rank(spec))
        hit = settle(hit.withColumn("__cell", F.xxhash64("__r", "__part")))
        same = inside.drop("__base", "__n", "__lo", "__hi").join(
            hit.select(*[F.col(c).alias(f"__k_{c}") for c in [*series, "__r", "__part"]], "__cell", "__base", "__n"),
            [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*series, "__r", "__part"]])
        values = settle(same.select(*series, F.col("__cell").alias("__r"), "__base", "__n", "__v", "__c"))
        needed = hit.select(*series, F.col("__cell").alias("__r"), "__base", "__n", "__rows", "__lo", "__hi")

    in_cell = (
        Window.partitionBy(*series, "__r").orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = values.withColumn("__start", F.col("__base") + F.coalesce(F.sum("__c").over(in_cell), F.lit(0)))
    found = []
    for i, (c, q) in enumerate(spec.values()):
        low, high, at = _ranks(q)
        mine = F.col("__m") == columns.index(c)
        for tag, rank in (("l", low), ("h", high)):
            found.append(
                F.max(F.when(mine & _covers(rank, F.col("__start"), F.col("__c")), F.col("__v")))
                .alias(f"__{tag}{i}")
            )
        found.append(F.max(F.when(mine, at)).alias(f"__p{i}"))

    def between(i: int) -> Column:
        # as Spark's percentile does, to the last bit
        low, high, at = F.col(f"__l{i}"), F.col(f"__h{i}"), F.col(f"__p{i}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return placed.groupBy(*keys).agg(*found).select(*keys, *[between(i).alias(name) for i, name in enumerate(spec)])


def _ranked(df, keys, spec, aggs, weight) -> DataFrame:
    """Count per cell, find the cells that hold a wanted rank, and sort only these."""
    series = [*keys, "__m"]
    long = _long(df, keys, _columns_of(spec), weight)
    cells = long.groupBy(*series, "__r").agg(
        _counted().alias("__rc"), F.count("__v").alias("__rows"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    needed = _hit_cells(cells, keys, spec)
    kept = [*series, "__r", "__base", "__n"]
    held = join_on(long, needed.select(*kept), [*series, "__r"])
    values = held.groupBy(*kept, "__v").agg(_counted().alias("__c"))
    table = _picked(values, needed, keys, spec)
    if not aggs:
        return table
    return join_on(df.groupBy(*keys).agg(*aggs), table, keys, "left")


Stats = Mapping[str, tuple[str, str]]


def rollup_quantiles(
    df: DataFrame, keys: Sequence[str], groups: Column, spec: Spec, *, n: str = "n", stats: Stats | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Quantiles of many groupings of the same rows, from one table of counts.

    `groups` is an array of structs made of the finest `keys`: the groups that a row with these keys belongs to, of any
    level (its own, its neighbours', its brand's, all). A row of the result has the fields of a group, its number of rows
    `n`, `stats` and the quantiles. `stats` maps a name to (kind, column), kinds count, mean and std (of the population).

    The rows are counted once per (keys, measure, value cell), with sums; the groups' counts are sums of these. Which cells
    hold a wanted rank is seen there, and rows are read again only for the finest cells that belong to one. `wanted`
    (columns as the fields of a group) limits the result to these groups.
    """
    stats = dict(stats or {})
    columns = list(dict.fromkeys([*_columns_of(spec), *[c for _, c in stats.values()]]))
    fields = [f.name for f in df.select(*keys).select(groups.alias("g")).schema["g"].dataType.elementType]
    long = _long(df, keys, columns, None)
    v = F.col("__v")
    finest = settle(long.groupBy(*keys, "__m", "__r").agg(
        F.count(F.lit(1)).alias("__all"), F.count(v).alias("__rc"), F.min(v).alias("__lo"), F.max(v).alias("__hi"),
        F.sum(v).alias("__s"), F.sum(v * v).alias("__ss")))
    spread = finest.select(
        *[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in finest.columns if c not in keys], F.inline(groups))
    if wanted is not None:
        spread = join_on(spread, wanted.select(*fields), fields, "left_semi")
    cells = settle(spread.groupBy(*fields, "__m", "__r").agg(
        F.sum("__all").alias("__all"), F.sum("__rc").alias("__rc"), F.sum("__rc").alias("__rows"),
        F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("__s").alias("__s"), F.sum("__ss").alias("__ss")))

    def stat(kind: str, column: str) -> Column:
        mine = F.col("__m") == columns.index(column)
        count, total, squares = (F.sum(F.when(mine, F.col(c))) for c in ("__rc", "__s", "__ss"))
        mean = F.try_divide(total, count)
        if kind == "std":
            return F.sqrt(F.greatest(F.try_divide(squares, count) - mean * mean, F.lit(0.0)))
        return {"count": F.coalesce(count, F.lit(0)), "mean": mean}[kind]

    sums = cells.groupBy(*fields).agg(
        F.sum(F.when(F.col("__m") == 0, F.col("__all"))).alias(n), *[stat(*s).alias(name) for name, s in stats.items()])
    if not spec:
        return sums
    sorted_ = cells.where(F.col("__m") < len(_columns_of(spec)))
    needed = _hit_cells(sorted_.select(*fields, "__m", "__r", "__rc", "__rows", "__lo", "__hi"), fields, spec)
    kept = [*fields, "__m", "__r", "__base", "__n"]
    homes = join_on(spread.select(*[f"__of_{k}" for k in keys], *fields, "__m", "__r"), needed.select(*kept), [*fields, "__m", "__r"])
    own = long.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__m", "__r", "__v")
    held = join_on(own, settle(homes), [*[f"__of_{k}" for k in keys], "__m", "__r"])
    values = held.groupBy(*kept, "__v").agg(F.count("__v").alias("__c"))
    return join_on(sums, _picked(values, needed, fields, spec), fields, "left")


def quantiles(df: DataFrame, col: str, qs: Sequence[float], *, strategy: str | None = None) -> DataFrame:
    """Quantile vector of one column as rows (q, value)."""
    spec = {f"v{i}": (col, q) for i, q in enumerate(qs)}
    one = quantile_table(df, [], spec, strategy=strategy)
    rows = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.col(f"v{i}").alias("value")) for i, q in enumerate(qs)
    ])
    return one.select(F.inline(rows))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], qs: Sequence[float],
    *, strategy: str | None = None,
) -> DataFrame:
    """Per group, columns '<col>_p<100q>' for every column and q."""
    spec = {f"{c}_p{round(q * 100)}": (c, q) for c in cols for q in qs}
    return quantile_table(df, keys, spec, strategy=strategy)


def for_targets(df: DataFrame, targets: DataFrame, keys: Sequence[str], band: str, k: int) -> DataFrame:
    """Each row of `df` once for every target (keys, band) within ±k of its own band, which becomes the target's.

    The few targets are spread over the bands they ask for, and the rows meet them by an equality: a row that no target
    asks for is never copied.
    """
    asked = targets.select(
        *[F.col(c).alias(f"__t_{c}") for c in keys], F.col(band).alias("__target"),
        F.explode(F.sequence(F.col(band) - k, F.col(band) + k)).alias("__source"))
    same = F.col(band) == F.col("__source")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    rest = [c for c in df.columns if c != band]
    return df.join(asked, same).select(*rest, F.col("__target").alias(band)).select(*df.columns)


def pooled_quantiles(
    df: DataFrame, keys: Sequence[str], band: str, spec: Spec, k: int = 1,
    *, n: str = "n_pool", strategy: str | None = None,
) -> DataFrame:
    """Quantiles of all rows within ±k of each existing (keys, band) group."""
    by = [*keys, band]
    if strategy is not None:
        pool = for_targets(df, settle(df.select(*by).distinct()), keys, band, k)
        return quantile_table(pool, by, spec, aggs=[F.count(F.lit(1)).alias(n)], strategy=strategy)
    return rollup_quantiles(df, by, around(keys, band, k), spec, n=n, wanted=settle(df.select(*by).distinct()))


def group_of(**fields: Column) -> Column:
    """One group of a rollup, by the values of its fields."""
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def around(keys: Sequence[str], band: str, k: int) -> Column:
    """The groups (keys, band) within ±k of a row's band: those whose pool it belongs to."""
    return F.transform(F.sequence(F.col(band) - k, F.col(band) + k), lambda y: F.struct(*[F.col(c) for c in keys], y.alias(band)))

"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lotwise.scale import settle

# What counts as one word: code points other than these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
# The mix takes this many times all words, and at most so many times a source or a document.
SHARE, MOST = 1.5, 2
SEED = "mix"

# A random number has that many bits of a hash, a place in the order that many, cut by ranges of STEP bits until a range
# has few rows.
HASH_BITS, BITS, STEP = 60, 48, 12
ROWS_IN_RANGE = 5_000


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) rows -> one row per source with source_size, n_docs, weight and target.

    Sources stand in code-point order, null last, and weigh `weights` in turn. They share `share` times all words by
    weight; a target stops at `most` times the source's size, and what is above is shared again by weight until none
    is above. Ranks are formed per range of sources, so that no task sees all of them; the sums per range and per
    round come to the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranged = settle(
        by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    per_part = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, start = 0, {}
    for part in sorted(per_part):
        start[part], before = before, before + per_part[part]
    offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv]) if start else F.create_map()
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    place = (rank + (offset[F.col("part")] if start else 0)) % len(weights)
    ranked = settle(ranged.select(
        "source", "source_size", "n_docs", F.array(*[F.lit(float(w)) for w in weights])[place].alias("weight")))

    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # a source whose size is 0 stops at 0
        above = F.col("source_size") * float(most) <= F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, F.col("source_size"))).alias("taken"),
            F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if row.n == capped or not row.open:
            break
        capped, level = row.n, (share * total - most * (row.taken or 0)) / row.open
    return ranked.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): size, source_size, target, copies and taken = copies * size.

    A source's inclusion is target / size. Its whole part are copies of every document, taken for certain; the rest, p, is
    sampled in Pareto order. A document's inclusion odds are p / (1 - p) times the root of its size over the mean size of
    its source's documents: a longer one fills more of the target at once and is likelier to, but less than in proportion.
    Documents of a source rank by (u / (1 - u)) / odds, u from a hash of the doc_id (without one, of the text) and the
    seed, and the first ones whose words fill what is left of the target are taken. The last one is
    taken if the sum comes closer to the target with it than without, so a source misses its target by half a
    document at most. Only the range of ranks in which a source's sum reaches the target is ordered row by row; all
    other ranges are taken or left whole, by sums that are formed before the shuffle.

    Null or empty texts have size 0. Null sources are a source of their own, the last. Rows that repeat a doc_id tie;
    ties are ordered by size, and rows equal in both are alike. Other columns are left out; no rows give no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    sized = settle(docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"),
        # the first 15 hexadecimal digits
        F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("dice")))
    targets = settle(
        source_targets(sized.select("source", "size"), weights, share, most)
        .withColumn("inclusion", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("inclusion"))
        .withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    ranks = targets.select(F.col("source").alias("of"), "n_docs", F.col("source_size").alias("all_words"), (F.col("inclusion") - F.col("whole")).alias("p"))
    sized = settle(
        sized.join(ranks, sized.source.eqNullSafe(ranks.of), "left")
        .select("doc_id", "source", "size", _rank(F.col("dice"), F.col("size"), F.col("all_words"), F.col("n_docs"), F.col("p")).alias("bits")))
    cuts = _cuts(sized, targets)

    same = sized.source.eqNullSafe(cuts.source)
    rows = sized.join(cuts, same, "left").select(sized["*"], *[cuts[c] for c in cuts.columns if c != "source"])
    prefix = F.expr("shiftright(bits, shift)")
    rows = rows.withColumn("place", F.when(prefix < F.col("cut"), -1).when(prefix > F.col("cut"), 1).otherwise(0))
    # the few rows of the range that holds the end of a source's sample
    pi = F.col("inclusion") - F.col("whole")
    order = W.partitionBy("source").orderBy("bits", "doc_id", "size")
    so_far = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before") - F.col("size")
    edge = rows.where("place = 0").withColumn("extra", (so_far + F.col("size") / 2 <= F.col("wanted")) & (pi > 0))
    rest = rows.where("place <> 0").withColumn("extra", (F.col("place") < 0) & (pi > 0))
    copies = (F.col("whole") + F.col("extra").cast("int")).cast("bigint")
    return edge.unionByName(rest).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def _rank(dice: Column, size: Column, all_words: Column, n_docs: Column, p: Column) -> Column:
    """Place of a document in Pareto order, as a whole number of BITS bits: x / (1 + x) of x = (u / (1 - u)) / odds, which
    is u / (u + (1 - u) odds). Documents without inclusion come last."""
    u = (dice + 0.5) / F.lit(float(1 << HASH_BITS))
    odds = p / (1.0 - p) * F.sqrt(size * n_docs / all_words)
    last = F.lit((1 << BITS) - 1)
    place = F.floor(u / (u + (1.0 - u) * odds) * F.lit(float(1 << BITS)))
    return F.when((all_words > 0) & (p > 0) & (p < 1), F.least(place, last)).otherwise(last).cast("bigint")


def _cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the range of random numbers (cut, at `shift` bits) where the sum of sizes passes what is wanted, and
    the words before it. The range is cut again for all sources until none holds over ROWS_IN_RANGE rows."""
    def split(found: DataFrame, shift: int) -> DataFrame:
        key = F.expr(f"shiftright(bits, {shift})")
        inside = F.expr(f"shiftright(bits, {min(shift + STEP, BITS)})") == F.col("cut")
        same = sized.source.eqNullSafe(found.source)
        sums = (
            sized.join(found, same).where(inside).select(found["*"], "bits", "size")
            .groupBy("source", key.alias("piece")).agg(
                F.sum("size").alias("words"), F.count("*").alias("n"), F.first("before").alias("before"),
                F.first("wanted").alias("wanted"))
        )
        order = W.partitionBy("source").orderBy("piece")
        ahead = F.col("before") + F.sum("words").over(order) - F.col("words")
        last = F.row_number().over(W.partitionBy("source").orderBy(F.col("piece").desc()))
        # the last range that starts before the wanted sum is reached
        reached = sums.withColumn("ahead", ahead).where("ahead <= wanted").withColumn("last", last).where("last = 1")
        return settle(reached.select(
            "source", F.col("piece").alias("cut"), F.col("ahead").alias("before"), "wanted", "n"))

    shift = BITS - STEP
    found = targets.select("source", F.lit(0).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("before"), "wanted")
    found = split(found, shift)
    while shift > 0 and (found.agg(F.max("n")).first()[0] or 0) > ROWS_IN_RANGE:
        shift -= STEP
        found = split(found, shift)
    same = targets.source.eqNullSafe(found.source)
    return targets.join(found.drop("wanted"), same).select(
        targets["*"], "cut", "before", F.lit(shift).alias("shift"))

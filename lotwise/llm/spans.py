"""Matches of patterns in texts by built-in functions, in time proportional to the text however many there are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Arrays are run through in parts of so many items.
PART = 128


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: an expression is computed at every use, a lambda's variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of some ints, what those before it add up to: parts by themselves, then what is before each part. An array
    that grows by one item at a time is copied each time, so only short ones do."""
    def before(items: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("done"))
        return F.aggregate(items, state, lambda s, x: F.struct(
            add(s["at"], x).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done")), lambda s: s["done"])

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(PART))
        return bind(F.transform(starts, lambda at: F.slice(v, at, PART)), joined)

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), add))
        return bind(before(totals, F.lit(zero)), lambda first: F.flatten(F.transform(
            F.arrays_zip(parts.alias("p"), first.alias("f")), lambda x: before(x["p"], x["f"]))))

    return bind(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, string, before, after), code points from 0, of the matches of a pattern, leftmost and one after the
    other; before and after are the texts between this match and the next ones."""
    gaps, strings = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(F.struct(gaps.alias("g"), strings.alias("m")), lambda found: placed(
        F.slice(found["g"], 1, F.size(found["m"])), found["m"], F.slice(found["g"], 2, F.size(found["m"]))))


def placed(gaps: Column, strings: Column, after: Column | None = None) -> Column:
    """Spans of `strings`, each behind its gap."""
    parts = F.arrays_zip(gaps.alias("g"), strings.alias("m"), (gaps if after is None else after).alias("a"))

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"]))
        return F.transform(F.arrays_zip(p.alias("p"), running(lengths, lambda a, b: a + b, 0).alias("at")), span)

    def span(x: Column) -> Column:
        first = x["at"] + F.length(x["p"]["g"])
        return F.struct(
            first.alias("s"), (first + F.length(x["p"]["m"])).alias("e"), x["p"]["m"].alias("string"), x["p"]["g"].alias("before"),
            x["p"]["a"].alias("after"))

    return bind(parts, spans)


def free_of(spans: Column, blockers: Column) -> Column:
    """Those of `spans` that overlap none of `blockers` (structs with s and e): both in one order, each meets the furthest
    end before it and the nearest start behind it."""
    top = (1 << 31) - 1
    tagged = F.concat(
        F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(False).alias("b"), x["e"].alias("e"), x.alias("x"))),
        F.transform(blockers, lambda x: F.struct(x["s"].alias("s"), F.lit(True).alias("b"), x["e"].alias("e"), F.get(F.slice(spans, 1, 0), F.lit(0)).alias("x"))))

    def order(a: Column, b: Column) -> Column:
        return F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0)

    def kept(items: Column) -> Column:
        ends = running(F.transform(items, lambda x: F.when(x["b"], x["e"]).otherwise(-1)), lambda a, b: F.greatest(a, b), -1)
        starts = running(
            F.transform(F.reverse(items), lambda x: F.when(x["b"], x["s"]).otherwise(top)), lambda a, b: F.least(a, b), top)
        zipped = F.arrays_zip(items.alias("i"), ends.alias("end"), F.reverse(starts).alias("start"))
        free = F.filter(zipped, lambda z: ~z["i"]["b"] & (z["end"] <= z["i"]["s"]) & (z["start"] >= z["i"]["e"]))
        return F.transform(free, lambda z: z["i"]["x"])

    return F.when((F.size(spans) == 0) | (F.size(blockers) == 0), spans).otherwise(bind(F.array_sort(tagged, order), kept))

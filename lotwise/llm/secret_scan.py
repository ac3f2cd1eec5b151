"""Secrets in texts: known shapes, and strings whose characters look random."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.llm.spans import bind, matches, placed

# Shapes of secrets; fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "entropy")

# Paths: four or more parts, each of words, numbers, or words with a number of at most four digits. Random characters
# are no such part but for very short ones, so a path ends where they begin.
WORD = r"(?:(?:(?:[A-Z]*+[a-z]{2,}+)++|[A-Z]++|[a-z])[0-9]{0,4}+|[0-9]++)(?![A-Za-z0-9+])"
PATH = rf"(?:/++{WORD}(?:[_=-]++{WORD})*+(?![_=-])){{4,}}+"
# Candidate strings of the entropy scan: paths, and runs of these characters up to the next path.
CANDIDATE = rf"{PATH}|(?:(?!{PATH})[A-Za-z0-9+/_=-]){{20,}}+"
# Character classes: name -> (its characters, length of the window, bits per character from which a window counts).
CLASSES = {"hex": ("0-9a-fA-F", 20, 3.0), "upper": ("A-Z0-9", 20, 3.5), "base64": ("A-Za-z0-9+/_=-", 24, 4.0)}
# A run of a class has so many characters; windows are slid over so many places at a time.
LEAST_RUN, SEGMENT = 20, 2048
# Strings that only look random: UUIDs, lower- or upper-case words, numbers, paths, words with one that says it is a
# sample, the keys in the documentation of AWS. Each entry is the whole candidate.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]*$", r"^[0-9+/_=-]*$", rf"^{PATH}$",
    rf"^(?=.*(?i:example|sample|placeholder|changeme|xxxx))[+/_=-]*+{WORD}(?:[+/_=-]++{WORD})*+[+/_=-]*+$",
    r"^A[KS]IA[A-Z0-9]{1,9}EXAMPLE$", r"^[A-Za-z0-9+/]{30}EXAMPLEKEY$",
)


def _found(text: Column, pattern: str, kind: str, passes, may: Column) -> Column:
    """Spans of what a pattern matches, one after the other, of texts that `may` hold a match."""
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    spans = F.transform(F.filter(matches(text, pattern), lambda m: passes(m["string"])), lambda m: F.struct(
        m["s"], m["e"], F.lit(KINDS.index(kind)).alias("k")))
    return F.when(may & F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def _candidates(text: Column) -> Column:
    """Spans (s, e) and strings, from 0, of the candidates that the allow-list doesn't name. What follows a path tells where it ends,
    so a string alone doesn't tell its place: that comes from the text between the candidates."""
    pattern = F.lit(rf"(?s)(.*?)({CANDIDATE}|\z)")
    gaps, strings = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2))
    spans = F.transform(F.filter(placed(gaps, strings), lambda m: (F.length(m["string"]) > 0) & ~_allowed(m["string"])), lambda m: F.struct(
        m["s"], m["e"], m["string"]))
    # most texts have no run of that length; that is quickly seen
    return F.when(F.regexp_like(text, F.lit(r"[A-Za-z0-9+/_=-]{20}")), spans).otherwise(F.array().cast("array<struct<s:int,e:int,string:string>>"))


def _total(c: Column) -> Column:
    """c * log2 c of a count in a window."""
    most = max(width for _, width, _ in CLASSES.values())
    return F.get(F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(most + 1)]), c)


def _most_total(width: int, bits: float) -> list[float]:
    """By the number of characters in a window, the largest sum of c * log2 c with which its entropy counts: bits per
    character, of a shorter window the same share of what it could have at most. Half the smallest step of the sum is added
    for what the additions round."""
    return [n * math.log2(n) * (1 - bits / math.log2(width)) + 1e-9 if n > 1 else 0.0 for n in range(width + 1)]


def _windows(string: Column, characters: str, width: int, bits: float) -> Column:
    """Spans (s, e), from 0, of the windows of `width` characters, all of one class, whose Shannon entropy is at least
    `bits`; of a shorter run of the class, of LEAST_RUN characters at least, the run is the window.

    Runs of the class are cut in segments that overlap by a window, which keeps the work in proportion to the length. The
    window slides by one character: its sum of c * log2 c changes by the counts of the character that enters and of the
    one that leaves. Entropy = log2 width - sum / width.
    """
    pattern = f"[{characters}]{{{LEAST_RUN},}}+"
    none = F.array().cast("array<struct<s:int,e:int>>")
    limits = F.array(*[F.lit(x) for x in _most_total(width, bits)])

    def in_run(run: Column) -> Column:
        n = F.length(run["string"])
        whole = F.struct(F.least(F.lit(width), n).alias("w"), run["s"].alias("at"), F.slice(F.split(run["string"], ""), 1, n).alias("c"))
        return bind(whole, lambda r: F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(r["c"]) - r["w"], F.lit(SEGMENT)), lambda at: bind(segment(r, at), slide))))

    def segment(r: Column, at: Column) -> Column:
        return F.struct(r["w"], (r["at"] + at).alias("at"), F.slice(r["c"], at + 1, r["w"] + SEGMENT - 1).alias("c"))

    def count_of(c: Column, first: Column, w: Column, x: Column) -> Column:
        return F.size(F.filter(F.slice(c, first, w), lambda y: y == x))

    def slide(r: Column) -> Column:
        c, w, offset = r["c"], r["w"], r["at"]
        of_first = F.aggregate(F.slice(c, 1, w), F.lit(0.0), lambda sum_, x: sum_ + bind(
            count_of(c, F.lit(1), w, x), lambda n: _total(n) / n))
        begin = F.struct(of_first.alias("total"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("done"))

        def step(state: Column, i: Column) -> Column:
            old, new = count_of(c, i - w, w, F.get(c, i - w - 1)), count_of(c, i - w + 1, w, F.get(c, i - 1))
            change = bind(F.struct(old.alias("o"), new.alias("n")), lambda x: (
                _total(x["o"] - 1) - _total(x["o"]) + _total(x["n"]) - _total(x["n"] - 1)))
            return bind(F.when(i == w, state["total"]).otherwise(state["total"] + change), lambda t: moved(state, i, t))

        def moved(state: Column, i: Column, total: Column) -> Column:
            hit = total <= F.get(limits, w)
            joins = state["e"] >= i - w
            closed = hit & ~joins & (state["e"] >= 0)
            return F.struct(
                total.alias("total"), F.when(hit & ~joins, i - w).otherwise(state["s"]).alias("s"),
                F.when(hit, i).otherwise(state["e"]).alias("e"),
                F.when(closed, F.concat(state["done"], F.array(F.struct(state["s"].alias("s"), state["e"].alias("e"))))).otherwise(state["done"]).alias("done"))

        def finish(state: Column) -> Column:
            last = F.when(state["e"] >= 0, F.array(F.struct(state["s"].alias("s"), state["e"].alias("e")))).otherwise(none)
            return F.transform(F.concat(state["done"], last), lambda x: F.struct((x["s"] + offset).alias("s"), (x["e"] + offset).alias("e")))

        return F.aggregate(F.sequence(w, F.size(c)), begin, step, finish)

    runs = F.when(F.regexp_like(string, F.lit(pattern)), F.flatten(F.transform(matches(string, pattern), in_run)))
    return F.coalesce(runs, none)


def scan(docs: DataFrame, text: str = "text", to: str = "secret_spans") -> DataFrame:
    """`docs` with a column `to`: array of (s, e, k), code points from 0, end exclusive, k a place in KINDS, by
    start and kind. Built-in functions only; nothing is shuffled.

    Known shapes: values assigned to names of secrets, access keys, and runs of hexadecimal digits; matches are the
    leftmost non-overlapping ones of each kind. Entropy: in each candidate string, the windows of one character class
    whose entropy is high, merged; a candidate that is an entry of ALLOWED as a whole gives none, and paths are candidates
    of their own, so what is around them is looked at. Known shapes stay whatever the list says. The time is in proportion to the length
    of a text. Null and empty texts have no spans; other columns are kept as they are, but for one named `to`.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def value_length(match: Column) -> Column:
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_LEAST

    def always(_: Column) -> Column:
        return F.lit(True)

    assigned = F.contains(body, F.lit(":")) | F.contains(body, F.lit("="))
    base = F.concat(
        _found(body, ASSIGN, "assign", value_length, assigned), _found(body, ACCESS, "access", always, F.contains(body, F.lit("AKIA"))),
        _found(body, HEX, "hex", always, F.lit(True)))
    candidates = _candidates(body)

    def windows(c: Column) -> Column:
        found = F.concat(*[_windows(c["string"], *rule) for rule in CLASSES.values()])
        kind = F.lit(KINDS.index("entropy"))
        return F.transform(_merged(found), lambda w: F.struct(
            (w["s"] + c["s"]).alias("s"), (w["e"] + c["s"]).alias("e"), kind.alias("k")))

    spans = F.array_sort(F.concat(base, F.flatten(F.transform(candidates, windows))), lambda a, b: F.when(
        (a["s"] < b["s"]) | ((a["s"] == b["s"]) & (a["k"] < b["k"])), -1).when(
        (a["s"] == b["s"]) & (a["k"] == b["k"]), 0).otherwise(1))
    return docs.withColumn(to, spans)


def _allowed(string: Column) -> Column:
    hit = F.lit(False)
    for pattern in ALLOWED:
        hit = hit | F.regexp_like(string, F.lit(pattern))
    return hit


def _merged(spans: Column) -> Column:
    """Spans (s, e) in any order -> disjoint ones in order."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("done"))

    def with_open(state: Column) -> Column:
        return F.when(state["e"] >= 0, F.concat(state["done"], F.array(F.struct(state["s"].alias("s"), state["e"].alias("e"))))).otherwise(state["done"])

    def step(state: Column, span: Column) -> Column:
        joins = (state["e"] >= 0) & (span["s"] <= state["e"])
        return F.struct(
            F.when(joins, state["s"]).otherwise(span["s"]).alias("s"), F.when(joins, F.greatest(state["e"], span["e"])).otherwise(span["e"]).alias("e"),
            F.when(joins, state["done"]).otherwise(with_open(state)).alias("done"))

    return F.aggregate(F.array_sort(spans), start, step, with_open)


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["s"], s["e"])), ",")


def mask(text: Column, spans: Column, sign: str = "[SECRET]") -> Column:
    """`text` with every span, or run of spans that overlap, replaced by `sign`."""
    whole = _merged(F.transform(spans, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(state: Column, span: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, span["s"] - state["at"])
        return F.struct(span["e"].alias("at"), F.concat(state["done"], kept, F.lit(sign)).alias("done"))

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(whole, start, step, finish)).otherwise(text)

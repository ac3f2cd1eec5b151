"""Personal data in texts: weak labelers vote on candidate spans, a label model weighs them, and a classifier learns from it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.llm.spans import bind, free_of, matches
from lotwise.scale import settle

# Kinds of spans, in order; spans of the first four stay whatever the classifier says.
KINDS = ("email", "ip", "card", "phone", "number", "iban", "contact", "name")
BASE = 4

# First names of the gazetteer.
FIRST_NAMES = (
    "Alexander", "Alice", "Andreas", "Anna", "Antonio", "Carlos", "Carmen", "Catherine", "Charles", "Christian", "Daniel", "David",
    "Elizabeth", "Emma", "Francisco", "Hans", "Isabel", "Jacques", "James", "Jean", "Jennifer", "Jessica", "Johannes", "John",
    "Jorge", "Juan", "Julia", "Karl", "Katharina", "Klaus", "Laura", "Linda", "Louis", "Lucia", "Manuel", "Maria", "Marie",
    "Martin", "Mary", "Michael", "Miguel", "Nathalie", "Nicolas", "Patricia", "Paul", "Peter", "Pierre", "Robert", "Sarah",
    "Sophie", "Stefan", "Susan", "Thomas", "William", "Wolfgang",
)
# Endings of mail hosts, calling codes, countries of accounts.
HOST_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "eu", "de", "fr", "es", "it", "nl", "at", "ch", "be", "uk", "us", "ca", "mx", "ar")
CALLING_CODES = ("1", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "81", "86", "91")
ACCOUNT_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")

# What a kind looks like; fixed values. Runs are possessive and start where a run starts or the match before ends, which
# finds the same spans and keeps the time in proportion to the text.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
PATTERNS = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9])(?:[0-9]{9,19}|\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){2,5})(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "contact": _LOCAL + r"\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "name": rf"(?=[A-Z])(?<!\p{{L}})(?:{'|'.join(FIRST_NAMES)})\x20\p{{Lu}}\p{{Ll}}++(?:-\p{{Lu}}\p{{Ll}}++)?",
}
# A text without this can't hold the kind.
NEEDS = {"email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "number": r"[0-9]{2}", "iban": r"[A-Z]{2}[0-9]{2}", "contact": r"[\])]"}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
# Words before a span that speak for it or against it; fixed values.
CUES = {
    "email": r"(?i)mail|contact|write|schreib|escrib|correo|courriel", "ip": r"(?i)\bip\b|address|host|adresse|client|login",
    "card": r"(?i)card|visa|master|amex|karte|carte|tarjeta|payment", "phone": r"(?i)phone|\btel|call|mobil|fax|ruf|llam|appel",
    "number": r"(?i)card|visa|account|konto|compte|cuenta|phone|\btel|call|mobil|fax|ssn|social|passport|patient|customer",
    "iban": r"(?i)iban|account|konto|compte|cuenta", "contact": r"(?i)mail|contact|write|correo|courriel",
    "name": r"(?i)\b(?:mr|mrs|ms|dr|herr|frau|señora?|monsieur|madame|name|signed|dear)\b",
}
AGAINST = r"(?i)(?:\b(?:version|v|ver|release|section|chapter|page|isbn|issn|doi|figure|fig|table|art|rfc|sha|md5|commit|build|order|part)\b|[§#$€£=/_])[\x20.:]*$"
CONTEXT = 24
LABELERS = ("shape", "checksum", "gazetteer", "cue", "against", "alone", "varied")
SIZES = 8

# P(vote | class) to start from, for votes -1, 0, 1; the share of all spans by which it anchors the estimates.
START = {0: (0.45, 0.45, 0.10), 1: (0.05, 0.45, 0.50)}
ANCHOR, ROUNDS = 0.2, 12
THRESHOLD = 0.9

def _digits(string: Column) -> Column:
    return F.regexp_replace(string, "[^0-9]", "")


def _passes(kind: str, string: Column) -> Column:
    """What a match of a base kind must also be; the others are left to the votes."""
    n = F.length(_digits(string))
    if kind == "ip":
        return F.regexp_like(string, F.lit(rf"^(?:{_OCTET}(?<=[0-9])\.){{3}}{_OCTET}(?<=[0-9])$"))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(string))
    if kind in ("phone", "number"):
        return n.between(9, 15 if kind == "phone" else 19)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Spans of a kind that pass its test, with what stands before and behind them."""
    spans = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["string"])), lambda m: F.struct(
        m["s"], m["e"], F.lit(KINDS.index(kind)).alias("k"), m["string"], F.right(m["before"], F.lit(CONTEXT)).alias("before"),
        F.left(m["after"], F.lit(CONTEXT)).alias("after")))
    none = F.array().cast("array<struct<s:int,e:int,k:int,string:string,before:string,after:string>>")
    need = NEEDS.get(kind)
    if need is None:
        return F.when(F.regexp_like(text, F.lit(PATTERNS[kind])), spans).otherwise(none)
    has = F.contains(text, F.lit(need)) if len(need) == 1 else F.regexp_like(text, F.lit(need))
    return F.when(has, spans).otherwise(none)


def _mod97(string: Column) -> Column:
    """Remainder of an account number by its rule: first four characters last, letters as 10 to 35."""
    plain = F.replace(string, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).when(c.between("A", "Z"), F.ascii(c) - 55)
        return F.when(value < 10, (rest * 10 + value) % 97).when(value >= 10, (rest * 100 + value) % 97).otherwise(rest)

    return F.aggregate(turned, F.lit(0), step)


def _votes(span: Column) -> Column:
    """The votes of LABELERS on a span: 1 for personal data, -1 against it, 0 for no opinion."""
    string, kind = span["string"], span["k"]
    digits = _digits(string)
    n = F.length(digits)

    def of(*kinds: str) -> Column:
        return kind.isin(*[KINDS.index(k) for k in kinds])

    def vote(yes: Column, no: Column | None = None) -> Column:
        decided = F.when(yes, 1)
        return (decided.otherwise(0) if no is None else decided.when(no, -1).otherwise(0)).cast("tinyint")

    ending = F.lower(F.regexp_extract(string, r"([A-Za-z0-9-]+)$", 1))
    code = F.regexp_extract(string, r"^\+([0-9]{1,2})", 1)
    grouped = F.regexp_like(string, F.lit(r"^(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|0[0-9]{1,4}(?:[\x20./-][0-9]{2,5}){2,4})$"))
    first = F.regexp_extract(string, r"^0*([0-9]+)", 1).cast("int")
    known = F.when(of("email", "contact"), ending.isin(*HOST_ENDINGS)).when(
        of("phone"), code.isin(*CALLING_CODES) | F.left(code, F.lit(1)).isin(*CALLING_CODES)).when(
        of("card", "number"), F.left(digits, F.lit(1)).isin("3", "4", "5", "6") & n.between(13, 19)).when(
        of("ip"), first.between(1, 223) & (first != 127)).when(
        of("iban"), F.left(string, F.lit(2)).isin(*ACCOUNT_COUNTRIES)).otherwise(F.lit(True))
    # a number of another length than a card's says nothing to the list of card issuers
    unknown = ~known & (~of("number") | n.between(13, 19))
    cue = reduce(lambda c, k: c.when(of(k), F.regexp_like(span["before"], F.lit(CUES[k]))), CUES, F.when(F.lit(False), F.lit(False)))
    glued = F.regexp_like(span["before"], F.lit(r"[\p{L}0-9_/\\=&?-]$")) | F.regexp_like(span["after"], F.lit(r"^[\p{L}0-9_/\\=&-]"))
    return F.array(
        vote(of("email", "ip", "card", "phone", "contact") | (of("number") & grouped), of("number") & ~grouped & ~n.between(13, 19)),
        vote((n.between(13, 19) & of("card", "number") & F.call_function("luhn_check", digits)) | (of("iban") & (_mod97(string) == 1)),
             (n.between(13, 19) & of("card", "number")) | of("iban")),
        vote(known, unknown), vote(cue), vote(F.lit(False), F.regexp_like(span["before"], F.lit(AGAINST))),
        vote(~glued, glued),
        vote(F.lit(False), (n > 3) & F.regexp_like(digits, F.lit(r"^([0-9])\1+$|^0?123456"))))


def candidates(docs: DataFrame, text: str = "text", to: str = "candidates") -> DataFrame:
    """`docs` with a column `to`: array of (s, e, k, votes, size), code points from 0, end exclusive, k a place in KINDS,
    by kind and start; size is a step of the number of digits. Built-in functions only, nothing is shuffled. Null texts
    are empty; a text of any length is read whole; other columns are kept, but for one named `to`."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[_found(body, kind) for kind in KINDS])
    found = F.transform(spans, lambda c: F.struct(
        c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), _votes(c).alias("votes"),
        F.least(F.floor(F.length(_digits(c["string"])) / 3), F.lit(SIZES - 1)).cast("int").alias("size")))
    return docs.withColumn(to, found)


@dataclass
class LabelModel:
    """P(votes, class) with votes independent given the class: `prior` per kind, `rates` [class][labeler][vote + 1]."""

    prior: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))
    rates: dict[int, list[tuple[float, float, float]]] = field(
        default_factory=lambda: {y: [START[y]] * len(LABELERS) for y in (0, 1)})

    @property
    def gains(self) -> list[list[float]]:
        """Log odds that a vote adds, [labeler][vote + 1]."""
        return [[math.log(one / zero) for zero, one in zip(*pair)] for pair in zip(self.rates[0], self.rates[1])]

    @property
    def kinds(self) -> list[float]:
        return [math.log(p / (1 - p)) for p in self.prior]

    def posterior(self, kind: Column, votes: Column) -> Column:
        return _sigmoid(_linear(0.0, self.kinds, self.gains, None, kind, votes, None))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _pick(values: list[float], at: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), at)


def _linear(intercept, kinds, gains, sizes, kind: Column, votes: Column, size: Column | None) -> Column:
    z = F.lit(float(intercept)) + _pick(kinds, kind)
    for j, gain in enumerate(gains):
        z = z + _pick(gain, F.get(votes, F.lit(j)).cast("int") + 1)
    return z if sizes is None else z + _pick(sizes, size)


def patterns(found: DataFrame, column: str = "candidates") -> DataFrame:
    """(k, votes, size, n): how often each combination stands in the candidates; as many rows as there are combinations of
    votes at most, whatever the number of texts."""
    one = found.select(F.explode(column).alias("c")).select("c.k", "c.votes", "c.size")
    return one.groupBy("k", "votes", "size").agg(F.count(F.lit(1)).alias("n"))


def fit_label_model(counted: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """Expectation and maximisation over `patterns`, which are at most as many as there are combinations of kinds and votes,
    whatever the number of texts. The starting rates count as much as ANCHOR times all spans of a class, so the classes
    can't change places."""
    rows = [(r.k, r.votes, float(r.n)) for r in counted.groupBy("k", "votes").agg(F.sum("n").alias("n")).orderBy("k", "votes").collect()]
    model = LabelModel()
    for _ in range(rounds if rows else 0):
        size = [[0.0] * len(KINDS) for _ in (0, 1)]
        seen = [[[0.0] * 3 for _ in LABELERS] for _ in (0, 1)]
        kinds, gains = model.kinds, model.gains
        for k, votes, n in rows:
            z = kinds[k] + sum(gain[v + 1] for gain, v in zip(gains, votes))
            private = 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))
            for y, w in ((0, n * (1 - private)), (1, n * private)):
                size[y][k] += w
                for j, v in enumerate(votes):
                    seen[y][j][v + 1] += w
        prior = [(one + 1) / (zero + one + 2) for zero, one in zip(*size)]
        rates = {}
        for y in (0, 1):
            total = sum(size[y])
            rates[y] = [
                tuple((seen[y][j][v] + (ANCHOR * total + 1) * START[y][v]) / ((1 + ANCHOR) * total + 1) for v in range(3))
                for j in range(len(LABELERS))]
        model = LabelModel([min(max(p, 1e-4), 1 - 1e-4) for p in prior], rates)
    return model


@dataclass
class PersonalData:
    """A fitted classifier of spans: linear in the kind, the votes and the size."""

    label_model: LabelModel
    intercept: float
    kinds: list[float]
    gains: list[list[float]]
    sizes: list[float]

    def score(self, span: Column) -> Column:
        """Probability that a candidate is personal data."""
        return _sigmoid(_linear(self.intercept, self.kinds, self.gains, self.sizes, span["k"], span["votes"], span["size"]))

    def spans(self, found: Column) -> Column:
        """The spans (s, e, k) that stay of a column of candidates, by kind and start: all of the base kinds, and those of
        the others that the classifier is sure of and that no base span overlaps; a plain number gives way to any span."""
        return bind(found, self._kept)

    def _kept(self, found: Column) -> Column:
        base = F.filter(found, lambda c: c["k"] < BASE)
        sure = F.filter(found, lambda c: (c["k"] >= BASE) & (self.score(c) >= THRESHOLD))
        number = KINDS.index("number")

        def plain(spans: Column) -> Column:
            return F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k")))

        def with_numbers(known: Column) -> Column:
            kept = F.concat(known, bind(plain(F.filter(sure, lambda c: c["k"] == number)), lambda n: free_of(n, known)))
            return F.array_sort(kept, lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["s"] - b["s"]))

        def with_named(known: Column) -> Column:
            return F.concat(known, bind(plain(F.filter(sure, lambda c: c["k"] != number)), lambda n: free_of(n, known)))

        return bind(bind(plain(base), with_named), with_numbers)


def fit(found: DataFrame, column: str = "candidates") -> PersonalData:
    """Learn from the candidates of all texts, without labels: the label model gives every combination of votes its
    probability, and a logistic regression learns from these, each combination with the weight of its spans. Without
    candidates the classifier is the label model's start."""
    counted = settle(patterns(found, column))
    model = fit_label_model(counted)
    p = model.posterior(F.col("k"), F.col("votes"))
    columns = [(f"k{i}", F.col("k") == i) for i in range(len(KINDS))] + [
        (f"v{j}_{v + 1}", F.get("votes", F.lit(j)) == v) for j in range(len(LABELERS)) for v in (-1, 1)] + [
        (f"s{i}", F.col("size") == i) for i in range(SIZES)]
    rows = counted.select("n", p.alias("p"), *[c.cast("double").alias(name) for name, c in columns])
    both = rows.withColumns({"y": F.lit(1.0), "w": F.col("n") * F.col("p")}).union(
        rows.withColumns({"y": F.lit(0.0), "w": F.col("n") * (1 - F.col("p"))}))
    names = [name for name, _ in columns]
    size = both.groupBy("y").agg(F.sum("w").alias("w")).collect()
    if len(size) < 2 or min(r.w for r in size) < 1e-6:
        return PersonalData(model, 0.0, model.kinds, model.gains, [0.0] * SIZES)
    ready = VectorAssembler(inputCols=names, outputCol="x").transform(both).select("x", "y", "w").coalesce(1)
    fitted = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4, maxIter=40, standardization=False).fit(ready)
    weight = dict(zip(names, fitted.coefficients.toArray().tolist()))
    return PersonalData(
        model, float(fitted.intercept), [weight[f"k{i}"] for i in range(len(KINDS))],
        [[weight[f"v{j}_0"], 0.0, weight[f"v{j}_2"]] for j in range(len(LABELERS))], [weight[f"s{i}"] for i in range(SIZES)])


def find(docs: DataFrame, text: str = "text", to: str = "personal") -> DataFrame:
    """`docs` with a column `to`: array of (s, e, k), code points from 0, end exclusive, k a place in KINDS, by kind and start.

    Base kinds are leftmost non-overlapping matches of their patterns that pass their tests. The others (numbers that look
    like those of cards, accounts and phones, account numbers, written-out mail addresses, names) are added where the
    classifier, learned from these texts, says so. Null and empty texts have no spans, repeated rows the same ones, an
    empty table none; other columns are kept, but for one named `to`.
    """
    candidate = next(f"candidates{i}" for i in range(len(docs.columns) + 1) if f"candidates{i}" not in docs.columns)
    found = candidates(docs, text, candidate)
    model = fit(found, candidate)
    return found.withColumn(to, model.spans(F.col(candidate))).drop(candidate)


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"], s["e"])), ",")

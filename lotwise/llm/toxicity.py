"""Toxicity by weak supervision: many voters, a generative model of their votes, and a linear classifier trained on it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lotwise.llm.portions import small_batches
from lotwise.scale import settle

# Insults; fixed values.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile",
    "filthy", "vermin", "scumbag", "idiota", "imbécil", "basura", "connard", "crétin", "abruti", "arschloch", "dummkopf", "abschaum",
)
# Pattern voters over the whole text; fixed values.
PATTERNS = (
    r"\bshut\s+up\b", r"\bgo\s+to\s+hell\b", r"\bi\s+hate\s+(?:you|him|her|them)\b", r"\bhalt\s+die\b", r"\bferme\s+la\b",
)

THRESHOLD = 0.7
# The score learns from samples of labelled rows and of documents, of about so many rows at most.
LABELLED_PER_CLASS, DOCUMENTS = 10_000, 40_000
# Voters, and features of the score with these. Votes are bits of a long.
VOTERS, FEATURES = 63, 3_000
PREFIX = range(3, 9)
# P(vote | class) of a voter that the labelled texts don't tell about.
UNSEEN = (0.005, 0.1)
# Of voters: toxic texts, lift and standard deviations above chance at least; an extension this much surer goes before
# its beginning. Of features: lift and standard deviations at least.
LEAST_TEXTS, LEAST_LIFT, LEAST_EXCESS, SURER, FEATURE_LIFT, FEATURE_EXCESS = 5, 20.0, 7.0, 1.7, 4.0, 4.0
# Features that can become voters: the most frequent ones.
CERTAIN = 20_000
# Rounds of the label model, and the weight of what the labelled rows say about a voter, in times the documents of either
# class. Votes for toxic alone tell little of how often a voter errs on clean texts, so there it weighs more.
ROUNDS, ANCHOR = 6, (2.0, 0.5)
# Words a task remembers, and features it counts before it passes them on.
REMEMBERED, COUNTED = 50_000, 100_000

WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; rows without doc_id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def word_features(word: str) -> list[str]:
    """A word, and its beginnings with something behind them."""
    return [word, *[word[:n] + "*" for n in PREFIX if len(word) > n]]


def all_features(text: str | None) -> set[str]:
    """Words of a text, beginnings of words (be*), and beginnings of two or more of its distinct words (be*+)."""
    count = Counter(f for w in set(WORD.findall((text or "").lower())) for f in word_features(w))
    return {*count, *[f + "+" for f, n in count.items() if n > 1 and f.endswith("*")]}


class Reader:
    """Which of some features (those of `all_features`, and /patterns/) a text holds, as sorted numbers.

    Features are found by the first letters of a word, so most words are done with one look; what the others hold is
    remembered for a bounded number of words.
    """

    def __init__(self, features: list[str]):
        self.patterns = [(i, re.compile(f[1:-1], re.IGNORECASE)) for i, f in enumerate(features) if f.startswith("/")]
        # a beginning's number, and that of two words with it
        self.number = {f.rstrip("+"): -1 for f in features if not f.startswith("/")}
        self.number |= {f: i for i, f in enumerate(features) if f in self.number}
        self.twice = {f[:-1]: i for i, f in enumerate(features) if f.endswith("*+")}
        self.first = {f.rstrip("*")[:PREFIX.start] for f in self.number}
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        text = text or ""
        found = {i for i, pattern in self.patterns if pattern.search(text)}
        first, known, held, n = self.first, self.known, [], PREFIX.start
        for word in set(WORD.findall(text.lower())):
            if word[:n] not in first:
                continue
            features = known.get(word)
            if features is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                features = known[word] = tuple(f for f in word_features(word) if f in self.number)
            held += features
        for feature, count in Counter(held).items():
            found.add(self.number[feature])
            if count > 1 and feature in self.twice:
                found.add(self.twice[feature])
        return sorted(found - {-1})


@dataclass
class LabelModel:
    """P(votes, toxic). Voters vote for toxic or not at all, and that they don't says nothing but if none of them does:
    P(toxic) is `none` without votes. Among texts with votes it is `prior`, and a vote of j has the probability
    vote[class, parent votes, j]; parents make a tree.

    How often a voter is right comes from its expected votes in either class; which voters go together from the
    expected pairs of votes. A voter's parent is the one it depends on most given the class (maximum spanning tree of
    conditional mutual information), so voters that repeat each other count about once.
    """

    none: float
    prior: float
    vote: np.ndarray  # [class, parent's vote, voter]
    parent: np.ndarray  # -1: none
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) for rows of votes (0 or 1)."""
        with_parent = np.where(self.parent >= 0, votes[:, self.parent], 0) == 1
        gain = np.log(self.vote[1] / self.vote[0])
        z = np.log(self.prior / (1 - self.prior)) + (votes * np.where(with_parent, gain[1], gain[0])).sum(axis=1)
        return np.where(votes.any(axis=1), 1 / (1 + np.exp(-np.clip(z, -500, 500))), self.none)

    @property
    def accuracies(self) -> np.ndarray:
        """P(vote | class, some votes) of each voter whose parent doesn't vote."""
        return self.vote[:, 0]


def unpack_votes(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n) & 1).astype(np.int8)


def fit_label_model(patterns: DataFrame, rates: np.ndarray, none: float, prior: float) -> LabelModel:
    """Expectation and maximisation over `patterns` (votes bigint, n bigint), first with independent voters, then with
    the tree of their correlations. `rates` [class, voter] and `prior`, both for texts with votes, start and anchor it
    (see ANCHOR). A round is one pass in which tasks return sums of voters x voters."""
    n = rates.shape[1]
    patterns = patterns.where("votes <> 0")
    model = LabelModel(none, prior, np.stack([rates, rates], axis=1), np.full(n, -1))
    for round_ in range(2 * ROUNDS):
        size, pair = _expected(patterns, model, n)
        parent, correlation = _tree(size, pair) if round_ == ROUNDS else (model.parent, model.correlation)
        vote, share = _maximised(size, pair, rates, prior, parent)
        model = LabelModel(none, share, vote, parent, correlation)
    return model


def _expected(patterns: DataFrame, model: LabelModel, n: int) -> tuple[np.ndarray, np.ndarray]:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, pair = np.zeros(2), np.zeros((2, n, n))
        for batch in batches:
            votes, count = unpack_votes(batch.votes.to_numpy(np.int64), n), batch.n.to_numpy(float)
            toxic = model.posterior(votes)
            for y, weight in enumerate((count * (1 - toxic), count * toxic)):
                size[y] += weight.sum()
                pair[y] += (votes * weight[:, None]).T @ votes
        yield pd.DataFrame({"size": [size.tobytes()], "pair": [pair.tobytes()]})

    rows = patterns.mapInPandas(sums, "size binary, pair binary").collect()
    size = sum((np.frombuffer(r.size) for r in rows), np.zeros(2))
    return size, sum((np.frombuffer(r.pair) for r in rows), np.zeros(2 * n * n)).reshape(2, n, n)


def _maximised(size: np.ndarray, pair: np.ndarray, rates: np.ndarray, prior: float, parent: np.ndarray) -> tuple:
    n = rates.shape[1]
    voters, of = np.arange(n), np.maximum(parent, 0)
    vote = np.empty((2, 2, n))
    for y in (0, 1):
        both, alone, above = pair[y][voters, of], pair[y].diagonal(), pair[y].diagonal()[of]
        has = parent >= 0
        yes, of_yes = np.where(has, both, 0), np.where(has, above, 0)
        weight = ANCHOR[y] * size[y] + 1
        vote[y, 0] = (alone - yes + weight * rates[y]) / (size[y] - of_yes + weight)
        # how often it votes with its parent leans on how often it votes at all
        vote[y, 1] = np.where(has, (yes + 5 * vote[y, 0]) / (of_yes + 5), vote[y, 0])
    share = (size[1] / size.sum() + prior) / 2 if size.sum() else prior
    return np.clip(vote, 1e-6, 1 - 1e-6), float(np.clip(share, 1e-3, 1 - 1e-3))


def _tree(size: np.ndarray, pair: np.ndarray, least: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Parents by the maximum spanning forest of conditional mutual information, and correlations given the class."""
    n = pair.shape[1]
    information, correlation = np.zeros((n, n)), np.zeros((n, n))
    for y in (0, 1):
        m = max(size[y], 1e-9)
        p, q = pair[y].diagonal() / m, pair[y] / m
        cells = (
            (q, p[:, None] * p), (p[:, None] - q, p[:, None] * (1 - p)),
            (p[None, :] - q, (1 - p)[:, None] * p), (1 - p[:, None] - p + q, (1 - p)[:, None] * (1 - p)))
        for seen, free in cells:
            seen = np.clip(seen, 0, None)
            with np.errstate(divide="ignore", invalid="ignore"):
                information += size[y] / max(size.sum(), 1e-9) * np.where((seen > 0) & (free > 0), seen * np.log(seen / free), 0)
        spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
        correlation += size[y] / max(size.sum(), 1e-9) * np.where(spread > 0, (q - np.outer(p, p)) / np.where(spread > 0, spread, 1), 0)
    np.fill_diagonal(information, 0)
    parent, joined = np.full(n, -1), np.zeros(n, bool)
    best, via = np.zeros(n), np.full(n, -1)
    for _ in range(n):
        j = int(np.argmax(np.where(joined, -1, best)))
        joined[j] = True
        parent[j] = via[j] if best[j] > least else -1
        closer = ~joined & (information[j] > best)
        best[closer], via[closer] = information[j][closer], j
    return parent, correlation


@dataclass
class Toxicity:
    """A fitted score: 1 / (1 + exp(-(intercept + sum of the weights of the features in a text)))."""

    features: list[str]
    weights: np.ndarray
    intercept: float
    voters: list[str]
    label_model: LabelModel

    def score(self, docs: DataFrame, to: str = "toxicity") -> DataFrame:
        """`docs` with its score from 0 to 1 in a column `to`; only the text counts. Null texts are empty, and empty
        texts have the score of a text without features."""
        features, weights, intercept = self.features, self.weights, self.intercept

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = Reader(features)
            for batch in batches:
                z = np.array([intercept + weights[read(t.as_py())].sum() for t in batch.column("text")], float)
                score = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
                yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*names, to])

        docs = docs.drop(to)
        names = docs.columns
        return docs.mapInArrow(scores, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learn a score from the texts of `docs` (doc_id, text) and `labels` (doc_id, toxic); see `held_out` for the rows
    that are left out.

    1. Words and beginnings of words that a bounded sample of labelled texts has far more often in toxic ones become
       voters, beside the lexicon and the patterns; they may only vote for toxic.
    2. All texts that are not held out are read for votes, and equal votes are counted. A generative model of the votes
       estimates how often each voter votes in either class, and which voters depend on each other.
    3. Its posterior labels a bounded sample of texts; a logistic regression over the features learns from these.

    Labels other than 0 and 1 are ignored; of repeated labels the greatest counts. Without labelled rows of both
    classes only the lexicon and the patterns vote, with the rates they start from.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {int(r.toxic): r["count"] for r in known.groupBy("toxic").count().collect()}
    dice = F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("toxic") == 1, LABELLED_PER_CLASS / max(count.get(1, 0), 1)).otherwise(
        LABELLED_PER_CLASS / max(count.get(0, 0), 1))
    sample = settle(docs.join(F.broadcast(known.where(dice < share)), "doc_id").select("text", "toxic"))
    size = {int(r.toxic): r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)

    voters = [*LEXICON, *[f"/{p}/" for p in PATTERNS]]
    features = list(voters)
    if n_toxic and n_clean:
        telling = settle(_telling(sample, n_toxic, n_clean))
        certain = telling.where((F.col("lift") >= LEAST_LIFT) & (F.col("excess") >= LEAST_EXCESS)).orderBy(F.desc("n"), "feature").limit(CERTAIN).collect()
        strongest = telling.orderBy((-F.log("lift") * F.col("n")), "feature").limit(FEATURES).collect()
        toxic = {r.feature: r.n for r in certain + strongest}
        clean = {r.feature: r.n_clean for r in certain + strongest}
        toxic |= {r.feature: r.n for r in _counted(sample.where("toxic = 1"), features).collect()}
        clean |= {r.feature: r.n for r in _counted(sample.where("toxic = 0"), features).collect()}
        lift = {f: (toxic.get(f, 0) + 0.5) / (n_toxic + 1) / ((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f in {*toxic, *features}}
        excess = {}
        for f in lift:
            expected = (toxic.get(f, 0) + clean.get(f, 0)) * n_toxic / (n_toxic + n_clean)
            excess[f] = (toxic.get(f, 0) - expected) / max(expected, 1e-9) ** 0.5
        sure = {f: x for f, x in lift.items() if excess[f] >= LEAST_EXCESS}
        voters += _chosen(sure, toxic, VOTERS - len(voters), set(voters))
        strong = sorted((f for f in lift if lift[f] >= FEATURE_LIFT and excess[f] >= FEATURE_EXCESS), key=lambda f: (-np.log(lift[f]) * toxic.get(f, 0), f))
        features = list(dict.fromkeys([*voters, *strong[:FEATURES - len(voters)]]))
    share = count.get(1, 0) / max(sum(count.values()), 1)
    start, none, prior = _start(sample, voters, min(max(share, 0.01), 0.5))

    # every document is read for votes, a bounded sample of them for the features that the regression learns from
    votes = docs.select("text").mapInArrow(_votes(voters, len(voters)), "votes bigint")
    patterns = settle(votes.groupBy("votes").agg(F.count("*").alias("n")))
    model = fit_label_model(patterns.coalesce(16), start, none, prior)

    total = patterns.agg(F.sum("n")).first()[0] or 0
    dice = F.pmod(F.xxhash64(F.lit("documents"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = docs.where(dice < DOCUMENTS / max(total, 1)).select("text").mapInArrow(
        _votes(features, len(voters), features=True), "votes bigint, features array<string>")
    toxic = settle(chosen.mapInPandas(_posteriors(model, len(voters)), "toxic double, features array<string>"))
    weights, intercept = _regression(toxic, features, model, len(voters))
    return Toxicity(features, weights, intercept, voters, model)


def _counted(sample: DataFrame, features: list[str] | None) -> DataFrame:
    """(feature, n): how many texts hold each feature; of all words and beginnings if none are given."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, found = Reader(features or []), Counter()
        for batch in batches:
            for text in batch.column(0):
                if features:
                    found.update(features[i] for i in read(text.as_py()))
                else:
                    found.update(all_features(text.as_py()))
                if len(found) > COUNTED:
                    yield out(found)
                    found = Counter()
        yield out(found)

    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["feature", "n"])

    counted = sample.select("text").mapInArrow(count, "feature string, n bigint")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"))


def _telling(sample: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(feature, n, n_clean, lift, excess) of every word and beginning that enough toxic texts hold and that is strong
    enough for a feature; how common it is plays no other part."""
    clean = _counted(sample.where("toxic = 0"), None).withColumnRenamed("n", "n_clean")
    both = _counted(sample.where("toxic = 1"), None).where(F.col("n") >= LEAST_TEXTS).join(clean, "feature", "left").fillna(0, ["n_clean"])
    expected = (F.col("n") + F.col("n_clean")) * n_toxic / (n_toxic + n_clean)
    lift = (F.col("n") + 0.5) / (n_toxic + 1) / ((F.col("n_clean") + 0.5) / (n_clean + 1))
    return both.withColumns({"lift": lift, "excess": (F.col("n") - expected) / F.sqrt(expected)}).where(
        (F.col("lift") >= FEATURE_LIFT) & (F.col("excess") >= FEATURE_EXCESS))


def _chosen(lift: dict[str, float], toxic: dict[str, int], most: int, taken: set[str]) -> list[str]:
    """Voters: features with a high lift, the shortest beginning that is about as sure as each of its extensions before
    these, those of most toxic texts first."""
    strong = [f for f in lift if lift[f] >= LEAST_LIFT and toxic.get(f, 0) >= LEAST_TEXTS]
    surest: dict[str, float] = {}
    for f in strong:
        for n in range(1, len(f) + 1):
            surest[f[:n]] = max(surest.get(f[:n], 0), lift[f])
    chosen: set[str] = set(taken)
    for f in sorted(strong, key=lambda f: (len(f.rstrip("*+")), len(f), f)):
        stem = f.rstrip("*+")
        # two words with a beginning don't speak for one
        kinds = ("*", "*+") if f.endswith("+") else ("*",)
        covered = stem in taken or any(stem[:n] + kind in chosen for n in range(1, len(stem) + 1) for kind in kinds)
        if not covered and surest[stem] <= SURER * lift[f]:
            chosen.add(f)
    return sorted(chosen - taken, key=lambda f: (-toxic[f], f))[:most]


def _start(sample: DataFrame, voters: list[str], share: float) -> tuple[np.ndarray, float, float]:
    """What the labelled sample says: P(vote | class) among texts with votes, P(toxic | no vote), P(toxic | votes)."""
    read = sample.select("text", "toxic").mapInArrow(_votes(voters, len(voters), "toxic"), "toxic int, votes bigint")
    # as many rows as the sample at most
    rows = read.groupBy("toxic", "votes").count().collect()
    votes = unpack_votes(np.array([r.votes for r in rows], np.int64), len(voters))
    n, toxic = np.array([r["count"] for r in rows], float), np.array([r.toxic for r in rows])
    some = votes.any(axis=1)
    rates, any_vote = np.repeat(np.array(UNSEEN)[:, None], len(voters), axis=1), [0.02, 0.5]
    odds = share / (1 - share)
    if len(set(toxic.tolist())) < 2:
        # one class alone tells nothing
        votes, some = votes[:0], some[:0]
    for y in (0, 1) if len(votes) else ():
        of, has = toxic == y, (toxic == y) & some
        rates[y] = ((votes * n[:, None])[has].sum(axis=0) + (0.02, 0.5)[y]) / (n[has].sum() + 1)
        any_vote[y] = (n[has].sum() + 1) / (n[of].sum() + 2)
    seen = votes[some].any(axis=0)
    for j in np.flatnonzero(~seen):
        rates[:, j] = UNSEEN
    none, some_votes = odds * (1 - any_vote[1]) / (1 - any_vote[0]), odds * any_vote[1] / any_vote[0]
    return rates, none / (1 + none), some_votes / (1 + some_votes)


def _votes(known: list[str], n_voters: int, *carried: str, features: bool = False):
    """Rows with the columns `carried`, the votes as bits and, if asked for, the numbers of all features as text."""
    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, numbers = Reader(known), [str(i) for i in range(len(known))]
        for batch in batches:
            found = [read(t.as_py()) for t in batch.column("text")]
            columns = [*[batch.column(c) for c in carried], pa.array([sum(1 << i for i in f if i < n_voters) for f in found], pa.int64())]
            if features:
                columns.append(pa.array([[numbers[i] for i in f] for f in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "votes", *["features"] * features])

    return read_all


def _posteriors(model: LabelModel, n_voters: int):
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic = model.posterior(unpack_votes(batch.votes.to_numpy(np.int64), n_voters))
            yield pd.DataFrame({"toxic": toxic, "features": batch.features})

    return label


def _regression(labelled: DataFrame, features: list[str], model: LabelModel, n_voters: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels: each text counts for either class with its share."""
    size, toxic = labelled.agg(F.count("*"), F.sum("toxic")).first()
    if not size or not 1e-6 < toxic < size - 1e-6:
        # nothing to learn: what the label model alone says of a text
        rates = model.accuracies
        weights = np.zeros(len(features))
        weights[:n_voters] = np.log(rates[1] / rates[0])
        return weights, float(np.log(model.none / (1 - model.none)))
    to_vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(features))], "features", "x", minTF=0.0)
    rows = to_vector.transform(labelled)
    both = rows.select("x", F.lit(1.0).alias("y"), F.col("toxic").alias("w")).union(
        rows.select("x", F.lit(0.0).alias("y"), (1 - F.col("toxic")).alias("w")))
    fitted = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", regParam=3e-5, maxIter=40, standardization=False).fit(both)
    return fitted.coefficients.toArray(), float(fitted.intercept)

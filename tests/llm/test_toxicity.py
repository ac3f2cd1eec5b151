"""Held-out accuracy on a made table, the label model on votes with known rates, and odd tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, toxicity string"


def made(n=3000):
    """Three languages; toxic texts hold insults of the lexicon, or invented words with telling beginnings."""
    dice = random.Random(7)
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "so", "ti", "ve", "xa"]
    word = lambda: "".join(dice.choice(syllables) for _ in range(dice.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        lang, toxic = i % 3, dice.random() < 0.12
        text = [word() for _ in range(dice.randint(15, 150))]
        if toxic:
            for _ in range(dice.randint(1, 4)):
                bad = {0: dice.choice(toxicity.LEXICON[:10]), 1: "zork" + word(), 2: "quiff" + word()}[lang]
                text.insert(dice.randrange(len(text)), dice.choice([bad, bad.upper()]))
        elif lang == 1 and dice.random() < 0.3:
            text.append("zork")  # the beginning alone is harmless
        rows.append((i, " ".join(text), str(lang), "x"))
        if dice.random() < 0.4:
            labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, dict(labels), toxicity.fit(docs, truth)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    scored = model.score(docs, "toxicity").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.held and r.doc_id in labels]
    assert {r.doc_id for r in scored if r.held} == {i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r.toxicity <= 1 for r in scored) and len(held) > 300
    hit = sum(r.toxicity >= toxicity.THRESHOLD for r in held if labels[r.doc_id])
    wrong = sum(r.toxicity >= toxicity.THRESHOLD for r in held if not labels[r.doc_id])
    assert hit >= 0.9 * sum(labels[r.doc_id] for r in held) and wrong <= 0.01 * len(held)


def test_voters_generalise(fitted):
    _, _, model = fitted
    for unknown in ("zorkneverseen", "quiffneverseen"):
        assert any(v.endswith("*") and unknown.startswith(v[:-1]) for v in model.voters)
    read = toxicity.Reader(model.features)
    assert model.weights[read("zorkneverseen")].sum() + model.intercept > 0 > model.weights[read("zork")].sum() + model.intercept


def test_same_text_same_score(spark, fitted):
    """Neither number, language nor other columns count; odd texts have scores."""
    _, _, model = fitted
    texts = ["you idiot", "you idiot", None, "", " \n", "IDIOT!", "x " * 50_000, "é" * 3000]
    docs = spark.createDataFrame([(None if i == 1 else i, t, str(i), "kept") for i, t in enumerate(texts)], SCHEMA)
    got = sorted(model.score(docs, "score").collect(), key=lambda r: int(r.lang))
    assert got[0].score == got[1].score == got[5].score and got[2].score == got[3].score == got[4].score
    assert all(0 <= r.score <= 1 and r.toxicity == "kept" for r in got)


def test_label_model_finds_rates_and_copies(spark):
    """Five voters, the last a copy of the first: its votes must not count twice."""
    rng = np.random.default_rng(3)
    rates = np.array([[0.02, 0.03, 0.05, 0.04], [0.6, 0.5, 0.4, 0.3]])
    toxic = (rng.random(40_000) < 0.2).astype(int)
    votes = (rng.random((40_000, 4)) < rates[toxic]).astype(int)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    masks, counts = np.unique(votes @ (1 << np.arange(5)), return_counts=True)
    patterns = spark.createDataFrame(list(zip(masks.tolist(), counts.tolist(), strict=True)), "votes long, n long")
    some = votes.any(axis=1)
    start = np.array([[0.3] * 5, [0.4] * 5])
    start[:, 0] = start[:, 4] = [0.15, 0.6]
    model = toxicity.fit_label_model(patterns, start, 0.02, 0.6)
    assert {model.parent[0], model.parent[4]} & {0, 4} and model.correlation[0, 4] > 0.9
    child = 4 if model.parent[4] == 0 else 0
    # given the copied vote, the copy's vote says nothing
    assert abs(np.log(model.vote[1, 1, child] / model.vote[0, 1, child])) < 0.2
    posterior = model.posterior(votes)
    assert (posterior[~some] == 0.02).all()
    assert posterior[toxic == 1].mean() > posterior[toxic == 0].mean() + 0.3


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(50)], [(i, 1) for i in range(50)], [(i, 7) for i in range(50)], [(None, 1)]])
def test_odd_labels(spark, labels):
    rows = [(i, "you idiot" if i % 2 else "fine day", "en", "x") for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r.text: r.score for r in model.score(spark.createDataFrame(rows, SCHEMA), "score").collect()}
    assert 0 <= scores["fine day"] <= scores["you idiot"] <= 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score(docs).count() == 0


def test_rare_markers_are_not_cut_by_common_words(spark):
    """A marker in 7 of 45 toxic texts, behind more than 20,000 harmless features that more of them hold."""
    dice = random.Random(3)
    words = ["".join(dice.choice("abcdefghijklm") for _ in range(10)) for _ in range(4000)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][:445]
    rows, labels = [], []
    for n, i in enumerate(ids):
        text = dice.sample(words, 2000) + ["wazzock"] * (n < 7)
        rows.append((i, " ".join(text), "en", "x"))
        labels.append((i, int(n < 45)))
    common = {f: n for f, n in Counter(f for _, t, *_ in rows[:45] for f in toxicity.all_features(t)).items() if n > 7}
    assert len(common) > 20_000
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(v.startswith("waz") for v in model.voters)

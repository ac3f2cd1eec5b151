"""The native search for personal data against Python's re, and its label model against a dense one."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import personal_data as pd_

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    text = text or ""
    found = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def texts():
    dice = random.Random(7)
    parts = [
        "a@b.c", "x.y+z@mail.example.com", "@", "a@b", "a@@b.co", "me@x.y@z.org", "a@b.com_c@d.org", "é@é.fr", ".@-.-", "1.2.3.4",
        "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.255", "1.2.3", "999999999999.1.1.1", "4111111111111111", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "4111  1111", "378282246310005", "4111111111111111 4111111111111111", "0", "12", "+1 (743) 555-3824",
        "+44 20 7946 0958", "+1", "+1 2", "++49 30 123456", "+12345678901234567", "+1 (2) .-", "\n", " ", "日", "word", "-", "_", "%"]
    made = ["", " " * 50, "9" * 30_000, "a" * 30_000, "1." * 5_000, "+1" + " " * 20_000, "a@" * 3_000, ("x@y.zz " * 300)]
    for _ in range(300):
        made.append("".join(dice.choice(parts) + dice.choice(["", "", " ", ", "]) for _ in range(dice.randint(1, 12))))
    for _ in range(200):
        made.append("".join(dice.choice("a1@.+-( )5%\n") for _ in range(dice.randint(1, 60))))
    return made


def with_candidates(spark, rows):
    docs = spark.createDataFrame([(i, t, "kept", 5) for i, t in enumerate(rows)], "doc_id long, text string, spans string, k int")
    return pd_.candidates(docs)


def test_base_spans_match_python(spark):
    rows = texts() + [None]
    got = {r.doc_id: r for r in with_candidates(spark, rows).collect()}
    for i, text in enumerate(rows):
        assert got[i].spans == "kept" and got[i].k == 5
        assert [(c.k, c.s, c.e) for c in got[i].candidates if c.k < pd_.BASE] == base(text), text
    assert sum(len(base(t)) for t in rows) > 400


def test_repeated_runs_take_linear_time(spark):
    made = lambda n: ["9" * n, "a" * n, "1.1." * (n // 4), "+1 " * (n // 3), "a1." * (n // 3), "Aa " * (n // 3), "x@y.zz " * (n // 7)]
    seconds = {}
    for n in (1_000, 100_000):
        start = time.perf_counter()
        rows = with_candidates(spark, made(n)).collect()
        seconds[n] = time.perf_counter() - start
        for r, text in zip(rows, made(n)):
            assert [(c.k, c.s, c.e) for c in r.candidates if c.k < pd_.BASE] == base(text)
    assert seconds[100_000] < 30


def made_docs(seed=3, n=400):
    """(text, sure spans as (kind, string), strings that must stay out)."""
    dice = random.Random(seed)
    words = "the of and report value section house green river paper summer".split()

    def digits(k):
        return "".join(dice.choice("0123456789") for _ in range(k))

    def card():
        d = dice.choice("456") + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def iban():
        body, country = digits(18), "DE"
        check = 98 - int(body + "131400") % 97
        return f"{country}{check:02d}{body}"

    rows = []
    for i in range(n):
        prose = [dice.choice(words) for _ in range(dice.randint(5, 60))]
        want, out = [], []
        for _ in range(dice.randint(0, 4)):
            kind = dice.choice(["email", "ip", "card", "phone", "two cards", "iban", "contact", "name", "hash", "version", "wrong iban"])
            if kind == "two cards":
                a, b = card(), card()
                prose += ["cards", f"{a} {b}"]
                want += [("number", a), ("number", b)] if a != b else []
            elif kind == "iban":
                prose += ["IBAN", iban()]
                want.append(("iban", prose[-1]))
            elif kind == "contact":
                prose += ["mail", f"{dice.choice(words)}{digits(2)} (at) mail{digits(1)} [dot] org"]
                want.append(("contact", prose[-1]))
            elif kind == "name":
                prose += ["Dear", f"{dice.choice(pd_.FIRST_NAMES)} Meier"]
                want.append(("name", prose[-1]))
            elif kind == "hash":
                prose += [f"commit_{digits(10)}a"]
                out.append(prose[-1])
            elif kind == "version":
                prose += ["version", f"{digits(2)}.{digits(3)}.{digits(5)}"]
                out.append(prose[-1])
            elif kind == "wrong iban":
                prose += ["part", f"DE00{digits(16)}99"]
                out.append(prose[-1])
            else:
                prose += {"email": [f"{dice.choice(words)}@mail.example.com"], "ip": [f"{dice.randint(1, 200)}.{dice.randint(0, 255)}.3.4"],
                          "card": [card()], "phone": [f"+1 ({digits(3)}) 555-{digits(4)}"]}[kind]
            prose += [dice.choice(words)]
        rows.append((" ".join(prose), want, out))
    return rows


def test_finds_what_the_patterns_miss(spark):
    rows = made_docs()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string, candidates0 string, personal int")
    found = pd_.find(docs)
    assert found.columns == ["doc_id", "text", "candidates0", "personal"]
    caught = missed = 0
    for r in found.collect():
        text, want, out = rows[r.doc_id]
        spans = {(pd_.KINDS[s.k], text[s.s:s.e]) for s in r.personal}
        assert {(s.k, s.s, s.e) for s in r.personal if s.k < pd_.BASE} == set(base(text))
        for w in want:
            caught, missed = caught + (w in spans), missed + (w not in spans)
        for kind, string in spans:
            if kind in ("number", "iban", "contact", "name"):
                assert not any(string in o or o in string for o in out), (string, text)
    assert caught >= 0.95 * (caught + missed) and caught > 100


def test_label_model_matches_a_dense_one(spark):
    rows = made_docs(seed=4)
    found = with_candidates(spark, [t for t, _, _ in rows])
    counted = pd_.patterns(found).cache()
    model = pd_.fit_label_model(counted, rounds=5)
    data = [(r.k, list(r.votes), r.n) for r in counted.collect()]
    k, v, n = np.array([d[0] for d in data]), np.array([d[1] for d in data]) + 1, np.array([d[2] for d in data], float)
    prior = np.full(len(pd_.KINDS), 0.5)
    rates = np.array([[pd_.START[y]] * len(pd_.LABELERS) for y in (0, 1)], float)
    for _ in range(5):
        like = [np.prod([rates[y, j, v[:, j]] for j in range(v.shape[1])], axis=0) for y in (0, 1)]
        p = prior[k] * like[1] / (prior[k] * like[1] + (1 - prior[k]) * like[0])
        w = [n * (1 - p), n * p]
        prior = np.array([(w[1][k == i].sum() + 1) / (n[k == i].sum() + 2) for i in range(len(prior))])
        for y in (0, 1):
            t = w[y].sum()
            rates[y] = [[(w[y][v[:, j] == x].sum() + (pd_.ANCHOR * t + 1) * pd_.START[y][x]) / ((1 + pd_.ANCHOR) * t + 1) for x in range(3)] for j in range(v.shape[1])]
    assert np.allclose(model.prior, prior, atol=1e-6)
    assert np.allclose([model.rates[0], model.rates[1]], rates, atol=1e-6)
    # what voted against a span is believed more often than not
    assert all(r[0] <= o[0] + 1e-9 for r, o in zip(model.rates[1], model.rates[0]))


def test_account_number_rule(spark):
    rows = [("GB82WEST12345698765432", 1), ("DE89370400440532013000", 1), ("FR14 2004 1010 0505 0001 3M02 606", 1), ("GB82WEST12345698765431", 0)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(pd_._mod97(F.col("t")).alias("m")).collect()
    assert [(r.m == 1) for r in got] == [bool(x) for _, x in rows]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pd_.find(docs).collect() == []
    rows = pd_.find(spark.createDataFrame([(None, None), (1, ""), (1, "plain words")], "doc_id long, text string")).collect()
    assert all(r.personal == [] for r in rows) and len(rows) == 3


@pytest.mark.parametrize("votes", [[0] * 7])
def test_no_vote_no_gain(votes):
    model = pd_.LabelModel()
    assert all(abs(g[1]) < 1e-12 for g in model.gains) and len(votes) == len(pd_.LABELERS)

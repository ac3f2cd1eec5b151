"""Collocations against counting every phrase at every place."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, "x", 7, "y") for i, (t, l) in enumerate(rows)], SCHEMA)


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def brute(rows, least=30, kept=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    covered = set()
    for lang, p in found:
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * f[lang, p] >= 80 * f[lang, p[i:i + size]]:
                    covered.add((lang, p[i:i + size]))
    out = []
    for lang in n:
        best = sorted((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in found.items() if g == lang and (g, p) not in covered)
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(best[:kept])]
    return sorted(out)


def texts(seed=3, n=120, vocabulary=25):
    rng = np.random.default_rng(seed)
    words = [f"Wo{i}" if i % 3 else f"ö{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 120))
        picked = [words[min(int(w), vocabulary - 1)] for w in rng.geometric(0.15, size) - 1]
        marks = [(" ", "  ", "\t", ". ", ",", "\n", " - ")[int(m)] for m in rng.integers(0, 7, size)]
        rows.append(("".join(w + m for w, m in zip(picked, marks)), (None, "en", "de", "und", "")[i % 5]))
    return rows


def test_matches_counting_every_place(spark):
    rows = texts() + [("same words all over here now. " * 40, "en")] * 3 + [
        (None, "en"), ("", None), (" \t\n.", "de"), ("a " * 400, "fr"), ("b b b b", None), ("İ KELVINK ß x y " * 31, "tr"), ("x" * 50_000 + " y", "fr")]
    got = sorted(tuple(r) for r in co.collocations(table(spark, rows)).collect())
    assert got == brute(rows)
    assert len(got) > 20


@pytest.mark.parametrize("spacing", [1, 3, 10 ** 9])
def test_chunks_of_any_size_hold_each_phrase_once(spark, spacing):
    rows = [(t, l or "") for t, l in texts(seed=11)] + [("same words all over here now. " * 40, "en"), ("a " * 400, "fr"), ("b b b b", "")]
    chunks = co.parse(table(spark, rows), spacing).select("lang", "chunk", "last", "n").toArrow().combine_chunks()
    found = Counter()
    for size in range(1, 5):
        for batch in co._counter(size, None)(iter(chunks.to_batches())):
            for r in batch.to_pylist():
                found[r["lang"], r["phrase"]] += r["f"]
    want = Counter(
        (l, " ".join(w[i:i + size])) for t, l in rows for w in pieces(t) for size in range(1, 5) for i in range(len(w) - size + 1))
    assert found == want


def test_keeps_the_first_phrases_only(spark):
    rows = texts(seed=5, n=60)
    got = sorted(tuple(r) for r in co.collocations(table(spark, rows), least=3, kept=7).collect())
    assert got == brute(rows, least=3, kept=7)
    assert {r[1] for r in got} == set(range(1, 8))


def test_empty_tables(spark):
    assert co.collocations(table(spark, [])).collect() == []
    assert co.collocations(table(spark, [(None, None)])).collect() == []


def test_equal_passages_give_equal_chunks(spark):
    passage = " ".join(f"word{i * 7 % 31} other{i}" for i in range(400))
    rows = [(f"{'lead ' * i}in {passage} out {i}", "en") for i in range(20)]
    chunks = co.parse(table(spark, rows)).collect()
    assert max(r.n for r in chunks) == 20
    # the passage stands in the dictionary once; its ends, and what is around it, differ
    assert sum(len(r.chunk) for r in chunks) < 3 * len(passage)


def test_chunks_cover_every_word_once(spark):
    rows = texts(seed=9)
    counted = {r.lang: r.n for r in co.phrase_counts(co.parse(table(spark, [(t, l or "") for t, l in rows])), least=10 ** 6)[0].collect()}
    want = Counter()
    for t, l in rows:
        want[l or ""] += sum(len(p) for p in pieces(t))
    assert counted == {k: v for k, v in want.items() if v}


def test_products_beyond_64_bits(spark):
    big = 10 ** 13
    counts = spark.createDataFrame(
        [("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], "lang string, size int, phrase string, f long")
    total = spark.createDataFrame([("en", 4 * big)], "lang string, n long")
    row = co.score_phrases(total, counts).first()
    assert row.score == 2_000_000 * big // (3 * big + 1)


def test_a_phrase_marked_frequent_is_found_again(spark):
    phrases = spark.createDataFrame([("en", f"p{i} q{i}") for i in range(500)], "lang string, phrase string")
    bits = np.frombuffer(co._table_of(phrases, 2), np.uint8)
    words = co.Words(pa.array([f"p{i} q{i}" for i in range(1000)]))
    codes, distinct = words.encoded()
    lang = np.repeat(co._string_hashes(pa.array(["en"])), len(words))
    has = co._has(bits, co._phrase_hashes(lang, co._string_hashes(distinct)[codes], np.arange(0, len(words), 2), 2))
    assert has[:500].all() and has[500:].mean() < 0.05

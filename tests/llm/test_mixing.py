import hashlib
import math
import re

import pytest

from lotwise.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def made():
    rows = []
    for s, (source, n) in enumerate([("b", 300), ("a", 100), (None, 150), ("ä", 40), ("B", 500), ("", 60), ("zero", 3)]):
        for i in range(n):
            text = None if source == "zero" else " ".join(["w"] * (1 + (i * 7 + s) % 50)) + "\t \n"
            rows.append((1000 * s + i, text, source))
    return rows + [(1, "one two", "b"), (1, "one two", "b"), (7777, "", "a"), (7778, " x ", "a")]


def brute(rows, weights=(5, 2, 1), share=1.5, most=2):
    words = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    sources = sorted({s for _, _, s in words}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n, x in words if x == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    capped, level = set(), 0
    while len(capped) < len(sources):
        left = share * sum(total.values()) - sum(most * total[s] for s in capped)
        level = left / sum(weight[s] for s in sources if s not in capped)
        new = {s for s in sources if weight[s] * level >= most * total[s]} - capped
        if not new:
            break
        capped |= new
    target = {s: most * total[s] if s in capped else weight[s] * level for s in sources}
    found = []
    for s in sources:
        if not total[s]:
            found += [(d, n, 0, 0.0, 0) for d, n, x in words if x == s]
            continue
        whole = int(target[s] / total[s])
        wanted, so_far = target[s] - whole * total[s], 0
        p, count = target[s] / total[s] - whole, sum(x == s for _, _, x in words)

        def rank(d, n):
            u = (int(hashlib.md5(f"{d}:mix".encode()).hexdigest()[:15], 16) + 0.5) / float(1 << 60)
            odds = p / (1 - p) * math.sqrt(n * count / total[s])
            return min(math.floor(u / (u + (1 - u) * odds) * float(1 << 48)), (1 << 48) - 1) if 0 < p < 1 else (1 << 48) - 1

        order = sorted((rank(d, n), d, n) for d, n, x in words if x == s)
        for _, d, n in order:
            extra = wanted > 0 and so_far + n / 2 <= wanted
            so_far += n
            found.append((d, n, total[s], target[s], (whole + extra) * n))
    return sorted(found), target


@pytest.mark.parametrize("rows_in_range", [5000, 3])
def test_mix(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(mixing, "ROWS_IN_RANGE", rows_in_range)
    rows = made()
    docs = spark.createDataFrame([(d, t, s, 9, "x") for d, t, s in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect())
    want, target = brute(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))
    assert abs(sum(target.values()) - 1.5 * sum(w[1] for w in want)) < 1e-6
    assert all(g[4] <= 2 * g[1] for g in got)


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    only = mixing.mix(spark.createDataFrame([(1, None, None, 0, ""), (None, "", "a", 0, "")], SCHEMA)).collect()
    assert [(r.size, r.taken) for r in only] == [(0, 0), (0, 0)]


def test_odds_change_the_order(spark):
    """Of a source's documents, longer ones are taken more often, and some short ones before some long ones."""
    rows = [(i, "w " * (1 if i % 2 else 25), "a") for i in range(2000)] + [(5000 + i, "w", "b") for i in range(10_000)]
    docs = spark.createDataFrame([(d, t, s, 0, "") for d, t, s in rows], SCHEMA)
    got = [r for r in mixing.mix(docs, weights=(1, 4)).collect() if r.source == "a"]
    share = {size: sum(r.copies > 1 for r in got if r.size == size) / 1000 for size in (1, 25)}
    assert 0.03 < share[1] < share[25] - 0.1


def test_rows_without_doc_id_are_told_apart_by_their_text(spark):
    docs = spark.createDataFrame([(None, f"w{i}", "a", 0, "") for i in range(500)] + [(1, "w " * 1500, "b", 0, "")], SCHEMA)
    taken = [r.copies for r in mixing.mix(docs, weights=(1, 9)).collect() if r.source == "a"]
    assert 0 < sum(taken) < 500

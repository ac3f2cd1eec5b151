"""Stages on a small table with every odd case, each against what it must do to it."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lotwise import scale
from lotwise.llm import mixing, packing
from lotwise.scale import settle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, secret_spans string, size int"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def made():
    dice = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows, toxic = [], {}
    for i in range(400):
        text = [dice.choice(words) for _ in range(dice.randint(20, 120))]
        toxic[i] = i % 5 == 0
        if toxic[i]:
            for _ in range(3):
                text[dice.randrange(len(text))] = dice.choice(["idiot", "moron", "zorkflat", "zorkbent"])
        rows.append((i, " ".join(text), f"src{i % 3}"))
    rows += [(1000 + i, rows[3 * i + 1][1] + " tail", "src9") for i in range(40) if not toxic[3 * i + 1]]
    rows += [(2000 + i, f"note {i} password=abcdef{i}0123456789 end of the note {i} {dice.choice(words)}", None) for i in range(20)]
    rows += [(3000, None, "src1"), (3001, "", "src1"), (3002, " ", "src2"), (3003, "x " * 60_000, "src2"), (1, rows[1][1], "src1"), (1, rows[1][1], "src1")]
    return rows, toxic


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, toxic = made()
    docs = [(d, t, "en", s, len(t or ""), 5, "z", 1) for d, t, s in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, int(y)) for d, y in toxic.items() if d % 4]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic


def test_stages(spark, tables):
    folder, rows, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = settle(pipeline.drop_toxic(spark, docs, folder))
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    held = [d for d in toxic if held_out(d)]
    assert sum(toxic[d] != (d not in ids) for d in held) <= 0.05 * len(held)
    assert all(d in ids for d, _, _ in rows if d >= 1000)

    unlike = settle(pipeline.drop_near_copies(spark, left, folder))
    assert unlike.columns == docs.columns
    kept = [r.doc_id for r in unlike.collect()]
    assert kept.count(1) == 1 and len(kept) == len(set(kept))
    assert set(kept) == {d for d in ids if not 1000 <= d < 2000}

    masked = settle(pipeline.mask_secrets(spark, unlike, folder))
    assert masked.columns == docs.columns and masked.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    after = {r.doc_id: r for r in masked.collect()}
    assert set(after) == set(kept)
    before = {d: t for d, t, _ in rows}
    for d, r in after.items():
        if 2000 <= d < 3000:
            assert "[SECRET]" in r.text and "password" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == before[d]

    mixed = settle(pipeline.mix_sources(spark, masked, folder))
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    plan = {r.doc_id: r for r in mixing.mix(masked).collect()}
    assert counts == {d: r.copies for d, r in plan.items() if r.copies}

    packed = pipeline.pack_sequences(spark, mixed, folder).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in mixed.collect()])


def check_packed(packed, docs):
    want = []
    for doc, text in docs:
        ids = packing.token_ids(text or "") + bytes(4)
        n = len(ids) // 4
        start, piece = 0, 0
        while start < n:
            end = start + (n - start - 1) % 2048 + 1
            want.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start:4 * end])))
            start, piece = end, piece + 1
    assert sorted(want) == sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed)
    sequences = {}
    for p in packed:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p.length for p in packed)
    assert len(sequences) <= -(-total // 2048) + 2


def test_run(spark, tables):
    folder, _, _ = tables
    out = pipeline.run(spark, folder)
    assert out.count() > 300 and "sequence_id" in out.columns


def test_run_keeps_the_last_stage_only(spark, tables):
    folder, _, _ = tables
    start = len(scale._KEPT)
    out = pipeline.run(spark, folder)
    kept = [spark.read.parquet(p).columns for p in scale._KEPT[start:]]
    assert kept.count(out.columns) == 1
    assert not [c for c in kept if {"text", "n_chars"} <= set(c)]


def test_stages_of_an_empty_table(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, folder))
        assert docs.count() == 0

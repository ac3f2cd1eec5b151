import hashlib
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from lotwise.llm import warc

PAGES = [
    (1, "http://a/1", "<p>" + "x" * 200, "no"), (2, "http://a/ü \n2", "<p>" + "x" * 200, "no"), (3, None, "short", "no"),
    (4, "http://a/4", "short", "no"), (5, "http://a/5", None, "no"), (6, "http://a/6", "", "no"), (7, "u", "é" * 40_000, "no"),
    (None, "http://a/n", "<p>" + "x" * 200, "no"), (9, "http://a/9", "\0\r\n\r\nWARC/1.1\r\n" * 20, "no"), (9, "http://a/9", "\0\r\n\r\nWARC/1.1\r\n" * 20, "no"),
]
SCHEMA = "page_id long, url string, html string, payload string"


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(first.get(raw, page), page)
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = raw in first and first[raw] != page
        yield (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
               first[raw] if revisit else None, None if revisit else raw)


@pytest.mark.parametrize("rows", [PAGES, PAGES * 3, [], [(i, f"http://h/{i}", f"<html>{i % 50} some page with text " * 30, "") for i in range(400)]])
def test_round_trip(spark, rows):
    got = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = str
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in got]
    mine = [m[:5] + (b"" if m[5] is None and m[3] == "response" else m[5],) for m in mine]
    assert sorted(mine, key=key) == sorted(expected(rows), key=key)


def test_any_reader_can_read_the_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i} " + "some text " * 40, "") for i in range(500)], SCHEMA)
    dictionary = warc.train(pages)
    assert dictionary.startswith(warc.DICTIONARY_MAGIC)
    warc.write(pages.repartition(2), str(tmp_path / "w"), dictionary, per_file=100)
    files = [tmp_path / "w" / f for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    assert 5 <= len(files) <= 7
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    for file in files:
        raw = file.read_bytes()
        found = list(warc.frames(raw))
        assert found[0][0] == warc.DICTIONARY and len([f for f in found if f[0] == warc.FRAME]) <= 100
        whole = b"".join(plain.decompressobj().decompress(raw[s:e]) for m, s, e in found if m == warc.FRAME)
        assert whole.count(b"WARC/1.1\r\n") == len([f for f in found if f[0] == warc.FRAME])
    assert warc.read(spark, str(tmp_path / "w")).agg(F.countDistinct("page_id")).first()[0] == 500


def test_damage_is_found():
    good = warc.record("response", 1, "http://a", hashlib.sha256(b"abc").hexdigest(), b"abc", None)
    assert warc.parse(good)[1] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Dated"), good.replace(b"WARC/1.1", b"WARC/9.9"),
                good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good * 10)
    assert list(warc.frames(frame * 2)) == [(warc.FRAME, 0, len(frame)), (warc.FRAME, len(frame), 2 * len(frame))]
    for bad in (frame[:-1], frame[:6], b"nonsense!" + frame):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))

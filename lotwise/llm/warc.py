"""Web archives (WARC 1.1) compressed by Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lotwise.scale import scratch_path, settle

# Fixed values of the formats.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A50, 0x184D2A5D, 0xFD2FB528
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
# Spark's text writer puts a separator behind each row: an empty skippable frame, which every Zstandard reader skips.
EMPTY_FRAME = "P*M\x18\0\0\0\0"

SHORTEST_REVISIT = 100
RECORDS_IN_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"
# The dictionary learns from so many pages of at most so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads, drawn by a hash; empty if there is too little to learn."""
    size = F.octet_length("html")
    pages = pages.where((size > 0) & (size <= SAMPLE_BYTES))
    dice = F.pmod(F.xxhash64(F.lit("dictionary"), "page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    sample = pages.where(dice < SAMPLE_PAGES / max(pages.count(), 1)).select(F.col("html").cast("binary").alias("payload"))
    payloads = sorted(bytes(r.payload) for r in sample.limit(2 * SAMPLE_PAGES).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes() if payloads else b""
    except zstandard.ZstdError:
        return b""


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload as an HTTP body, or a revisit that points to the response with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", page_urn(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{name}: {value}\r\n".encode() for name, value in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + END


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(found) if found else None


def write(pages: DataFrame, path: str, dictionary: bytes, per_file: int = RECORDS_IN_FILE) -> None:
    """Archives of `pages` (page_id, url, html) in the folder `path`, at most `per_file` records each.

    Of records with equal payloads of at least SHORTEST_REVISIT bytes that with the smallest page_id is the response
    (all of them, if a row repeats), the others revisit it. Groups of equal payloads are found from partial sums of
    their digests; payloads do not move unless there are too many groups to send to every task.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = (
        rows.where(F.octet_length("payload") >= SHORTEST_REVISIT).groupBy(F.col("digest").alias("group"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    )
    rows = rows.join(settle(groups.select("group", "first")), F.col("digest") == F.col("group"), "left")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=given, write_checksum=True, write_content_size=True)
        start = skippable(DICTIONARY, zstandard.ZstdCompressor(level=19).compress(dictionary))
        n = 0
        for batch in batches:
            frames = []
            for page_id, url, content, digest, first in batch.itertuples(index=False, name=None):
                page_id = None if pd.isna(page_id) else int(page_id)
                first = None if pd.isna(first) else int(first)
                kind = "response" if first is None or first == page_id else "revisit"
                if n % per_file == 0:
                    frames.append(start)
                frames.append(packer.compress(record(kind, page_id, url, digest, content, first)))
                n += 1
            yield pd.DataFrame({"frame": frames})

    frames = rows.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest",
        F.col("first").cast("string").alias("first"),
    ).mapInPandas(records, "frame binary")
    # a row is a frame; each file starts with the row that holds the dictionary
    (
        frames.select(F.col("frame").cast("string").alias("value")).write
        .option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", per_file + 1).text(path)
    )


def frames(archive: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of every frame; ValueError if one is cut short or is none."""
    at = 0
    while at < len(archive):
        if len(archive) < at + 8:
            raise ValueError("frame cut short")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & ~0xF == SKIPPABLE:
            end = at + 8 + size
        elif magic == FRAME:
            end, last = at + zstandard.frame_header_size(archive[at: at + 18]), False
            while not last:
                if len(archive) < end + 3:
                    raise ValueError("frame cut short")
                block = int.from_bytes(archive[end: end + 3], "little")
                last, kind, length = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else length)
            end += 4 if archive[at + 4] & 4 else 0
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")
        if end > len(archive):
            raise ValueError("frame cut short")
        yield magic, at, end
        at = end


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; ValueError if a header is missing or a length or digest is wrong."""
    head, found, rest = content.partition(END)
    version, *lines = head.split(b"\r\n")
    if not found or version != VERSION:
        raise ValueError("no WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"bad header {name!r}")
        headers[name.strip()] = value.strip()
    if missing := [name for name in REQUIRED if name not in headers]:
        raise ValueError(f"no {missing[0]}")
    length = int(headers["Content-Length"])
    if len(rest) != length + len(END) or not rest.endswith(END):
        raise ValueError("wrong Content-Length")
    http, _, payload = rest[:length].partition(END)
    stated = [line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    headers["payload"] = stated[0].split(b":")[1].strip().decode() if stated else str(len(payload))
    if headers["WARC-Type"] == "response":
        if int(headers["payload"]) != len(payload):
            raise ValueError("wrong length of the HTTP body")
        given = headers.get("WARC-Payload-Digest", "")
        if given and given != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError("wrong digest")
    elif headers["WARC-Type"] == "revisit" and ("WARC-Refers-To" not in headers or payload):
        raise ValueError("bad revisit")
    return headers, payload


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of every record of an archive."""
    unpack = zstandard.ZstdDecompressor()
    for magic, start, end in frames(archive):
        if magic == DICTIONARY:
            if start:
                raise ValueError("dictionary behind the start")
            content = archive[start + 8: end]
            if content[:4] == struct.pack("<I", FRAME):
                content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
            if content:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == FRAME:
            yield parse(unpack.decompressobj().decompress(archive[start:end]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in the folder `path`: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and payload (null for revisits; the length and digest are still those of the full payload). Files are
    read whole by tasks: their size is bounded by the records in one. A damaged archive fails with its file's name."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, archive in zip(batch.path, batch.content, strict=True):
                rows = []
                try:
                    for head, payload in records(archive):
                        response = head["WARC-Type"] == "response"
                        rows.append((
                            _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], int(head["payload"]),
                            head.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
                            None if response else _page(head["WARC-Refers-To"]), payload if response else None))
                except (ValueError, zstandard.ZstdError) as error:
                    raise ValueError(f"{name}: {error}") from error
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in columns])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    columns = (
        "page_id bigint", "url string", "record_type string", "payload_bytes bigint", "payload_digest string",
        "refers_to bigint", "payload binary")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, ", ".join(columns))


def archive(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back; see `write` and `read`.

    Null html is empty. A null page_id has no number in its record; it is a response unless a page with a number has
    the same payload. Null urls have no Target-URI; odd characters of urls are percent-encoded. Repeated rows give a
    record each. Other columns are left out; no rows give no rows.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, train(pages))
    return read(pages.sparkSession, path)

"""Best-fit packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from lotwise.scale import settle

VOCABULARY = "byte_bpe_50k"
TOKENS = 2048
# Sequences a task keeps open, and the tokens it packs.
OPEN = 4096
TOKENS_IN_TASK = 16_000_000
END = bytes(4)

# Texts of these characters only are cut by the faster library; the two differ on some rare ones.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\u024F\u2013-\u201E\u20AC]*")


@cache
def _libraries(name: str) -> tuple[Tokenizer, tiktoken.Encoding, tuple[str, ...]]:
    """The tokenizer, the same vocabulary for a library about four times as fast, and the strings that are one token."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tokenizer, tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def token_ids(text: str, vocabulary: str = VOCABULARY) -> bytes:
    """Token ids as bytes of unsigned 32-bit little-endian numbers, as the tokenizer gives them."""
    tokenizer, fast, special = _libraries(vocabulary)
    if PLAIN.fullmatch(text) and not any(s in text for s in special):
        return array("I", fast.encode_ordinary(text)).tobytes()
    return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, tokens: int = TOKENS) -> DataFrame:
    """Each row of `docs` (doc_id, text) as pieces of at most `tokens` tokens: its ids, then id 0. Only longer documents
    are cut, into pieces of `tokens`, the first of which may be shorter. Null texts are empty: a lone id 0."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                found = token_ids(text, vocabulary) + END
                n = len(found) // 4
                first = n % tokens or tokens
                ends = range(first, n + 1, tokens)
                for piece, end in enumerate(ends):
                    start = end - (tokens if piece else first)
                    rows.append((doc, piece, start, end - start, zlib.crc32(found[4 * start: 4 * end])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class OpenBins:
    """A fixed number of open bins, in a bitset keyed by free space."""

    def __init__(self, room: int, most: int):
        self.room, self.most, self.n_open, self.next = room, most, 0, 0
        self.bits = 0  # bit f is set if a bin with f free is open
        self.by_free: list[list[int]] = [[] for _ in range(room + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of an item: the open bin with the least free space that fits it; if there is none a new bin
        opens, and the fullest closes first if too many are open."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.room, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_, self.room - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, tokens: int = TOKENS, open_bins: int = OPEN) -> DataFrame:
    """Pack the pieces of all documents (see `pieces`) into as few sequences of at most `tokens` tokens as it can.

    Texts are tokenized where they are read; only a row per piece is shuffled. Each task packs about TOKENS_IN_TASK
    tokens on its own: whole pieces fill a sequence each, the others are dealt by hash, long ones before short ones,
    and each goes to the open sequence with the least space that holds it. Of at most `open_bins` open sequences the
    fullest closes first. Tasks see their rows in a fixed order, so a lost task gives the same rows again.

    Adds sequence_id and offset to the pieces; in a sequence the offsets are gapless from 0. Null and empty texts are
    one piece of length 1. A null doc_id stays null; repeated rows are packed each on their own. Other columns are left
    out; no rows give no rows.
    """
    cut = settle(pieces(docs, vocabulary, tokens))
    total = cut.where(F.col("length") < tokens).agg(F.sum("length")).first()[0] or 0
    tasks = -(-total // TOKENS_IN_TASK) or 1

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(tokens, open_bins)
        for batch in batches:
            placed = [bins.place(x) for x in batch.length]
            out = batch.assign(bin=[x[0] for x in placed], offset=[x[1] for x in placed])
            yield out.astype({"doc_id": "Int64"})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    whole = cut.where(F.col("length") == tokens).select(
        *columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    dealt = (
        cut.where(F.col("length") < tokens)
        .repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", "start"))
        .sortWithinPartitions(F.col("length").desc(), *columns)
    )
    filled = dealt.mapInPandas(fill, f"{kind}, bin bigint, offset bigint").withColumn(
        "task", F.spark_partition_id().cast("bigint"))
    # negative numbers, apart from those of the whole pieces
    number = -1 - (F.col("task") * F.lit(1 << 33) + F.col("bin"))
    return whole.unionByName(filled.select(*columns, number.alias("sequence_id"), "offset"))

"""Phrases of words that stand together, counted in the distinct chunks of a prefix-free parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.llm.portions import portions
from lotwise.llm.sums import merged
from lotwise.scale import settle

# Words of a phrase at most; a chunk and the next share one word less.
LONGEST = 4
SHARED = LONGEST - 1
# One of so many places, on average, starts a chunk.
SPACING = 24
LEAST, SCORE_SCALE, COVERED_PERCENT, KEPT = 30, 2_000_000, 80, 2_000
NO_LANGUAGE = "und"
# Bits of the table that tells which phrases can be frequent: so many for each of them, 4 MB at most.
BITS_EACH, MOST_BITS = 16, 1 << 25

# Bytes that end a word, and those that also end a piece; fixed values.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(
    10 if b in BREAKS else 32 if b in b" \t" else b + 32 if 65 <= b <= 90 else b for b in range(256))
# Odd numbers that spread hashes over 64 bits; fixed values.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _M1
    return h ^ (h >> np.uint64(32))


def _string_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of strings from their bytes and nothing else: sums of mixed (byte, place)."""
    data, offsets = _bytes_of(words)
    sizes = np.diff(offsets)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1].astype(np.uint64), sizes)
    each = _mixed((place + np.uint64(1)) * _M2 + data.astype(np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    return _mixed(total[offsets[1:]] - total[offsets[:-1]] + sizes.astype(np.uint64))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array without nulls."""
    words = words.cast(pa.large_string())
    if len(words) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.zeros(0, np.uint8)
    return body, at - at[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """The words of some texts one after the other: text number, size in bytes, whether the same piece goes on behind."""

    def __init__(self, texts: pa.Array):
        # every word has a gap behind it
        raw, offsets = _bytes_of(pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
        data = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
        inside = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        self.sizes = ends - starts
        self.text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
        self.goes_on = np.ones(len(starts), bool)
        before = np.searchsorted(starts, np.flatnonzero(data == 10)) - 1
        self.goes_on[before[before >= 0]] = False
        self._data, self._inside, self._ends = data, inside, ends

    def __len__(self) -> int:
        return len(self.sizes)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word, the distinct words)."""
        words = _strings(self._data[self._inside], np.concatenate([[0], np.cumsum(self.sizes)])).dictionary_encode()
        return words.indices.to_numpy(zero_copy_only=False), words.dictionary

    def normal(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets): the words, each with one byte behind it: a blank, or a line break where a piece ends."""
        keep = self._inside.copy()
        keep[self._ends] = True
        data, offsets = self._data[keep], np.concatenate([[0], np.cumsum(self.sizes + 1)])
        data[offsets[1:] - 1] = np.where(self.goes_on, 32, 10)
        return data, offsets


def _chunks(words: Words, spacing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, whether it is the last of its text) of each chunk.

    A chunk starts where a text starts and wherever the hash of the next SHARED words says so, and goes on to the end of
    the words that say so next; both are seen in its words alone, so equal passages give equal chunks wherever they
    stand. The SHARED words at its end belong to the next chunk.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    codes, distinct = words.encoded()
    h = _string_hashes(distinct)[codes]
    whole = np.zeros(n, np.uint64)
    fits = np.zeros(n, bool)
    if n >= SHARED:
        window = h[:n - SHARED + 1].copy()
        for i in range(1, SHARED):
            window = _mixed(window * _M2 + h[i:n - SHARED + 1 + i])
        whole[:n - SHARED + 1] = window
        fits[:n - SHARED + 1] = words.text[:n - SHARED + 1] == words.text[SHARED - 1:]
    new = np.concatenate([[True], words.text[1:] != words.text[:-1]])
    first = np.flatnonzero(new | (fits & (_mixed(whole) % np.uint64(spacing) == 0)))
    last = np.concatenate([new[first[1:]], [True]])
    text_end = np.searchsorted(words.text, words.text[first], side="right")
    end = np.where(last, text_end, np.concatenate([first[1:], [n]]) + SHARED)
    return first, end, last


def _parser(spacing: int):
    """Texts -> their chunks, equal ones of a batch and a language counted. A chunk's text is its words with a blank, or
    a line break where a piece ends, between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in portions(batches, "text"):
            words = Words(table["text"].combine_chunks())
            first, end, last = _chunks(words, spacing)
            data, at = words.normal()
            low = at[first]
            sizes = at[end] - 1 - low
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - low, sizes)
            chunks = pa.table({
                "lang": table["lang"].take(pa.array(words.text[first])), "chunk": _strings(data[place], offsets), "last": pa.array(last)})
            counted = chunks.group_by(["lang", "chunk", "last"], use_threads=False).aggregate([([], "count_all")])
            yield pa.RecordBatch.from_arrays(
                [counted[c].combine_chunks().cast(t) for c, t in (
                    ("lang", pa.string()), ("chunk", pa.string()), ("last", pa.bool_()), ("count_all", pa.int64()))],
                names=["lang", "chunk", "last", "n"])

    return run


def parse(docs: DataFrame, spacing: int = SPACING) -> DataFrame:
    """The dictionary of the parse of `docs` (lang string, text string, neither null): rows (lang, chunk, last, n), n how
    often the chunk stands in the texts."""
    found = docs.select("lang", "text").mapInArrow(_parser(spacing), "lang string, chunk string, last boolean, n bigint")
    return found.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def _phrase_hashes(language: np.ndarray, h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    window = language[starts] * _M1
    for i in range(size):
        window = _mixed(window * _M2 + h[starts + i])
    return window


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(8 * len(table))
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _counter(size: int, frequent: bytes | None):
    """Chunks -> (lang, phrase, f) of the phrases of `size` words that start in the chunk and not in the words it shares
    with the next one, weighted by the chunk's count. With `frequent`, the table of the phrases one word shorter, only
    those whose both parts may be frequent."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(frequent, np.uint8) if frequent else None
        for rows in portions(batches, "chunk"):
            words = Words(rows["chunk"].combine_chunks())
            n = len(words)
            codes, distinct = words.encoded()
            last = rows["last"].to_numpy()
            text_end = np.searchsorted(words.text, np.arange(len(rows)), side="right")
            owned = np.arange(n) < (text_end - np.where(last, 0, SHARED))[words.text]
            for i in range(size - 1):
                owned[:n - i] &= words.goes_on[i:]
                owned[n - i:] = False
            starts = np.flatnonzero(owned)
            lang = rows["lang"].combine_chunks().dictionary_encode()
            lang_code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if table is not None and len(starts):
                h = _string_hashes(distinct)[codes]
                of = _string_hashes(lang.dictionary)[lang_code][words.text]
                may = _has(table, _phrase_hashes(of, h, np.arange(n - size + 2), size - 1))
                starts = starts[may[starts] & may[starts + 1]]
            if not len(starts):
                continue
            weight = rows["n"].to_numpy()[words.text[starts]]
            key = lang_code[words.text[starts]]
            for i in range(size):
                if int(key.max()) >= (1 << 63) // len(distinct) - 1:
                    # numbers of the distinct beginnings so far, so that none outgrows 64 bits
                    key = pa.array(key).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key = key * len(distinct) + codes[starts + i]
            found = pa.table({"key": key, "f": weight, "at": starts}).group_by("key", use_threads=False).aggregate([("f", "sum"), ("at", "min")])
            one = found["at_min"].to_numpy()
            phrase = pc.binary_join_element_wise(*[distinct.take(pa.array(codes[one + i])) for i in range(size)], pa.scalar(" ", pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(lang_code[words.text[one]])).cast(pa.string()), phrase.cast(pa.string()),
                 found["f_sum"].combine_chunks().cast(pa.int64())], names=["lang", "phrase", "f"])

    return count


def _table_of(phrases: DataFrame, size: int) -> bytes:
    """Bits of the hashes of `phrases` (lang, phrase): a phrase's own bit is always set, so phrases that share a bit with a
    frequent one may be counted for nothing, but none is lost."""
    bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * phrases.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if not len(batch):
                continue
            words = Words(batch.column("phrase"))
            codes, distinct = words.encoded()
            h = _string_hashes(distinct)[codes]
            of = np.repeat(_string_hashes(batch.column("lang")), size)
            bit = _phrase_hashes(of, h, np.arange(0, len(words), size), size) % np.uint64(bits)
            np.bitwise_or.at(table, bit >> np.uint64(3), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["part"])

    return merged(phrases.select("lang", "phrase").mapInArrow(mark, "part binary"), "u1", bits // 8, np.bitwise_or).tobytes()


def phrase_counts(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, n): all words; (lang, size, phrase, f): phrases of 1 to `longest` words with f >= least) from the dictionary
    of a parse. A phrase is as frequent as its parts at most, so longer ones are counted only where both their parts one
    word shorter may be frequent."""
    words = settle(chunks.mapInArrow(_counter(1, None), "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.where(F.col("f") >= least)]
    for size in range(2, longest + 1):
        table = _table_of(levels[-1], size - 1)
        counted = chunks.mapInArrow(_counter(size, table), "lang string, phrase string, f bigint")
        levels.append(settle(counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)))
    all_levels = [level.select("lang", F.lit(i + 1).alias("size"), "phrase", "f") for i, level in enumerate(levels)]
    out = all_levels[0]
    for level in all_levels[1:]:
        out = out.unionByName(level)
    return total, out


def _cut(phrase: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def score_phrases(total: DataFrame, counts: DataFrame, kept: int = KEPT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from `phrase_counts`; see `collocations`."""
    candidates = counts.where("size > 1")
    cuts = candidates.select(
        "lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _cut(F.col("phrase"), 1, F.col("k")), "right": _cut(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k"))})
    parts = counts.where(F.col("size") < LONGEST).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")
    with_l = cuts.join(parts.withColumnRenamed("f", "l"), (F.col("lang") == F.col("of")) & (F.col("left") == F.col("part"))).drop("of", "part")
    with_r = with_l.join(parts.withColumnRenamed("f", "r"), (F.col("lang") == F.col("of")) & (F.col("right") == F.col("part"))).drop("of", "part")
    # whole-number division of decimals: a * SCORE_SCALE may pass 64 bits, the quotient can't
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCORE_SCALE}) div (cast(l as decimal(20,0)) + r)")
    lowest = with_r.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: _cut(F.col("phrase"), at, m)))))
    covers = counts.where("size > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED_PERCENT
    free = lowest.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= kept)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first `kept` phrases of 2 to LONGEST words of each language, by how much more often their words stand together
    than apart: (lang, rank from 1, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and split into pieces at . , ; : ! ? and line ends, and these into words at blanks and
    tabs. a is how often the phrase stands within pieces, overlaps included; of its cuts in two parts with l and r
    occurrences, the one with the lowest floor(2000000 a / (l + r)) counts, the first of equal ones. Phrases inside a
    longer one that is at least COVERED_PERCENT as frequent are dropped. n: all words of the language.

    Null texts are empty, rows without language are `und`. Empty texts and tables give no phrases; repeated rows count
    each. A text of any length is parsed whole. Other columns play no part.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total, counts = phrase_counts(settle(parse(rows)), least)
    return score_phrases(total, counts, kept)

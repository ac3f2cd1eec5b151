"""Numbers of tokens by a unigram vocabulary, without the tokens: best score and count of pieces only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, types as T

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
# An unknown character's score is that much below the lowest score of a piece; a fixed value of unigram tokenizers.
PENALTY = 10.0
# Spaces and the word behind them; a space behind something else.
WORD, ACROSS = re.compile(f"{SPACE}+[^{SPACE}]*"), re.compile(f"[^{SPACE}]{SPACE}")
# Words whose counts a task remembers, and their length at most.
REMEMBERED, LONG = 300_000, 64


@cache
def load(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a vocabulary file, without control and unknown pieces; byte pieces are <0x..>."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.get_piece_size()) if not (model.IsControl(i) or model.IsUnknown(i)))
    return tuple((model.IdToPiece(i), float(model.GetScore(i))) for i in kept)


class Counter:
    """Counts the pieces of the segmentation with the highest sum of scores.

    An Aho-Corasick automaton gives the pieces that end at each place, the longest first. Dynamic programming keeps the
    best score, and the number of pieces on the way to it, per place. The rules of a unigram tokenizer: of equal scores
    the piece that starts first wins; a character that is no piece of its own may also be unknown, which wins only if it
    is better than all pieces. Unknown characters count as their bytes if the vocabulary has all byte pieces, else a
    run of them counts as one.

    A word and the spaces before it are cut on their own, so its count is remembered, if no piece goes on from a word to
    a space and runs of unknown characters can't either; else the text is cut as a whole.
    """

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        names = {name for name, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for name, score in pieces:
            # the first of equal pieces counts
            if name not in self.automaton:
                self.automaton.add_word(name, (len(name), score))
        self.automaton.make_automaton()
        self.by_word = SPACE in names and not any(ACROSS.search(name) for name in names)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        # the text gets a space in front if it has none
        whole = SPACE + text.replace(" ", SPACE).removeprefix(SPACE)
        for word in WORD.findall(whole) if self.by_word else [whole]:
            n = known.get(word)
            if n is None:
                n = self.count(word)
                if len(word) <= LONG:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def count(self, word: str) -> int:
        size = len(word)
        best, pieces, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        at, single, found = 0, False, False

        def close(end: int) -> None:
            """All pieces that end here were seen; the character may be unknown."""
            if not single:
                score = best[end - 1] + self.unknown
                if not found or score > best[end]:
                    best[end], unknown[end] = score, True
                    if self.bytes:
                        pieces[end] = pieces[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        pieces[end] = pieces[end - 1] + (not unknown[end - 1])

        for last, (length, score) in self.automaton.iter(word):
            while at <= last:
                if at:
                    close(at)
                at, single, found = at + 1, False, False
            start = at - length
            score += best[start]
            if not found or score > best[at]:
                best[at], pieces[at], unknown[at], found = score, pieces[start] + 1, False, True
            single = single or length == 1
        while at < size:
            if at:
                close(at)
            at, single, found = at + 1, False, False
        if at:
            close(at)
        return pieces[size]


def count_tokens(docs: DataFrame, path: str | None = None, to: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens of its text in a column `to` (bigint), by the vocabulary file at `path`. Nothing
    is shuffled. Null and empty texts have 0 tokens; other columns are kept, but for one that is named `to`."""
    path = path or public_tokenizers.path(VOCABULARY)
    docs = docs.drop(to)
    names = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(path))
        for batch in batches:
            found = pa.array([counter(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, to])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(to, T.LongType())]))

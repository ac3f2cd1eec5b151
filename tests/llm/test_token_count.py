"""Counts against the tokens of a unigram tokenizer."""

import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from lotwise.llm import token_count


def tokenizer(pieces, byte_fallback):
    made = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_count.SPACE, prepend_scheme="always", split=False)
    return made


def texts(alphabet, seed):
    dice = random.Random(seed)
    made = ["", " ", "  ", "a", "a    b", "   a", "a   ", "a  b   c    d", "▁ ▁a", " a", "a ", "▁a▁", "\n", "é", "日本 語", "a" * 3000, "\U0001F600\U0001F600 x", " \n \t "]
    return made + ["".join(dice.choice(alphabet) for _ in range(dice.randint(1, 60))) for _ in range(800)]


@pytest.mark.parametrize("seed", range(4))
def test_small_vocabularies_with_ties(seed):
    dice = random.Random(seed)
    names = {"".join(dice.choice("ab▁c") for _ in range(dice.randint(1, 4))) for _ in range(25)}
    pieces = [(n, float(dice.choice([-1, -2, -3, -2.5]))) for n in sorted(names)]
    reference, counter = tokenizer(pieces, False), token_count.Counter(tuple(pieces))
    for text in texts("abcd  ", seed):
        assert counter(text) == len(reference.encode(text).ids), text


def test_vocabulary_file():
    pieces = list(token_count.load(public_tokenizers.path(token_count.VOCABULARY)))
    reference, counter = tokenizer(pieces, True), token_count.Counter(tuple(pieces))
    assert counter.bytes
    for text in texts("abcdefghi  thenER.,\nüß日́\U0001F600", 9) + ["The quick brown fox, again and again: 3.14159 <0x0A>"]:
        assert counter(text) == len(reference.encode(text).ids), text


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(docs).collect())
    assert got[2:] == [(2, 0), (3, 0)] and got[0] == got[1] and got[0][1] >= 2
    assert token_count.count_tokens(docs.limit(0)).count() == 0

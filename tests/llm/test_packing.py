"""Token ids against the tokenizer itself, and packed pieces against best fit written out."""

import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from lotwise.llm import packing


def reference():
    return Tokenizer.from_file(public_tokenizers.path(f"{packing.VOCABULARY}.json"))


def test_ids_are_the_tokenizers():
    dice, tokenizer = random.Random(3), reference()
    plain = [chr(c) for c in range(0x250) if packing.PLAIN.fullmatch(chr(c))] + [chr(c) for c in range(0x2013, 0x201F)] + ["\u20ac"]
    texts = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "\u65e5\u672c", "\u00ad", "it's  3,000 \n\n x"]
    texts += plain + [a + b for a in "a 1'\n" for b in plain]
    texts += ["".join(dice.choice(plain) for _ in range(dice.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        assert packing.token_ids(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_bins_are_best_fit():
    """The bitset against a list of all open bins."""
    dice = random.Random(5)
    for most in (1, 3, 50):
        bins, open_, opened = packing.OpenBins(100, most), {}, 0
        for _ in range(2000):
            length = dice.choice([1, 7, 30, 50, 99, 100, dice.randint(1, 100)])
            number, offset = bins.place(length)
            fits = [free for free in open_.values() if free >= length]
            if fits:
                assert open_[number] == min(fits) and offset == 100 - min(fits)
            else:
                if len(open_) == most:
                    # the fullest was closed; of equally full ones any
                    closed = [b for b, free in open_.items() if free == min(open_.values())]
                    gone = [b for b in closed if b not in {x for place in bins.by_free for x in place} and b != number]
                    assert len(gone) == 1
                    del open_[gone[0]]
                assert (number, offset) == (opened, 0)
                opened, open_[number] = opened + 1, 100
            open_[number] -= length
            if not open_[number]:
                del open_[number]


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "x " * 5000), (4, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "p", 7) for i, t in rows], "doc_id long, text string, piece string, length int")
    got = packing.pack(docs).collect()
    tokenizer = reference()
    want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    total = {}
    for p in got:
        total.setdefault((str(p.doc_id), p.sequence_id, p.offset), 0)
        total[str(p.doc_id), p.sequence_id, p.offset] += p.length
    assert sum(n for _, n in want) == sum(p.length for p in got) and max(p.length for p in got) <= 2048
    assert sorted(n for i, n in want if i in ("1", "4", "None")) == sorted(p.length for p in got if str(p.doc_id) in ("1", "4", "None"))
    assert packing.pack(docs.limit(0)).collect() == []

"""Tree concatenation against the tokenizers library on whole texts."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm.bpe import Codec, encode_decode, leaves

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    alphabet = ["the", "thandedsh", "'s", "'re", "'ll", "'", "!!", "...", " ", "  ", "\n", "é", "é", "ß", "İ", "12", "3", "日本", "🙂",
                "a" * 40, "ab" * 60, "<|endoftext|>", "<|startoftext|>", "<|endo", "hello", "Wörter", "‍", "x"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400))) for _ in range(n)]


def test_small_leaves_match_whole_encoding():
    coder = Codec(PATH)
    for text in texts(1, 60):
        for leaf in (5, 64, 700):
            assert coder.encode(text, leaf).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_one_unsplit_word():
    coder, rng = Codec(PATH), random.Random(2)
    for parts in (["th", "er", "an", "in", "s", "tion"], ["!", "?", "~"], ["é", "ß", "o"], ["a"]):
        text = "".join(rng.choice(parts) for _ in range(6000))
        assert coder.encode(text, 256).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_leaves():
    assert leaves(0, 4) == [(0, 0)] and leaves(9, 4) == [(0, 2), (2, 4), (4, 6), (6, 9)]


def test_spread_and_short_rows(spark):
    rng = random.Random(3)
    long = ["".join(rng.choice(["the ", "thandedsh", "é ", "'s ", "12\n", "<|endoftext|>"]) for _ in range(12_000)), "z" * 40_000]
    rows = list(enumerate(texts(4, 40) + long + ["", None])) + [(0, "again"), (None, long[0])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, row int")
    got = sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in encode_decode(docs, PATH).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = WHOLE.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, WHOLE.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert encode_decode(docs.limit(0), PATH).count() == 0

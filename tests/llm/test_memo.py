"""Remembered words against the library, on words of every kind side by side."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from llm import memo
from llm.bpe import Codec
from llm.packing import Encoder

ALPHABET = ["a", "B", "é", "Ž", "ß", "²", "½", "7", "0", "'", "s", "'ll", "'S", "ª", "×", "ÿ", "!", "?!", "¿", " ", "  ", "\n", "\t ", "\r\n", "\n\n  ", "_", "-", "ɏ"]


def texts():
    rng = random.Random(12)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    return out + ["", " ", "日本 text", "a" * 100 + " b", "x <|endoftext|> y", "é" * 49, "tab\x0bfeed", "\xa0nb"]


def test_byte_level_words_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    mine = Encoder(path)
    assert mine.memo is not None
    for t in texts():
        assert mine.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_tokenizer_equals_the_library(monkeypatch):
    monkeypatch.setattr(memo, "KNOWN", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), Codec(path)
    library.no_truncation()
    library.no_padding()
    for t in texts():
        ids, decoded = mine.encode_decode(t)
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded == library.decode(want, skip_special_tokens=False), repr(t)
    assert len(mine.memo.known) <= 500


def test_long_words_are_not_remembered():
    held = memo.WordMemo(r"\p{L}+", lambda words: ([1] * len(words), list(range(len(words) + 1))))
    assert held.words("a" * 49) is None and held.words("ab cd") == ["ab", "cd"] and set(held.known) == {"ab", "cd"}


def test_a_larger_memo_encodes_fewer_words():
    words = [f"{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(100)]
    encoded = []
    for known in (60, 400):
        asked = []
        held = memo.WordMemo(r"\p{L}+", lambda w: (asked.extend(w), ([1] * len(w), list(range(len(w) + 1))))[1], known=known)  # noqa: B023
        for w in words * 3:
            held.words(w)
        assert len(held.known) <= known // 2
        encoded.append(len(asked))
    assert encoded == [300, 100]
    assert Encoder(public_tokenizers.path("byte_bpe_50k.json")).memo.most > memo.KNOWN

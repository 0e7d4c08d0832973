"""Suffix dedup against a plain count of all 200-byte strings."""

import random
from collections import Counter

from llm import suffix_dedup
from llm.suffix_dedup import SPAN, remove_repeats


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + SPAN] for r in raw for i in range(len(r) - SPAN + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - SPAN + 1):
            if seen[r[i:i + SPAN]] > 1:
                gone[i:i + SPAN] = b"\1" * SPAN
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the ", "of ", "é", "an ", str(rng.randrange(100)), "\n"])
    long = lambda n: "".join(word() for _ in range(n))
    passages = [long(rng.randrange(40, 400)) for _ in range(6)]
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 300, passages[0], passages[0]]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else long(rng.randrange(5, 80)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            p = rng.choice(passages)
            k = rng.randrange(len(p))
            parts.append(p[:k] + "#" + p[k:])
        if rng.random() < 0.3:
            p = rng.choice(passages)
            parts.append(p[rng.randrange(40):len(p) - rng.randrange(40)])
        texts.append("".join(parts))
    return texts


def test_matches_brute_force(spark):
    for seed, hot in ((1, suffix_dedup.HOT), (2, 3)):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i if i != 5 else None, t, "x", 2) for i, t in enumerate(texts)],
                                     "doc_id long, text string, anchor string, kinds int")
        before, suffix_dedup.HOT = suffix_dedup.HOT, hot
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect()}
        suffix_dedup.HOT = before
        for i, want in enumerate(brute(texts)):
            assert got[i if i != 5 else None] == want, i


def test_chunks_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text), (1, text), (2, text[100:900] + "x" + text[1000:1150])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3000, 3000, 1), (1, 3000, 3000, 1), (2, 951, 800, 1)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    whole = {int(s) for p in suffix_dedup.stretches(text.encode()) for a, n in zip(p[0], p[1]) for s in range(a, a + n)}
    assert whole == set(range(3000 - SPAN + 1))

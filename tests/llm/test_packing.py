"""Packing: every plan and every result is checked for gaps, overlap and lost pieces, and against the lower bound."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm.packing import best_configuration, cuts, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plans_hold_every_piece():
    rng = np.random.default_rng(1)
    for n, scale in ((0, 1), (1, 1), (40, 1), (2000, 1), (2000, 5000)):
        lengths = np.minimum(1024, rng.lognormal(6, 1, n).astype(int) + 1)
        histogram = {int(k): int(v) * scale for k, v in zip(*np.unique(lengths, return_counts=True))}
        planned, got = plan(histogram), {}
        for filling, number in planned:
            assert sum(filling) <= 1024 and number > 0
            for x in filling:
                got[x] = got.get(x, 0) + number
        assert got == histogram
        total = sum(k * v for k, v in histogram.items())
        assert sum(n for _, n in planned) <= 1.01 * total / 1024 + 2


def test_knapsack_matches_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(2, 12), 3)))
        prices = np.array([rng.random() for _ in lengths])
        best = max(a * prices[0] + b * prices[1] + c * prices[2] for a in range(11) for b in range(11) for c in range(11)
                   if a * lengths[0] + b * lengths[1] + c * lengths[2] <= 20)
        assert abs(best_configuration(prices, lengths, 20) @ prices - best) < 1e-9


def test_cuts():
    assert cuts(1024) == [(0, 1024)] and cuts(1025) == [(0, 1), (1, 1024)]
    assert cuts(2048) == [(0, 1024), (1024, 1024)] and cuts(1) == [(0, 1)]


def test_result_is_whole_and_gapless(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "straße", "x1", "\n", "<|endoftext|>"]) for _ in range(rng.randrange(0, 900)))
             for _ in range(120)] + ["", None, "same text", "same text", "a" * 20_000]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2)],
                                 "doc_id long, text string, length int, rank int")
    rows = pack(docs, PATH).collect()
    encode = Tokenizer.from_file(PATH)
    expected = []
    for i, t in [*enumerate(texts), (3, texts[3])]:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids)))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 1024 + 2
    assert pack(docs.limit(0), PATH).count() == 0

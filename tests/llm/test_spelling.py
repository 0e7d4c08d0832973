"""Spelling variants against every pair of words, and words against a plain count."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from llm import spelling


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def plain_groups(words):
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += len(run) >= 5
    return {w: n for w, n in total.items() if n >= 3}


def random_words(rng, n, letters="abcàéÿ×"):
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([5, 5, 6, 6, 7, 8, 63, 64, 65]))) for _ in range(n)}
    for w in list(words)[:n // 2]:
        i = rng.randrange(len(w))
        words.add(w[:i] + rng.choice(letters) + w[i + rng.choice([0, 1]):])
    long = "ab" * 3000
    words |= {long, long[:-1], long + "c", long[:70] + "é" + long[71:], "aaaaaa", "aaaaa", "aaaaaaa"}
    return {w: rng.choice([3, 3, 4, 6, 7, 14, 50, 400]) for w in words if len(w) >= 5}


def got_groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_groups_match_all_pairs(spark):
    words = random_words(random.Random(1), 700)
    frame = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, h string")
    assert got_groups(spelling.variant_groups(frame)) == plain_groups(words)


def test_small_budget_takes_turns_and_slices(spark):
    words = random_words(random.Random(2), 300)
    vocabulary = spelling.hashed_vocabulary(spark.createDataFrame(list(words.items()), "word string, n long"))
    sizes = {r["shard"]: r["count"] for r in vocabulary.groupBy("shard").count().collect()}
    plan = spelling.turns(sizes, 160)
    assert len(plan) > 3 and any(slices > 1 for turn in plan for _, slices, _ in turn.values())
    assert all(sum(b for *_, b in turn.values()) * 8 <= 160 for turn in plan)
    pairs = {(r.word, r.other) for r in spelling.near_words(vocabulary, 160).collect()}
    assert pairs == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_filters_let_few_others_pass(spark):
    words = {"".join(random.Random(i).choices("abcdefghijklmnop", k=9)): 3 for i in range(3000)}
    vocabulary = spelling.hashed_vocabulary(spark.createDataFrame(list(words.items()), "word string, n long"))
    probed = sum(len(h) for _, x in spelling._by_length(list(words)) for _, h, _ in spelling.edits(x))
    found = spelling.candidates(vocabulary).count()
    assert probed > 1_000_000 and found < probed * 0.01


def test_edits_have_the_hashes_of_their_words():
    words = ["aabcÿ", "éabcd"]
    (rows, letters), = spelling._by_length(words)
    made = {int(h) for _, hashes, _ in spelling.edits(letters) for h in hashes}
    for edit in ("abcÿ", "aacÿ", "zabcÿ", "aaècÿ", "éabcz"):
        (_, one), = spelling._by_length([edit])
        assert int(spelling.word_hashes(one)[0]) in made, edit
    assert np.array_equal(rows, [0, 1])


def test_words_match_plain_count(spark):
    rng = random.Random(3)
    pool = ["Éclair", "hello", "HELLO", "world's", "naïveté", "x" * 400, "abcde", "abcdef", "ÀÉÎÕÜ", "日本語テキスト", "a1b2"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 60)))) for i in range(400)]
    rows += [(7, None), (None, "hello hello abcde"), (8, ""), (9, "abcde " * 50_000), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, word string")
    assert {r.word: r.n for r in spelling.corpus_words(docs).collect()} == plain_words(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.corpus_words(docs)).count() == 0


def test_long_chain_of_forms(spark):
    words = {"a" * (5 + i): 3 * 2 ** i for i in range(20)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.root for r in spelling.variant_groups(frame).collect()} == {"a" * 24}

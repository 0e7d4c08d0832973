"""Near-dedup against brute force over full sets, and the cases its docstring names."""

import random
import re

from llm.near_dedup import near_duplicates


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = ({tuple(words[j:j + 5]) for j in range(len(words) - 4)} if len(words) >= 5
                   else {tuple(words)} if words else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return {i: (len(x), label[i], label[i] == i) for i, x in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(60))
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randrange(30, 300))]
        for copy in range(rng.randrange(1, 25)):
            edited = list(text)
            for _ in range(rng.randrange(0, 4 + len(text) // 40)):
                edited[rng.randrange(len(edited))] = word()
            rows.append(" ".join(edited))
    rows += ["One two", "one  TWO", "", None, " \n\t", "solo", "é É", "é é", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    rows = [(5, "p q r s t u v", "x", 1, None), (3, "p q r s t u v", "y", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, key int, registers string")
    assert {tuple(r) for r in near_duplicates(docs).collect()} == {(5, 3, 3, False), (3, 3, 3, True)}


def test_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == [
        (1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True)]

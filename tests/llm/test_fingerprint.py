"""Fingerprints: peeled differences against sets, and the order of documents against a plain walk."""

import random

from llm.fingerprint import CELLS, difference, digests, fingerprints, likeness, read, table, written


def test_differences_are_exact_or_refused():
    rng = random.Random(1)
    for n in (0, 1, 5, 12, 60, 400):
        a, b = {rng.getrandbits(1 << 6) for _ in range(n)}, {rng.getrandbits(1 << 6) for _ in range(n)}
        shared = [rng.getrandbits(1 << 6) for _ in range(200)]
        found, cells = None, CELLS
        while found is None:
            found = difference(table(shared + list(a), cells), table(shared + list(b), cells))
            cells *= 4
        assert found == (a, b)


def test_fingerprint_text_round_trip():
    keys = digests("one\ntwo\n\none\n \n")
    assert len(set(keys)) == 3
    assert read(written(keys)) == (3, table(keys, CELLS))


def plain(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, other) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        like = lambda x, y: 1.0 if not x and not y else 1 - len(set(x) ^ set(y)) / (len(x) + len(y))
        a, b, c = digests(text), digests(edited), digests(other)
        out[i] = (len(text), edited, written(a), written(b), like(a, b), like(a, c))
    return out


def test_matches_plain_walk(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 1009, "\n".join(rng.choice(["é🙂x", "alpha beta", "", "long " * 30, str(rng.random())]) for _ in range(rng.randrange(0, 90))))
            for i in range(500)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, bucket int")
    got = {r[0]: tuple(r)[1:] for r in fingerprints(docs).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4] and abs(got[i][4] - want[i][4]) < 1e-12 and abs(got[i][5] - want[i][5]) < 1e-12


def test_edge_rows(spark):
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (one,) = fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one.edited == "abab" and one.near_next == 1.0
    rows = [(3, None), (3, None), (None, "x\ny"), (2, "q"), (3, "zz")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("2", 1), ("3", 0), ("3", 0), ("3", 2), ("None", 3)]
    assert likeness([], [], written([]), written([])) == 1.0

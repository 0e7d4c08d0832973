"""The factorization machine: held-out accuracy, pairwise terms, and the cases of its docstring."""

import random

import numpy as np

from llm.toxicity import distinct_terms, fit, fit_labelled, sigmoid, toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(25)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["nitwit"] * insult + ["martians"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    return texts, labels


def test_learns_pairs():
    texts, labels = corpus(3000, 1)
    model = fit(distinct_terms([t.encode() for t in texts]), np.array(labels, float))
    score = sigmoid(model.raw(distinct_terms([b"nitwit martians", b"nitwit w1", b"martians w2", b"w3 w4", b""])))
    assert score[0] > 0.8 and score[1:].max() < 0.4


def test_held_out_accuracy_and_edge_rows(spark):
    texts, labels = corpus(3000, 2)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(9000, None, "y"), (9001, "", None), (None, "w1", "z")],
                                 "doc_id long, text string, score string")
    marks = spark.createDataFrame(list(enumerate(labels)) + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = fit_labelled(docs, marks)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity(docs, model).collect()}
    assert len(got) == 3003 and got[9000] == got[9001]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    from zlib import crc32
    held = [i for i in range(3000) if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i][1] == labels[i] for i in held]) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark):
    from zlib import crc32
    texts, labels = corpus(600, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flipped = [1 - y if crc32(str(i).encode()) % 5 == 0 else y for i, y in enumerate(labels)]
    first, second = (fit_labelled(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
                     for y in (labels, flipped))
    assert first.bias == second.bias and (first.weights == second.weights).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = fit_labelled(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity(docs, model).count() == 0

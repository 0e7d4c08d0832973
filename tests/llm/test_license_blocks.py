"""Notices wrapped over lines, and long lines with scattered words."""

from llm.licenses import TEMPLATES, scan


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels.split(","), r.score) for r in scan(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_wrapped_notices(spark):
    texts, wanted = [], []
    for template, label in TEMPLATES:
        words = template.split()
        for i in range(1, len(words)):
            texts.append("Some words before.\n * " + " ".join(words[:i]) + "\n * " + " ".join(words[i:]) + " and more")
            wanted.append(label)
    texts.append("Redistribution and use in source and binary forms, with or without\nmodification, are permitted")
    wanted.append("bsd")
    for text, label, (got, score) in zip(texts, wanted, labels(spark, texts)):
        assert label in got and score == 1.0, text
    assert labels(spark, ["all\n\nrights\n\nreserved", "reserved\nrights\nall"]) == [([""], 0.0)] * 2


def test_long_lines(spark):
    filler = " ".join(f"w{i}" for i in range(20))
    scattered = [f" {filler} ".join(t.split()) for t, _ in TEMPLATES[:1] + TEMPLATES[-1:]]
    scattered[0] = scattered[0].replace("mit license", "mit").replace(" license", "")
    whole = [f"{filler} {filler} {t} {filler}" for t, _ in TEMPLATES]
    got = labels(spark, scattered + whole)
    assert got[:2] == [([""], 0.0)] * 2
    assert all(label in found and score == 1.0 for (_, label), (found, score) in zip(TEMPLATES, got[2:]))

"""License scans against plain loops over all lines and all templates."""

import random
import re

from llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    flat, places, base = words(text), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(flat) - len(p) + 1) if flat[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 1.0 if base else 0.0
    for line in (text or "").split("\n"):
        for template, label in TEMPLATES:
            t = set(template.split())
            share = len(t & set(words(line))) / len(t)
            if share >= CONTAINMENT - 1e-12:
                labels.add(label)
                best = max(best, share)
    return (len(flat), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), best)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [w for t, _ in TEMPLATES for w in t.split()] + ["MIT", "License", "é", "x9", "of", "the"]
    rows = [None, "", "MIT\nlicense", "mit-License, Apache (LICENSE)", "all rights reserved", "General Public License " * 3]
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(TEMPLATES)[0].split() if rng.random() < 0.5 else [rng.choice(pool) for _ in range(rng.randrange(0, 30))]
            line = [w if rng.random() < 0.9 else rng.choice(pool) for w in line]
            lines.append(rng.choice([" ", ", ", "-"]).join(line))
        rows.append("\n".join(lines))
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(rows)], "doc_id long, text string, labels string")
    got = {r.doc_id: tuple(r)[1:8] for r in scan(docs).collect()}
    for i, text in enumerate(rows):
        assert got[i] == brute(text), text
    assert scan(docs.limit(0)).count() == 0

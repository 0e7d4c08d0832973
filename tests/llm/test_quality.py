"""Line and document rules against plain loops, every column."""

import random
import re

from llm.quality import judged

PHRASES = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookies policy",
           "enable javascript", "click here", "subscribe now", "subscribe to", "sign in", "sign up", "log in", "login",
           "licensed under", "released under the"]


def words(text):
    return re.findall(r"[^ \t\n\x0b\x0c\r]+", text)


def fails(line):
    n, symbols = len(words(line)), sum(c in "#*$%&|<>" for c in line)
    return n > 0 and (n < 3 and not re.search("[.!?:;…。！？\"”»)][ \t\n\x0b\x0c\r]*$", line)
                      or line.count("|") >= 2 or symbols >= 2 and 10 * symbols > n
                      or line == line.upper() and line != line.lower() and n >= 3)


def site_line(line):
    """Phrases between characters that are no ASCII letters, digits or underscores, from the left."""
    low, i, covered = line.lower(), 0, 0
    inside = lambda k: 0 <= k < len(low) and (low[k].isascii() and low[k].isalnum() or low[k] == "_")
    while i < len(low):
        found = [p for p in PHRASES if low.startswith(p, i) and not inside(i - 1) and not inside(i + len(p))]
        covered += len(found[0]) if found else 0
        i += len(found[0]) if found else 1
    return covered > 0 and 8 * covered >= len(low)


def brute(given):
    text = given or ""
    every, lines = words(text), text.split("\n")
    worded = [x for x in lines if words(x)]
    windows = [tuple(every[i:i + 5]) for i in range(len(every) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    left = "\n".join(x for x in lines if not fails(x) and not site_line(x))
    chars = len("".join(every))
    base = len(every) < 10 or 100 * len(covered) > 20 * len(every)
    return (None if given is None else left, len(every), chars, sum(c in "#*$%&|<>" for c in text),
            len(worded) - len(set(worded)), len(covered), base, not base and len("".join(words(left))) >= 0.5 * chars)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    pool = ["Click here to sign in.", "See our privacy policy.", "Licensed under terms.", "MENU", "Home | News | Jobs", "",
            "  ", "STOP DOING THAT NOW", "a * b # c", "Short one.", "We design in the open catalog in use.", "Mother bakes cookies daily.",
            "See our privacy policy. " + "word " * 25 + "end.", "See our privacy policy. " + "word " * 20 + "end.", "Blog in, login."]
    rows = [None, "", " \n\n ", "Click here to sign in.\nSee our privacy policy.\nYou can log in or subscribe now.",
            "one two three four five six " * 4]
    for _ in range(150):
        own = lambda: " ".join(rng.choice("abcdefgé") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 25)))
        rows.append("\n".join(rng.choice([rng.choice(pool), own() + "."]) for _ in range(rng.randrange(1, 9))))
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(rows)], "doc_id long, text string, words string")
    got = {r.doc_id: tuple(r)[1:] for r in judged(docs).collect()}
    for i, text in enumerate(rows):
        assert got[i] == brute(text), text
    kept = {i for i, r in got.items() if r[-1]}
    assert 3 not in kept and 0 < len(kept) < len(rows)
    assert judged(docs.limit(0)).count() == 0


def test_phrases_are_whole_words_and_a_share_of_the_line(spark):
    lines = ["We design in the open and keep a catalog in use.", "Mother bakes cookies on every single day.",
             "Please sign in to read on.", "By using this page you accept our cookie policy.",
             "The privacy policy " + "of that old town was argued over " * 9 + "for years."]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert judged(docs).first().text.split("\n") == [lines[0], lines[1], lines[4]]


def test_very_long_text_and_repeated_rows(spark):
    text = "A sentence of nine different words stands here now.\n" + "\n".join(f"Line {i} tells of number {i * i} and of {i * 7} too." for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    rows = judged(docs).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0].n_words == len(words(text)) and rows[0].kept

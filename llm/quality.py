"""Line-first cleaning with document rules, in SQL expressions only: one narrow pass, no shuffle, no Python.

Each line is judged by itself (punctuation, navigation, symbols, shouting, boilerplate) and failing lines go. A document
is rejected if it fails a base rule on its whole text, or if more than ``MOST_LOST`` of its word characters are in
lines that go, whatever rule they fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LOST = 0.5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5

_BLANKS = " \t\n\x0b\x0c\r"
_BLANK = r"[\\x20\\x09-\\x0D]"
_SYMBOLS = "#*$%&|<>"
#: whole words of site furniture and licence notices; a line goes if they make up a ``SITE_SHARE``-th of its characters
_BOILERPLATE = (r"\\b(all rights reserved|terms of (use|service)|privacy policy|cookies? policy|enable javascript|"
                r"click here|subscribe (now|to)|sign (in|up)|log ?in|licensed under|released under the)\\b")
SITE_SHARE = 8


def _failing_line(line: str) -> str:
    """SQL condition on one line; blank lines pass."""
    words = f"size(filter(split({line}, '{_BLANK}+'), w -> w <> ''))"
    symbols = f"(length({line}) - length(translate({line}, '{_SYMBOLS}', '')))"
    return (
        f"({line} RLIKE '[^\\\\x20\\\\x09-\\\\x0D]' AND ("
        f"NOT {line} RLIKE '[.!?:;…。！？\"”»)]{_BLANK}*$' AND {words} < 3"           # punctuation
        f" OR length({line}) - length(replace({line}, '|', '')) >= 2"                # navigation
        f" OR {symbols} >= 2 AND 10 * {symbols} > {words}"                           # symbols
        f" OR {line} = upper({line}) AND {line} <> lower({line}) AND {words} >= 3))")  # shouting


def _boilerplate(line: str) -> str:
    """A line of which phrases of site furniture or of a licence notice are a good part, however long it is."""
    rest = f"length(regexp_replace(lower({line}), '{_BOILERPLATE}', ''))"
    return f"(lower({line}) RLIKE '{_BOILERPLATE}' AND {SITE_SHARE} * (length(lower({line})) - {rest}) >= length(lower({line})))"


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every
    row of ``docs`` (doc_id, text); ``text`` is the cleaned text.

    Base counts are of the whole text before cleaning. Two windows count as equal if their 64-bit hashes are. A
    NULL or empty text has no words: it is rejected and stays NULL or empty. Repeated rows are judged alike, other columns
    are ignored, an empty table gives no rows. Counts are per row, so no document meets another.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("given"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    counted = (
        given.withColumn("words", F.expr(f"filter(split(t, '{_BLANK}+'), w -> w <> '')"))
        .withColumn("lines", F.split("t", "\n", -1))
        .withColumn("worded", F.expr("filter(lines, x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.translate("t", _BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long")))
    at = ", ".join(f"words[i + {j}]" for j in range(WINDOW))
    repeats = (
        counted.withColumn("hashed", F.expr(
            f"IF(n_words < {WINDOW}, array(), transform(sequence(0, CAST(n_words AS INT) - {WINDOW}), i -> struct(xxhash64({at}) AS h, i AS i)))"))
        .withColumn("sorted", F.expr("sort_array(hashed)"))
        .withColumn("twice", F.expr(
            "sort_array(transform(filter(sorted, (x, k) -> (k > 0 AND sorted[k - 1].h = x.h) OR "
            "(k + 1 < size(sorted) AND sorted[k + 1].h = x.h)), x -> x.i))"))
        .withColumn("n_repeat_words", F.expr(
            f"aggregate(twice, struct(0 AS upto, 0L AS n), (a, p) -> struct(p + {WINDOW} AS upto, "
            f"a.n + p + {WINDOW} - greatest(a.upto, p) AS n), a -> a.n)")))
    cleaned = (
        repeats.withColumn("good", F.expr(f"filter(lines, x -> NOT {_failing_line('x')})"))
        .withColumn("text", F.expr(f"IF(given IS NULL, NULL, array_join(filter(good, x -> NOT {_boilerplate('x')}), '\\n'))"))
        .withColumn("left_chars", F.coalesce(F.length(F.translate("text", _BLANKS, "")), F.lit(0)))
        .withColumn("base_failed", F.expr(
            f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words")))
    return cleaned.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr(f"NOT base_failed AND left_chars >= {1 - MOST_LOST}D * word_chars").alias("kept"))

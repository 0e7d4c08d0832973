"""License scans as an exact set-similarity join of text blocks with templates.

Tokens are ordered by their frequency over the whole corpus, rarest first. A block whose tokens contain at least
``CONTAINMENT`` of a template's must hold one of the template's first ``size - needed + 1`` tokens (prefix filter), have
at least ``needed`` tokens (length filter), and miss no more of the template's tokens, in that order, than it may
(positional filter). Phrases are templates that must be contained whole and in order: their prefix is their rarest
word. The filters lose nothing; what passes them is verified.

Blocks are lines of at most ``LINE`` words, and windows a quarter longer than the template in a paragraph, which is a run of lines
with words. So a notice may be wrapped, and a long line is no block as a whole. In a window across lines only
words in the template's order count, which a wrap does not change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.text import ALNUM, byte_texts, id_text, word_hashes

CONTAINMENT = 0.8
#: words up to which a line is a block as a whole
LINE = 32
#: Phrases and labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: notices and the labels that the join adds; a parameter, small enough to travel with each task
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights reserved", "reserved"),
)


def tokens_of(text: str) -> np.ndarray:
    return word_hashes([text.encode()], ALNUM)[0]


@dataclass
class Template:
    tokens: np.ndarray  # distinct, rarest first
    needed: int
    label: str
    words: list[int]  # distinct, as they first stand in it
    window: int


@dataclass
class Phrase:
    words: np.ndarray
    rarest: int  # its place in the phrase
    label: str


def _line_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[np.ndarray]]]]:
    """Per text of a batch, the word hashes of each line."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            split = [t.split(b"\n") for t in byte_texts(part.column("text"))]
            hashes = iter(word_hashes([line for lines in split for line in lines], ALNUM))
            yield part.column("doc_id"), [[next(hashes) for _ in lines] for lines in split]


def frequencies(docs: DataFrame, tokens: np.ndarray) -> dict[int, int]:
    """How often each of the given tokens stands in the whole corpus; one row a token reaches the driver."""
    wanted = np.unique(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for _, texts in _line_words(batches):
            flat = np.concatenate([w for t in texts for w in t] or [wanted[:0]])
            at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
            total += np.bincount(at[wanted[at] == flat], minlength=len(wanted))
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"token": wanted.view(np.int64), "n": total}))

    rows = id_text(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    got = {r.token: r.n for r in rows}
    return {int(t): got.get(int(np.int64(t.view(np.int64))), 0) for t in wanted}


def prepared(often: dict[int, int], phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> tuple[list[Phrase], list[Template]]:
    order = lambda token: (often.get(int(token), 0), int(token))
    made = []
    for text, label in templates:
        tokens = np.array(sorted(set(tokens_of(text).tolist()), key=order), np.uint64)
        made.append(Template(tokens, math.ceil(containment * len(tokens) - 1e-9), label,
                             list(dict.fromkeys(tokens_of(text).tolist())), (5 * len(tokens_of(text)) + 3) // 4))
    return [Phrase(w, min(range(len(w)), key=lambda i: order(w[i])), label)
            for w, label in ((tokens_of(t), label) for t, label in phrases)], made


def contained(block: set[int], template: Template) -> int | None:
    """Number of the template's tokens in the block; None as soon as the threshold is out of reach."""
    tokens = template.tokens.tolist()
    may_miss = len(tokens) - template.needed
    missed = 0
    for token in tokens:
        if token not in block:
            missed += 1
            if missed > may_miss:
                return None
    return len(tokens) - missed


def in_order(window: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(words) + 1)
    for x in window:
        before = 0
        for j, y in enumerate(words, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def windowed(flat: np.ndarray, owner: np.ndarray, begin: int, end: int, at: int, template: Template) -> tuple[int, int] | None:
    """(tokens, line of the first word) of the best window of ``flat[begin:end]``, a paragraph, that holds the word ``at``."""
    wide = template.window
    low = max(begin, at - wide + 1)
    region = flat[low:min(end, at + wide)].tolist()
    tokens = set(template.tokens.tolist())
    if len(tokens.intersection(region)) < template.needed:
        return None
    best = None
    for i in range(max(1, len(region) - wide + 1)):
        window = region[i:i + wide]
        n = len(tokens.intersection(window))
        if n < template.needed or best is not None and n <= best[0]:
            continue
        first, last = int(owner[low + i]), int(owner[low + i + len(window) - 1])
        if first != last:
            n = in_order(window, template.words)
        if n >= template.needed and (best is None or n > best[0]):
            best = n, first
    return best


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for every row of ``docs``
    (doc_id, text). ``blocks`` are the blocks that a template matches: (line in which it begins, label, containment).

    ``score`` is 1 if a phrase stands in the text, else the greatest containment found, 0 without any. Places are
    counted over the whole text, across lines. NULL and empty texts have no words and no labels. Repeated rows are
    scanned alike, other columns ignored, an empty table gives no rows. Two narrow passes: one counts the templates' tokens
    over all texts, one joins.
    """
    often = frequencies(docs, np.concatenate([tokens_of(t) for t, _ in (*phrases, *templates)]))
    whole, made = prepared(often, phrases, templates, containment)
    prefixes: dict[int, list[int]] = {}
    for k, t in enumerate(made):
        for token in t.tokens[:len(t.tokens) - t.needed + 1].tolist():
            prefixes.setdefault(token, []).append(k)
    keys = np.array(sorted(prefixes), np.uint64)

    def one(lines: list[np.ndarray]) -> tuple:
        flat = np.concatenate(lines)
        found: list[int] = []
        base = set()
        for p in whole:
            at = np.flatnonzero(flat == p.words[p.rarest]) - p.rarest
            at = at[(at >= 0) & (at + len(p.words) <= len(flat))]
            for i, word in enumerate(p.words):
                at = at[flat[at + i] == word]
            found += at.tolist()
            if len(at):
                base.add(p.label)
        labels, best, blocks = set(base), 1.0 if base else 0.0, []
        near = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
        hit = np.flatnonzero(keys[near] == flat)
        if len(hit):
            sizes = np.array([len(x) for x in lines])
            owner = np.repeat(np.arange(len(lines)), sizes)
            # a paragraph ends before the first line without words
            begins = np.cumsum(sizes) - sizes
            breaks = np.unique(np.concatenate([[0], begins[sizes == 0], [len(flat)]]))
            shares: dict[tuple[int, int], int] = {}
            for at in hit.tolist():
                line, next_break = int(owner[at]), int(np.searchsorted(breaks, at, side="right"))
                for k in prefixes[int(flat[at])]:
                    if sizes[line] <= LINE and (line, k) not in shares:
                        shares[line, k] = contained(set(lines[line].tolist()), made[k]) or 0
                    got = windowed(flat, owner, int(breaks[next_break - 1]), int(breaks[next_break]), at, made[k])
                    if got is not None:
                        shares[got[1], k] = max(shares.get((got[1], k), 0), got[0])
            for (line, k), n in sorted(shares.items()):
                if n >= made[k].needed:
                    share = n / len(made[k].tokens)
                    blocks.append({"line": line, "label": made[k].label, "containment": share})
                    labels.add(made[k].label)
                    best = max(best, share)
        return (len(flat), len(found), min(found, default=None), max(found, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), best, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), block)
        for doc_ids, texts in _line_words(batches):
            columns = zip(*map(one, texts))
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return id_text(docs).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, blocks array<struct<line:int,label:string,containment:double>>")

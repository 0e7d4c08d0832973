"""Secret scans: three exact patterns, and a linear-chain conditional random field over tokens.

The field tags tokens as secret begin, inside or outside. A token's features are its shape (length, shares and
turns of character classes), the words before it, the separator before it, the shape after it, and two features of
the whole text. It is trained here, on windows around pattern matches of a bounded sample of texts and on windows
without any; Viterbi decodes whole texts. Lines are the chains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.session import cut_lineage
from llm.text import CHUNK, fetch, id_text, mix, prefix_sums, span_hashes, word_spans

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: texts with, and texts without a pattern match that training takes at most (smallest hashes of doc_id)
SAMPLE = 1_000
WINDOW = 24
EPOCHS = 40
PENALTY = 1e-4

#: bytes of tokens: ASCII letters, digits, _ + / - and everything from U+0080
TOKEN = np.zeros(256, bool)
TOKEN[0x30:0x3A] = TOKEN[0x41:0x5B] = TOKEN[0x61:0x7B] = TOKEN[0x80:] = True
TOKEN[[0x5F, 0x2B, 0x2F, 0x2D]] = True
DIGIT, UPPER, LOWER, HEXES = (np.zeros(256, bool) for _ in range(4))
DIGIT[0x30:0x3A] = UPPER[0x41:0x5B] = LOWER[0x61:0x7B] = HEXES[0x30:0x3A] = HEXES[0x61:0x67] = True
CLASS = DIGIT * 1 + UPPER * 2 + LOWER * 3

WORDS = 1 << 11
#: table sizes of the features; the first of each is "none"
SIZES = (13, 7, 7, 8, 2, WORDS, WORDS, 10, 13 * 7, 8, 6, 6)
OFFSETS = np.cumsum((0, *SIZES[:-1]))
TAGS = 3  # outside, begin, inside


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three patterns: leftmost, without overlap within a kind, in code points."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def secret_values(text: str) -> list[tuple[int, int]]:
    """What the patterns hold to be the secret itself."""
    return ([m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
            + [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] + [m.span() for m in HEX.finditer(text)])


@dataclass
class Tokens:
    starts: np.ndarray  # bytes
    ends: np.ndarray
    features: np.ndarray  # tokens x features, indices into one table
    first: np.ndarray  # whether a token begins a line


def tokens(text: bytes) -> Tokens:
    """Tokens of one text with their features, vectorised over its bytes."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(buf, TOKEN)
    n = len(starts)
    if not n:
        return Tokens(starts, ends, np.zeros((0, len(SIZES)), np.int32), np.zeros(0, bool))
    count = lambda flags: (lambda s: s[ends] - s[starts])(np.concatenate([[0], np.cumsum(flags)]))
    kind = CLASS[buf]
    turn = np.zeros(len(buf), bool)
    turn[1:] = (kind[1:] != kind[:-1]) & TOKEN[buf[1:]] & TOKEN[buf[:-1]]
    size = ends - starts
    digits, upper, turns = count(DIGIT[buf]), count(UPPER[buf]), count(turn)
    length = np.minimum(np.searchsorted([1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40], size, side="right"), 12)
    share = lambda x: np.where(x == 0, 0, np.minimum(1 + 5 * x // size, 6))
    many = np.minimum(turns, 7)
    hexed = (count(HEXES[buf]) == size).astype(np.int64)
    low = np.frombuffer(text.lower(), np.uint8)
    words = np.concatenate([span_hashes(*_windowed(low, at, starts, ends)) for at in range(0, n, CHUNK // 4)])
    coded = (mix(words) % np.uint64(WORDS - 1)).astype(np.int64) + 1
    newlines = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    first = np.ones(n, bool)
    first[1:] = newlines[starts[1:]] > newlines[ends[:-1]]
    before = np.where(first, 0, np.roll(coded, 1))
    second = np.where(first | np.roll(first, 1), 0, np.roll(coded, 2))
    mark = np.zeros(256, np.int64)
    for i, byte in enumerate(b" =:\"'.,@", 1):
        mark[byte] = i
    left = np.where(starts > 0, buf[np.maximum(starts - 1, 0)], 0)
    separator = np.where(first, 0, np.where(left == 0, 9, mark[left]))
    # past a quote, the sign before it counts
    quoted = (left == 0x22) | (left == 0x27)
    behind = np.where(starts > 1, buf[np.maximum(starts - 2, 0)], 0)
    behind = np.where((behind == 0x20) & (starts > 2), buf[np.maximum(starts - 3, 0)], behind)
    separator = np.where(quoted & ((behind == 0x3D) | (behind == 0x3A)) & ~first, mark[behind], separator)
    following = np.where(np.roll(first, -1), 0, np.roll(many, -1))
    following[-1] = 0
    text_size = min(int(np.log10(len(buf) + 1)), 5)
    numeric = min(int(20 * DIGIT[buf].mean()), 5)
    table = np.stack([length, share(digits), share(upper), many, hexed, before, second, separator,
                      length * 7 + share(digits), following, np.full(n, text_size), np.full(n, numeric)], axis=1)
    return Tokens(starts, ends, (table + OFFSETS).astype(np.int32), first)


def _windowed(buf: np.ndarray, at: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some, last = starts[at:at + CHUNK // 4], ends[at:at + CHUNK // 4]
    base = some[0]
    return prefix_sums(buf[base:last[-1]]), some - base, last - base


@dataclass
class Field:
    emit: np.ndarray
    move: np.ndarray

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi tags of all tokens. Where "outside" leads by more than three changed moves and turning the next
        token from inside to begin can make up, it is the tag on every best path: chains are cut there, and the
        parts run side by side."""
        n = len(features)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        score = self.emit[features].sum(axis=1)
        lead = score[:, 0] - score[:, 1:].max(axis=1)
        legal = self.move[np.isfinite(self.move)]
        turned = np.zeros(n)
        turned[:-1] = np.maximum(score[1:, 2] - score[1:, 1], 0)
        sure = lead > 3 * (legal.max() - legal.min()) + turned
        unsure = np.flatnonzero(~sure)
        if not len(unsure):
            return tags
        fresh = np.ones(len(unsure), bool)
        fresh[1:] = (np.diff(unsure) > 1) | first[unsure[1:]]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(unsure)))
        order = np.argsort(-size, kind="stable")
        begin, size = unsure[begin[order]], size[order]
        # each part follows a line start or a sure outside token, and so may end
        opens = first[begin]
        now = score[begin] + np.where(opens[:, None], np.where(np.arange(TAGS) == 2, -np.inf, 0.0), self.move[0])
        back = np.zeros((int(size[0]), len(size), TAGS), np.int8)
        ends_out = np.zeros(len(size), bool)
        last = begin + size - 1
        inner = last + 1 < n
        ends_out[inner] = ~first[last[inner] + 1]
        final = now.copy()
        for j in range(1, int(size[0])):
            active = int(np.searchsorted(-size, -j, side="left"))
            ways = now[:active, :, None] + self.move[None]
            back[j, :active] = ways.argmax(axis=1)
            now = ways.max(axis=1) + score[begin[:active] + j]
            final[:active] = now
        final = final + np.where(ends_out[:, None], self.move[:, 0], 0.0)
        tag = final.argmax(axis=1)
        for j in range(int(size[0]) - 1, -1, -1):
            active = int(np.searchsorted(-size, -j, side="left"))
            tags[begin[:active] + j] = tag[:active]
            if j:
                tag[:active] = back[j, np.arange(active), tag[:active]]
        return tags


def train(features: np.ndarray, tags: np.ndarray, real: np.ndarray) -> Field:
    """Maximum likelihood by Adam. ``features`` windows x WINDOW x features, ``tags`` and ``real`` windows x WINDOW;
    padding (real is False) stands at the end of a window. Deterministic."""
    start = np.where(np.arange(TAGS) == 2, -np.inf, 0.0)
    legal = np.ones((TAGS, TAGS), bool)
    legal[0, 2] = False
    emit, move = np.zeros((OFFSETS[-1] + SIZES[-1], TAGS)), np.zeros((TAGS, TAGS))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    gold_emit = np.zeros_like(emit)
    np.add.at(gold_emit, (features[real], tags[real][:, None]), 1.0)
    pairs = real[:, 1:] & real[:, :-1]
    gold_move = np.zeros_like(move)
    np.add.at(gold_move, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1.0)
    flat = features[real]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    with np.errstate(divide="ignore"):
        for step in range(1, EPOCHS + 1):
            steps = np.where(legal, move, -np.inf)
            score = emit[features].sum(axis=2)
            ahead, behind = np.empty_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0] + start
            for j in range(1, WINDOW):
                nxt = log_sum(ahead[:, j - 1, :, None] + steps, 1) + score[:, j]
                ahead[:, j] = np.where(real[:, j, None], nxt, ahead[:, j - 1])
            for j in range(WINDOW - 2, -1, -1):
                nxt = log_sum(steps[None] + (score[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
                behind[:, j] = np.where(real[:, j + 1, None], nxt, 0.0)
            total = log_sum(ahead[:, -1], 1)
            share = np.exp(ahead + behind - total[:, None, None])
            joint = np.exp(ahead[:, :-1, :, None] + steps + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
            expected = np.zeros_like(emit)
            for tag in range(TAGS):
                weight = np.repeat(share[real][:, tag], features.shape[2])
                expected[:, tag] = np.bincount(flat.ravel(), weight, len(emit))
            grads = (gold_emit - expected) / len(features) - PENALTY * emit, \
                    (gold_move - joint[pairs].sum(axis=0)) / len(features) - PENALTY * move
            for k, (value, grad) in enumerate(zip((emit, move), grads)):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value += 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(emit, np.where(legal, move, -np.inf))


def code_points(text: bytes) -> np.ndarray | None:
    """Code point number of each byte offset; None if they are the same."""
    buf = np.frombuffer(text, np.uint8)
    head = (buf & 0xC0) != 0x80
    return None if head.all() else np.concatenate([[0], np.cumsum(head)])


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows of a text: around each known secret, or one from its middle if there is none."""
    raw = text.encode()
    found = tokens(raw)
    n = len(found.starts)
    at = code_points(raw)
    starts, ends = (found.starts, found.ends) if at is None else (at[found.starts], at[found.ends])
    tags = np.zeros(n, np.int64)
    marks = []
    for begin, end in sorted(secret_values(text)):
        inside = np.flatnonzero((starts >= begin) & (ends <= end))
        if len(inside) and not tags[inside].any():
            tags[inside], tags[inside[0]] = 2, 1
            marks.append(int(inside[0]))
    marks = marks or [n // 2]
    features = np.zeros((len(marks), WINDOW, len(SIZES)), np.int32)
    gold, real = np.zeros((len(marks), WINDOW), np.int64), np.zeros((len(marks), WINDOW), bool)
    for i, mark in enumerate(marks):
        low = max(0, mark - WINDOW // 2)
        while low < mark and found.first[low + 1:mark + 1].any():
            low += 1
        while low < n and tags[low] == 2:
            low += 1
        stop = low + 1
        while stop < min(n, low + WINDOW) and not found.first[stop]:
            stop += 1
        size = min(stop, n) - low
        if size > 0:
            features[i, :size], gold[i, :size], real[i, :size] = found.features[low:stop], tags[low:stop], True
    keep = real.any(axis=1)
    return features[keep], gold[keep], real[keep]


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [windows(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([p[i].tobytes() for p in parts], pa.binary()) for i in range(3))],
            ["doc_id", "features", "tags", "real"])


def fit_field(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Train on at most ``sample`` texts with and ``sample`` without a pattern match; None if no text has one. What
    reaches the driver is a few windows a text."""
    hit = F.expr(r"text RLIKE 'AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]'")
    # read twice, matched once
    ranked = cut_lineage(id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", hit.alias("hit")))
    chosen = [r.doc_id for flag in (True, False) for r in
              ranked.where(F.col("hit") == flag).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": np.unique(np.array(chosen, np.int64))}), "doc_id long")
    rows = sorted((r.doc_id, bytes(r.features), bytes(r.tags), bytes(r.real)) for r in fetch(docs, ids).mapInArrow(
        _window_rows, "doc_id long, features binary, tags binary, real binary").toLocalIterator())
    tags = np.frombuffer(b"".join(r[2] for r in rows), np.int64).reshape(-1, WINDOW)
    if not tags.any():
        return None
    features = np.frombuffer(b"".join(r[1] for r in rows), np.int32).reshape(-1, WINDOW, len(SIZES))
    return train(features, tags, np.frombuffer(b"".join(r[3] for r in rows), bool).reshape(-1, WINDOW))


def field_spans(field: Field, text: bytes) -> list[tuple[int, int]]:
    """Code point spans of the tagged secrets of one text."""
    found = tokens(text)
    tags = field.decode(found.features, found.first)
    begins = np.flatnonzero(tags == 1)
    if not len(begins):
        return []
    at = code_points(text)
    out = []
    for b in begins:
        e = b
        while e + 1 < len(tags) and tags[e + 1] == 2:
            e += 1
        out.append((int(found.starts[b]), int(found.ends[e])))
    return out if at is None else [(int(at[b]), int(at[e])) for b, e in out]


def all_spans(field: Field | None, text: str) -> list[tuple[int, int, int]]:
    """Base spans, and those of the field that no base span covers, by start and kind."""
    base = base_spans(text)
    extra = field_spans(field, text.encode()) if field else []
    extra = [(b, e, 3) for b, e in extra if not any(x <= b and e <= y for x, y, _ in base)]
    return sorted(base + extra, key=lambda x: (x[0], x[2]))


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, text, spans array<struct<start, end, kind>>) for every row of ``docs`` (doc_id, text): code points,
    end exclusive, kind an index into KINDS; one narrow pass. NULL and empty texts have no spans; repeated
    rows are scanned alike; other columns are ignored. ``field`` None: the patterns alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
        for batch in batches:
            spans = [[{"start": b, "end": e, "kind": k} for b, e, k in all_spans(field, t or "")]
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id long, text string, spans array<struct<start:long,end:long,kind:int>>")


def redact(docs: DataFrame, field: Field | None, mark: str = "[secret]") -> DataFrame:
    """``docs`` (doc_id, text, any columns) with every span in ``text`` replaced by ``mark``; overlapping
    spans are one. Rows without spans are unchanged."""

    def clean(text: str | None) -> str | None:
        merged: list[list[int]] = []
        for b, e, _ in all_spans(field, text or ""):
            if merged and b < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([b, e])
        for b, e in reversed(merged):
            text = text[:b] + mark + text[e:]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, "text", texts)

    return docs.mapInArrow(run, docs.schema)

"""BPE encoding by tree concatenation, and decoding.

A long text is cut into halves, down to leaves, wherever the cuts fall, words included. Leaves are encoded
independently; then neighbours are joined: a window around the join is encoded anew and grows until it agrees with
what stands on both of its sides. Agreement is exact, in one of two ways:

* Word starts. Words are matched from left to right without looking back, so once the window and the right part
  start a word at the same place, all that follows is the same.
* Within one long unsplit word: the window's first and last tokens equal those of the parts. Then all neighbouring
  tokens are neighbours in some encoding, which makes the sequence the encoding of the whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.memo import WordMemo

LEAF = 4_096
#: longer texts spread their leaves over tasks
SPREAD = 32_768
WINDOW = 8
_COMPOSED = re.compile("[\t\n\r -~\u00c0-\u012f\u0131-\u024f]*")


@dataclass
class Part:
    """Tokens of a stretch of a text, with their places in it; ``heads`` marks first tokens of words."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    heads: np.ndarray
    begin: int
    end: int


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(names) + ")") if names else None
        self.normalizer = self.whole.normalizer
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        self.blank_and_lower = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and (
            steps[1]["pattern"], steps[1]["content"]) == ({"Regex": "\\s+"}, " ")
        plain = spec | {"added_tokens": [], "normalizer": None, "truncation": None, "padding": None, "post_processor": None}
        self.words = Tokenizer.from_str(json.dumps(plain))
        # the inside of a word: no word end, no word split
        model = spec["model"] | {"end_of_word_suffix": None}
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        blanks = {"type": "CharDelimiterSplit", "delimiter": " "}
        self.single = Tokenizer.from_str(json.dumps(
            plain | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [blanks, bytes_only]}}))
        self.memo = None
        # without a decoder, decoding puts blanks between tokens
        tokens = {i: t for t, i in (spec["model"]["vocab"] | self.special).items()}
        self.spell = spell = None if spec["decoder"] else lambda ids: " ".join(map(tokens.__getitem__, ids))
        if spec["pre_tokenizer"]["type"] == "Sequence":
            self.memo = WordMemo(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], self._encoded, spell)
        self.inside = Tokenizer.from_str(json.dumps(plain | {"model": model, "pre_tokenizer": bytes_only}))

    def segments(self, text: str) -> list[str | int]:
        """Normalised stretches between special tokens, and those tokens' ids."""
        parts = self.splitter.split(text) if self.splitter else [text]
        return [self.special[p] if i % 2 else self.normalised(p) for i, p in enumerate(parts) if p]

    def normalised(self, text: str) -> str:
        if self.blank_and_lower and _COMPOSED.fullmatch(text):  # NFC changes none of these characters
            for blank in "\t\n\r":
                text = text.replace(blank, " ")
            while "  " in text:
                text = text.replace("  ", " ")
            return text.lower()
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _encoded(self, words: list[str]) -> tuple[list[int], list[int]]:
        encoded = self.single.encode(" ".join(words), add_special_tokens=False)
        return encoded.ids, np.searchsorted(np.array(encoded.word_ids), np.arange(len(words) + 1)).tolist()

    def known_words(self, text: str) -> list[str] | None:
        """Words of a normalised stretch whose ids the memo has; None where the library splits."""
        return self.memo.words(text) if self.memo else None

    def ids(self, text: str) -> np.ndarray:
        words = self.known_words(text)
        if words is None:
            return np.array(self.words.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.memo.ids(words)

    def part(self, text: str, begin: int) -> Part:
        words = self.known_words(text)
        if words is not None:
            # normalised white space is single blanks, and every other character belongs to a word
            letters = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) != 32)
            pieces = self.memo.pieces(words)
            upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            first = letters[np.concatenate([[0], upto[:-1]]).astype(np.int64)] if len(upto) else upto
            heads = np.zeros(int(sizes.sum()), bool)
            heads[np.cumsum(sizes) - sizes] = True
            # inner tokens stand at their word's places: joins inside words only concern long ones
            return Part(np.frombuffer(b"".join(pieces), np.uint32), np.repeat(first, sizes) + begin,
                        np.repeat(letters[upto - 1] + 1 if len(upto) else upto, sizes) + begin, heads, begin, begin + len(text))
        encoded = self.words.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in encoded.word_ids], np.int64)
        places = np.array(encoded.offsets, np.int64).reshape(-1, 2) + begin
        heads = np.ones(len(words), bool)
        heads[1:] = words[1:] != words[:-1]
        return Part(np.array(encoded.ids, np.uint32), places[:, 0], places[:, 1], heads, begin, begin + len(text))

    def _unsplit(self, text: str, at: int) -> bool:
        return len(self.words.pre_tokenizer.pre_tokenize_str(text[at - 1:at + 1])) == 1 and not text[at - 1:at + 1].isspace()

    def join(self, text: str, a: Part, b: Part) -> Part:
        reach = WINDOW
        while True:
            heads_a, heads_b = np.flatnonzero(a.heads[:max(len(a.ids) - reach, 0)]), np.flatnonzero(b.heads[reach:])
            i, j = (int(heads_a[-1]) if len(heads_a) else 0), (int(heads_b[0]) + reach if len(heads_b) else len(b.ids))
            far = len(a.ids) - i > 8 * reach and j > 8 * reach
            if far and self._unsplit(text, a.end):
                found = self._join_inside(text, a, b, reach)
                if found is not None:
                    return found
            else:
                left = a.starts[i] if i else a.begin
                right = b.ends[min(j + WINDOW, len(b.ids)) - 1] if j < len(b.ids) else b.end
                window = self.part(text[left:right], int(left))
                if j == len(b.ids):
                    return self._spliced(a, i, window, len(window.ids), b, j)
                same = np.flatnonzero(window.heads & (window.starts == b.starts[j]))
                if len(same) and (right - b.starts[j] >= 4 or right == len(text)):
                    return self._spliced(a, i, window, int(same[0]), b, j)
            reach *= 2

    def _join_inside(self, text: str, a: Part, b: Part, reach: int) -> Part | None:
        clean_a = np.flatnonzero(a.starts[1:len(a.ids) - reach] == a.ends[:len(a.ids) - reach - 1]) + 1
        clean_b = np.flatnonzero(b.starts[reach:] == b.ends[reach - 1:-1]) + reach
        if not len(clean_a) or not len(clean_b):
            return None
        i, j = int(clean_a[-1]), int(clean_b[0])
        if a.heads[i:].any() or b.heads[1:j + 1].any():
            return None
        left = int(a.starts[i])
        encoded = self.inside.encode(text[left:int(b.starts[j])], add_special_tokens=False)
        ids, places = np.array(encoded.ids, np.uint32), np.array(encoded.offsets, np.int64).reshape(-1, 2) + left
        if ids[0] != a.ids[i] or places[0, 1] != a.ends[i] or ids[-1] != b.ids[j - 1] or places[-1, 0] != b.starts[j - 1]:
            return None
        window = Part(ids, places[:, 0], places[:, 1], np.zeros(len(ids), bool), left, int(b.starts[j]))
        return self._spliced(a, i, window, len(ids), b, j)

    @staticmethod
    def _spliced(a: Part, i: int, window: Part, q: int, b: Part, j: int) -> Part:
        of = lambda name: np.concatenate([getattr(a, name)[:i], getattr(window, name)[:q], getattr(b, name)[j:]])
        return Part(of("ids"), of("starts"), of("ends"), of("heads"), a.begin, b.end)

    def joined(self, text: str, parts: list[Part]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(text, *parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        out = []
        for segment in self.segments(text):
            if isinstance(segment, int):
                out.append(np.array([segment], np.uint32))
            elif len(segment) <= leaf:  # one leaf, nothing to join
                out.append(self.ids(segment))
            else:
                out.append(self.joined(segment, [self.part(segment[x:y], x) for x, y in leaves(len(segment), leaf)]))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_decode(self, text: str) -> tuple[np.ndarray, str]:
        """A stretch of one leaf is decoded from its words."""
        segments = self.segments(text)
        if len(segments) == 1 and isinstance(segments[0], str) and len(segments[0]) <= LEAF:
            words = self.known_words(segments[0])
            if words is not None and self.memo.spell:
                return self.memo.ids(words), " ".join(map(self.memo.spelled.__getitem__, words))
        ids = self.encode(text)
        return ids, self.decode(ids)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.tolist()
        return self.spell(ids) if self.spell else self.whole.decode(ids, skip_special_tokens=False)


def leaves(n: int, leaf: int) -> list[tuple[int, int]]:
    """Repeated halving of [0, n) down to at most ``leaf``; a power of two of stretches."""
    count = 1
    while -(-n // count) > leaf:
        count *= 2
    cuts = [n * k // count for k in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Loaded once a Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


OUTPUT = "doc_id long, ids binary, n_tokens long, decoded string"


def _rows(doc_ids: pa.Array, coded: list[tuple[np.ndarray, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array([i.astype("<u4").tobytes() for i, _ in coded], pa.binary()), pa.array([len(i) for i, _ in coded], pa.int64()),
         pa.array([t for _, t in coded], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers, n_tokens, decoded) for every row of ``docs`` (doc_id, text).

    NULL and empty texts have no ids and decode to the empty text. Repeated rows are encoded each; other columns are
    ignored; an empty table gives no rows. A text of up to SPREAD characters is halved and joined within its task;
    a longer one sends its leaves to other tasks first and is joined again by row number.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield _rows(part.column("doc_id"), [coder.encode_decode(t) for t in part.column("text").to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                pieces = [(s, k, "" if isinstance(x, int) else x[b:e], x if isinstance(x, int) else -1)
                          for s, x in enumerate(coder.segments(text))
                          for k, (b, e) in enumerate([(0, 0)] if isinstance(x, int) else leaves(len(x), LEAF))]
                columns = list(zip(*pieces))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(pieces)), pa.array([doc_id] * len(pieces), pa.int64()), pa.array(columns[0], pa.int32()),
                     pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                    ["row", "doc_id", "segment", "leaf", "piece", "special"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            parts = [coder.part(t, 0) for t in batch.column("piece").to_pylist()]
            made = [pa.array([getattr(p, c).tobytes() for p in parts], pa.binary()) for c in ("ids", "starts", "ends", "heads")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "ids", "starts", "ends", "heads"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        coder, out = codec(path), []
        frame = frame.sort_values(["segment", "leaf"])
        for _, rows in frame.groupby("segment", sort=True):
            if rows["special"].iloc[0] >= 0:
                out.append(np.array([rows["special"].iloc[0]], np.uint32))
                continue
            text, at, parts = "".join(rows["piece"]), 0, []
            for r in rows.itertuples():
                parts.append(Part(np.frombuffer(r.ids, np.uint32), np.frombuffer(r.starts, np.int64) + at,
                                  np.frombuffer(r.ends, np.int64) + at, np.frombuffer(r.heads, bool), at, at + len(r.piece)))
                at += len(r.piece)
            out.append(coder.joined(text, parts))
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1].array, "ids": [ids.astype("<u4").tobytes()],
                             "n_tokens": [len(ids)], "decoded": [coder.decode(ids)]})

    is_long = F.length("text") > SPREAD
    spread = (given.where(is_long).withColumn("row", F.monotonically_increasing_id())
              .mapInArrow(cut, "row long, doc_id long, segment int, leaf int, piece string, special long")
              .repartition("row", "segment", "leaf")
              .mapInArrow(encode, "row long, doc_id long, segment int, leaf int, piece string, special long, "
                                  "ids binary, starts binary, ends binary, heads binary")
              .groupBy("row").applyInPandas(join, OUTPUT))
    return given.where(~is_long).mapInArrow(short, OUTPUT).union(spread)



"""Best-fit packing of tokenised documents into fixed-length sequences.

The lengths' histogram (at most one row a length) defines a configuration linear program: a configuration is a
multiset of lengths that fits a sequence, its variable the number of sequences filled that way. It is solved by
multiplicative weights, whose pricing step is a knapsack dynamic program. Rounded down, the solution fixes most
sequences; what it leaves over goes best-fit decreasing, a run of equal lengths at a time. Driver work depends on the number
of lengths and not on the number of documents: pieces find their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from faretrace.session import cut_lineage
from llm.memo import WordMemo
from llm.text import id_text

CAPACITY = 1024
END = 2
STEP = 0.25
ROUNDS = 1_500
#: sequences of a configuration are fixed only if at most this many tokens stay free in them
WASTE = 1

#: words that a task remembers, about 200 bytes each; encoding a word costs far more than finding it
REMEMBERED = 1_200_000

#: the words of a byte-level pre-tokenizer with its own pattern
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """A byte-level tokenizer, truncation and padding off, with a memo of words; texts with an added token, unsettled characters
    or long words go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        split = spec["pre_tokenizer"] or {}
        simple = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.memo = WordMemo(BYTE_LEVEL_WORDS, self._encoded, known=REMEMBERED) if simple else None
        # words of settled characters, one behind another: none has the character that parts them
        self.single = Tokenizer.from_str(self.whole.to_str())
        if simple:
            self.single.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split("\x00", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t["content"] for t in spec["added_tokens"]]

    def _encoded(self, words: list[str]) -> tuple[list[int], list[int]]:
        encoded = self.single.encode("\x00".join(words), add_special_tokens=False)
        return encoded.ids, np.searchsorted(np.array(encoded.word_ids), np.arange(len(words) + 1)).tolist()

    def ids(self, text: str) -> np.ndarray:
        words = None
        if self.memo and not any(t in text for t in self.added):
            words = self.memo.words(text)
        if words is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.memo.ids(words)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Loaded once a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut to at most CAPACITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, rows = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode.ids(text or ""), np.uint32(END)).astype("<u4")
                    for k, (start, length) in enumerate(cuts(len(ids))):
                        owner.append(i)
                        rows.append((k, start, length, zlib.crc32(ids[start:start + length].tobytes())))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), pa.array(columns[0], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in columns[1:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack: how often each length is taken so that the prices' sum is greatest within the capacity."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = prices
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        ways = worth[1:room + 1] + best[room - 1::-1]
        at = int(ways.argmax())
        if ways[at] > best[room - 1]:
            best[room], choice[room] = ways[at], at + 1
        else:
            best[room] = best[room - 1]
    taken, room = np.zeros(capacity + 1, np.int64), capacity
    while room:
        if choice[room]:
            taken[choice[room]] += 1
            room -= choice[room]
        else:
            room -= 1
    return taken[lengths]


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Configurations (how often each length) with their share of sequences; covers each length about once."""
    weights, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    solution: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        if covered.min() >= 1:
            break
        weights[covered >= 1] = 0.0
        taken = best_configuration(weights / weights.max() * lengths / capacity, lengths, capacity)
        taken = np.minimum(taken, counts)
        used = taken / counts
        step = STEP / used.max()
        step = min(step, ((1 - covered)[taken > 0] / used[taken > 0]).min())
        solution[tuple(taken)] = solution.get(tuple(taken), 0.0) + step
        covered += step * used
        covered[covered > 1 - 1e-9] = 1.0
        weights *= np.exp(-STEP * used / used.max())
    return solution


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Every piece of the histogram (length to count) placed: (lengths of a sequence, number of such sequences)."""
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(x for x in histogram if x < capacity), np.int64)
    left = np.array([histogram[x] for x in lengths], np.int64)
    out: list[tuple[tuple[int, ...], int]] = [((capacity,), full)] if full else []
    if not len(lengths):
        return out
    bins: dict[tuple[int, ...], int] = {}
    for taken, share in sorted(fractional(lengths, left, capacity).items()):
        taken = np.array(taken)
        number = min(int(share + 1e-9), int((left[taken > 0] // taken[taken > 0]).min()))
        if number > 0 and capacity - int(taken @ lengths) <= WASTE:
            left = left - number * taken
            bins[tuple(int(x) for x in np.repeat(lengths, taken)[::-1])] = number
    # best-fit decreasing for the rest; bins of one filling are handled together
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    for filling, number in bins.items():
        by_room.setdefault(capacity - sum(filling), {})[filling] = number
    for length, count in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        for room in sorted(r for r in by_room if r >= length):
            fits = room // length
            for filling in sorted(by_room[room]):
                number = by_room[room][filling]
                for each in range(fits, 0, -1):
                    some = min(number, count // each)
                    if some <= 0:
                        continue
                    number -= some
                    count -= some * each
                    new = filling + (length,) * each
                    slot = by_room.setdefault(room - each * length, {})
                    slot[new] = slot.get(new, 0) + some
                by_room[room][filling] = number
                if not number:
                    del by_room[room][filling]
                if not count:
                    break
            if not count:
                break
        fits = capacity // length
        for each, some in ((fits, count // fits), (count % fits, 1)):
            if each and some:
                slot = by_room.setdefault(capacity - each * length, {})
                slot[(length,) * each] = slot.get((length,) * each, 0) + some
    return out + [(f, n) for room in sorted(by_room) for f, n in sorted(by_room[room].items()) if n]


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, arrays (first rank, first sequence, offset): ranks count on within a run of like sequences."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for filling, number in planned:
        offset = 0
        for length in filling:
            at = rank.get(length, 0)
            rows.setdefault(length, []).append((at, sequence, offset))
            rank[length] = at + number
            offset += length
        sequence += number
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in rows.items()}


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with ``rank``, 0, 1, ... among rows of equal length. A length, however frequent, is ranked in
    buckets; a bucket's first rank is a running sum over one count a bucket."""
    buckets = max(16, 2 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = cut.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece), {buckets})"))
    counts = held.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    firsts = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (held.withColumn("nth", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"])
            .withColumn("rank", F.col("before") + F.col("nth")).drop("bucket", "nth", "before"))


def pack(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs`` (doc_id, text).

    A NULL or empty text is one piece, the end id alone. Repeated rows and rows without doc_id are packed each. Other
    columns are ignored; an empty table gives no rows.
    """
    cut = cut_lineage(pieces(docs, path))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(histogram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            borders = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, borders) if len(order) else ():
                first, begin, at = table[int(lengths[rows[0]])]
                run_of = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = begin[run_of] + ranks[rows] - first[run_of], at[run_of]
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)],
                                             [*keep.schema.names, "sequence_id", "offset"])

    return ranked(cut).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Spelling variants: words one edit apart, the more frequent form of each, and the form at the end of that chain.

The vocabulary is split by length into shards, each with a blocked Bloom filter: a word sets four bits of one 64-bit block.
Every edit that may lead to another word is generated as a hash and probed against the broadcast filters; only positives
are shuffled to the vocabulary, where a join and an edit distance remove the false ones. A pair of equal length is generated
from the word that is smaller at the place where they differ, any other pair from the longer word by a deletion.

Filters of one turn hold at most ``FILTER_BYTES``; a larger vocabulary takes more turns, over lengths and then over slices of
the hashes of one length, so that neither the broadcast nor its rate of false positives grows.

Words are runs of Latin-1 letters, one byte a code point. NULL texts have no words, a NULL doc_id is an empty one. Repeated
rows count again. Very long words are shards of ``LONGEST`` code points or more; texts are read in pieces of matches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.session import cut_lineage
from llm.text import id_text, mix

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: one in so many distinct words of a text has a letter deleted
DAMAGED = 97
#: distinct words a task counts before it passes them on
HELD = 300_000
#: words of this length or more share a shard
LONGEST = 64
#: bits of a filter a word, and bytes of all filters broadcast in a turn
BITS, FILTER_BYTES = 24, 32 << 20
#: edits probed at a time
PROBES = 1 << 20

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_RANDOM = np.random.default_rng(20251103)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xA0761D6478BD642F
_BASE_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


# ---- words ---------------------------------------------------------------


def text_words(doc_id: int | None, text: str, damaged: int = DAMAGED, least: int = LEAST_LENGTH) -> Counter:
    """Counts of a text's words of at least ``least`` code points, A-Z lower-cased. Where ``damaged`` divides the checksum of
    ``doc_id:word``, the word loses the code point at that checksum modulo its length; 0 damages nothing."""
    found = (m.group() for m in RUN.finditer(text))
    runs: Counter = Counter()
    while piece := list(islice(found, 100_000)):
        runs.update(w for w in piece if len(w) >= least)
    words: Counter = Counter()
    for run, n in runs.items():
        words[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    if not damaged:
        return words
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word in list(words):
        check = zlib.crc32(word.encode(), head)
        if check % damaged == 0:
            n, at = words.pop(word), check % len(word)
            words_at = word[:at] + word[at + 1:]
            if len(words_at) >= least:
                words["\0" + words_at] += n  # not itself damaged again
    return words


def corpus_words(docs: DataFrame, damaged: int = DAMAGED, least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) with n >= ``times``; tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in text_words(doc_id, text.as_py() or "", damaged, least).items():
                    held[word.lstrip("\0")] += n
                if len(held) >= HELD:
                    yield batch_of()
                    held.clear()
        if held:
            yield batch_of()

    return (id_text(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= times))


# ---- hashes of words and of their edits ----------------------------------


def _powers(length: int) -> np.ndarray:
    out = np.full(length + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums ^ np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def word_hashes(letters: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, given as rows of bytes."""
    length = letters.shape[1]
    return _finished((_VALUES[letters] * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), length)


def edits(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash of the edit, row of its word): replacements by a larger letter, and deletions."""
    n, length = letters.shape
    powers = _powers(length)
    terms = _VALUES[letters] * powers[:length]
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    total = before[:, -1:]
    width = max(1, PROBES // (n * len(LETTERS)))
    for at in range(0, length, width):
        old = letters[:, at:at + width, None]
        changed = (_VALUES[LETTERS] * powers[at:min(at + width, length), None])[None] - terms[:, at:at + width, None] + total[:, :, None]
        larger = LETTERS[None, None, :] > old
        rows = np.nonzero(larger)[0]
        yield length, _finished(changed[larger], length), rows
    # of equal neighbours one deletion is enough
    fresh = np.ones((n, length), bool)
    fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
    shorter = before[:, :-1] + (total - before[:, 1:]) * _BASE_INVERSE
    yield length - 1, _finished(shorter[fresh], length - 1), np.nonzero(fresh)[0]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bytes of the words there), one length and a bounded number of bytes at a time."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    begin = 0
    while begin < len(order):
        length = int(lengths[order[begin]])
        most = max(1, PROBES // (length * len(LETTERS)))
        end = min(begin + most, int(np.searchsorted(lengths[order], length, "right")))
        rows = order[begin:end]
        data = "".join(words[i] for i in rows).encode("latin-1")
        yield rows, np.frombuffer(data, np.uint8).reshape(len(rows), length)
        begin = end


# ---- filters -------------------------------------------------------------


def _shard(length: int) -> int:
    return min(length, LONGEST)


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _mask(hashes: np.ndarray) -> np.ndarray:
    one, six = np.uint64(1), np.uint64(63)
    return (one << (hashes & six) | one << (hashes >> np.uint64(6) & six)
            | one << (hashes >> np.uint64(12) & six) | one << (hashes >> np.uint64(18) & six))


def _slice(hashes: np.ndarray, slices: int) -> np.ndarray:
    return (hashes >> np.uint64(24) & np.uint64(0xFF)) * np.uint64(slices) >> np.uint64(8)


def turns(sizes: dict[int, int], budget: int = FILTER_BYTES) -> list[dict[int, tuple[int, int, int]]]:
    """Shards (with their word counts) to turns of {shard: (slice, slices, blocks)} of at most ``budget`` bytes each. A shard
    takes at most 256 slices; a vocabulary beyond that fills its filters more."""
    out: list[dict[int, tuple[int, int, int]]] = []
    used = budget
    for shard, n in sorted(sizes.items()):
        blocks = max(1, -(-n * BITS // 64))
        slices = min(256, max(1, -(-blocks * 8 // budget)))
        blocks = min(-(-blocks // slices), max(1, budget // 8))
        for i in range(slices):
            if used + blocks * 8 > budget:
                out.append({})
                used = 0
            out[-1][shard] = i, slices, blocks
            used += blocks * 8
    return out


def _filters(vocabulary: DataFrame, turn: dict[int, tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """Filters of a turn, put together block by block where the words are; the driver gets at most ``FILTER_BYTES`` of
    blocks."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            hashes = batch.column("h").to_numpy().view(np.uint64)
            for shard, (piece, slices, blocks) in turn.items():
                h = hashes[shards == shard]
                h = h[_slice(h, slices) == piece]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(h), shard, np.int32)),
                                                  "block": pa.array(_block(h, blocks).astype(np.int64)),
                                                  "mask": pa.array(_mask(h).view(np.int64))})

    set_bits = (vocabulary.where(F.col("shard").isin(list(turn))).select("shard", "h")
                .mapInArrow(bits, "shard int, block long, mask long")
                .groupBy("shard", "block").agg(F.bit_or("mask").alias("mask")).toArrow())
    shards, blocks, masks = (set_bits.column(c).to_numpy() for c in ("shard", "block", "mask"))
    out = {}
    for shard, (_, _, n) in turn.items():
        out[shard] = np.zeros(n, np.uint64)
        mine = shards == shard
        out[shard][blocks[mine]] = masks[mine].view(np.uint64)
    return out


def candidates(vocabulary: DataFrame, budget: int = FILTER_BYTES) -> DataFrame:
    """(edit, source): hashes of edits that a filter holds, with the hashes of their words."""
    sizes = {r["shard"]: r["count"] for r in vocabulary.groupBy("shard").count().collect()}
    spark = vocabulary.sparkSession
    found = spark.createDataFrame([], "edit long, source long")
    for turn in turns(sizes, budget):
        filters = spark.sparkContext.broadcast(_filters(vocabulary, turn))

        def probe(batches: Iterator[pa.RecordBatch], turn=turn, filters=filters) -> Iterator[pa.RecordBatch]:
            held = filters.value
            for batch in batches:
                source = batch.column("h").to_numpy().view(np.uint64)
                for rows, letters in _by_length(batch.column("word").to_pylist()):
                    for length, hashes, at in edits(letters):
                        shard = _shard(length)
                        if shard not in turn:
                            continue
                        piece, slices, blocks = turn[shard]
                        mask = _mask(hashes)
                        hit = (held[shard][_block(hashes, blocks)] & mask) == mask
                        if slices > 1:
                            hit &= _slice(hashes, slices) == piece
                        yield pa.RecordBatch.from_pydict({"edit": pa.array(hashes[hit].view(np.int64)),
                                                          "source": pa.array(source[rows[at[hit]]].view(np.int64))})

        # a word meets its own shard by replacements and the shard below by deletions
        near = sorted({s for shard in turn for s in (shard, _shard(shard + 1))})
        found = found.union(cut_lineage(vocabulary.where(F.col("shard").isin(near)).select("word", "h")
                                        .mapInArrow(probe, "edit long, source long")))
    return found


# ---- groups --------------------------------------------------------------


def hashed_vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, shard, h) of ``words`` (word, n)."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            h = np.zeros(len(words), np.uint64)
            for rows, letters in _by_length(words):
                h[rows] = word_hashes(letters)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array([_shard(len(w)) for w in words], pa.int32()), pa.array(h.view(np.int64))],
                ["word", "n", "shard", "h"])

    return words.select("word", "n").mapInArrow(hash_, "word string, n long, shard int, h long")


def near_words(vocabulary: DataFrame, budget: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n), both ways, of words exactly one edit apart."""
    other = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("h").alias("other_h"))
    pairs = (candidates(vocabulary, budget).join(other, F.col("edit") == F.col("other_h"))
             .join(vocabulary.select("word", "n", "h"), F.col("source") == F.col("h"))
             .where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct())
    pairs = cut_lineage(pairs)
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): each round doubles the steps taken. Counts at least double from a word to its
    form, so the rounds are few whatever the input."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("w"), F.col("root").alias("further"))
        stepped = cut_lineage(roots.join(further, F.col("root") == F.col("w"), "left")
                              .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return roots


def variant_groups(words: DataFrame, budget: int = FILTER_BYTES) -> DataFrame:
    """``words`` (word, n) of distinct words to (word, form, root, n, n_near, form_n)."""
    vocabulary = cut_lineage(hashed_vocabulary(words))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))
    stats = cut_lineage(near_words(vocabulary, budget).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    judged = vocabulary.select("word", "n").join(stats, "word", "left").withColumn("stands", F.expr("-best.minus >= 2 * n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr("CASE WHEN stands THEN best.other END").alias("form"), F.expr("CASE WHEN stands THEN -best.minus END").alias("form_n"))
    judged = cut_lineage(judged)
    roots = _roots(judged.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return judged.join(roots, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

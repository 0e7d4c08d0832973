"""MinHash near-dedup over SetSketch registers.

A text is its set of distinct 5-word shingles. A register holds an exponentially distributed minimum over
the set, truncated to a power of ``BASE``: ``floor(1 - log_b(min))``. Registers of two sets agree with a
chance of about their Jaccard similarity, and the register-wise maximum of two sketches is the sketch of the
union. Steps: bands of registers propose pairs, the joint likelihood of two sketches estimates their
similarity, and what may reach the threshold is verified on the full sets. Where a bucket needs pairs
beyond those with its leader, 2,048 one-bit minima thin them out within the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretrace.session import cut_lineage
from llm.graph import linked_components, shared_keys
from llm.text import byte_texts, fetch, id_text, shingle_set, word_hashes

WIDTH = 5
PERCENT = 85
REGISTERS = 128
#: registers a band; 32 bands miss a pair at similarity 0.85 with a chance of (1 - 0.85**4)**32 < 1e-10
BAND = 4
BASE = 1.02
RATE = 20.0
#: standard deviations that a likelihood estimate may lie under the threshold before a pair is refused unverified
SLACK = 5.0

#: one-bit minima of a document in a bucket that the first round leaves open
FINE = 2048


def _factors(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, (2, n), dtype=np.uint32) | np.uint32(1)


FACTORS, FINE_FACTORS = _factors(7, REGISTERS), _factors(8, FINE)


def _minima(shingles: np.ndarray, low_factor: np.ndarray, high_factor: np.ndarray) -> np.ndarray:
    """Smallest 32-bit hash of a non-empty set under each of the hash functions."""
    least = np.full(len(low_factor), 0xFFFFFFFF, np.uint32)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    wide = min(len(low), (1 << 17) // len(low_factor))
    first, second = np.empty((len(least), wide), np.uint32), np.empty((len(least), wide), np.uint32)
    for at in range(0, len(low), wide):
        n = min(wide, len(low) - at)
        np.multiply(low_factor[:, None], low[None, at:at + n], out=first[:, :n])
        np.multiply(high_factor[:, None], high[None, at:at + n], out=second[:, :n])
        first[:, :n] += second[:, :n]
        np.minimum(least, first[:, :n].min(axis=1), out=least)
    return least


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of mixed 64-bit hashes."""
    minima = -np.log1p(-(_minima(shingles, *FACTORS) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(minima) / np.log(BASE)), 0, 65535).astype(np.uint16)


def fine_bits(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of FINE further minima, as FINE / 64 longs: half of the bits of unlike minima agree."""
    least = _minima(shingles, *FINE_FACTORS) * np.uint32(0x9E3779B1)
    return np.packbits(least >> np.uint32(31) == 1).view(np.int64)


def estimate(n_a: np.ndarray, n_b: np.ndarray, greater: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs with known set sizes, from how many registers of the first
    sketch lie over and under those of the second."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 129)[None, :] * most[:, None]

    def over(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    first, second = over(u[:, None] - v[:, None] * grid), over(v[:, None] - u[:, None] * grid)
    equal = REGISTERS - greater - less
    tiny = 1e-12
    score = (greater[:, None] * np.log(first + tiny) + less[:, None] * np.log(second + tiny)
             + equal[:, None] * np.log(np.maximum(1 - first - second, tiny)))
    return grid[np.arange(len(grid)), score.argmax(axis=1)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(w, WIDTH) for w in word_hashes(byte_texts(part.column("text")))]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "n_shingles", "digest", "registers"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, registers); NULL registers for a text without words."""
    return id_text(docs).mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, registers binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            words = word_hashes(byte_texts(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([shingle_set(w, WIDTH).tobytes() for w in words], pa.binary())],
                ["id", "shingles"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(w, WIDTH) for w in word_hashes(byte_texts(part.column("text")))]
            bits = np.array([fine_bits(s) for s in sets]).reshape(len(sets), FINE // 64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, bits.T)],
                ["id", "n", *(f"b{i}" for i in range(FINE // 64))])


def _near(percent: int) -> str:
    """What the one-bit minima and sizes of two sets at the threshold fulfil, SLACK standard deviations off."""
    unlike = (1 - percent / 100) / 2
    most = int(FINE * unlike + SLACK * np.sqrt(FINE * unlike * (1 - unlike)))
    bits = " + ".join(f"bit_count(x.b{i} ^ y.b{i})" for i in range(FINE // 64))
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {bits} <= {most}"


def _likely(percent: int):
    bound = percent / 100
    bound -= SLACK * np.sqrt(bound * (1 - bound) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("ra").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            y = np.frombuffer(b"".join(batch.column("rb").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            guess = estimate(batch.column("na").to_numpy(zero_copy_only=False).astype(float),
                             batch.column("nb").to_numpy(zero_copy_only=False).astype(float),
                             (x > y).sum(axis=1), (x < y).sum(axis=1))
            yield batch.select(["a", "b"]).filter(pa.array(guess >= bound))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives that reach the threshold on their full sets."""
    side = lambda x: distinct.select(
        F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    sized = (pairs.join(side("a"), "a").join(side("b"), "b")
             .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
    likely = cut_lineage(sized.mapInArrow(_likely(percent), "a long, b long"))
    wanted = likely.select(F.col("a").alias("doc_id")).distinct().union(likely.select("b").distinct()).distinct()
    sets = cut_lineage(fetch(docs, wanted).mapInArrow(_sets, "id long, shingles binary"))
    full = (likely.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"))
    return full.select("a", "b", "sa", "sb").mapInArrow(_verified(percent), "a long, b long")


def _keys() -> Column:
    width = 2 * BAND
    return F.expr(f"transform(sequence(0, {REGISTERS // BAND - 1}), "
                  f"i -> xxhash64(i, substring(registers, i * {width} + 1, {width})))")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked if ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id that links reach and ``kept`` marks that document. Texts that are
    NULL, empty or without words have no shingles and are linked with nothing. Repeated rows of one doc_id
    are each returned and linked if their texts are; a row without doc_id is kept and linked with nothing. Other columns of ``docs`` are ignored.

    Equal sets collapse to their smallest doc_id before anything else; ``linked_components`` proposes pairs of
    different sets.
    """
    sketched = cut_lineage(sketches(docs))
    distinct = cut_lineage(sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers")))
    banded = distinct.select("id", F.explode(_keys()).alias("key"))
    final = linked_components(
        shared_keys(banded), lambda pairs: _links(pairs, distinct, docs, percent),
        lambda ids: fetch(docs, ids.withColumnRenamed("id", "doc_id")).mapInArrow(
            _fine, "id long, n long, " + ", ".join(f"b{i} long" for i in range(FINE // 64))), _near(percent))
    named = distinct.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return (sketched.join(named, "digest", "left")
            .select("doc_id", "n_shingles", F.expr("IF(doc_id IS NULL, NULL, coalesce(component_id, doc_id))")
                    .alias("component_id"))
            .withColumn("kept", F.expr("coalesce(doc_id = component_id, true)")))

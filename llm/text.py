"""Byte-level word scanning in numpy, shared by the text operators.

A word's 64-bit hash is a polynomial over its bytes (mod 2**64, random byte values), finished with a
mixing step; equal words have equal hashes in every process. Different words collide with a chance of
about 2**-64 a pair. Work goes through chunks of about ``CHUNK`` bytes, so memory follows the chunk and not the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
FILTER_BITS = 1 << 23
_RANDOM = np.random.default_rng(20240229)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}

#: bytes of words split at ASCII white space
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: bytes of words made of ASCII letters, digits and all other code points from U+0080
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started; a cluster that does not share the
    repository gets it by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    given = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, given)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only what operators read; other columns, whatever their names, stay outside."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each row; NULL is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """FILTER_BITS bits with one set for each value of a long column. Always FILTER_BITS / 8 bytes on the driver: a
    filter before a join, which may let a value pass but never loses one."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    rows = (values.select(at.alias("p"))
            .groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
    width = 4096 * 8
    out = np.zeros(FILTER_BITS + width, bool)
    for row in rows:
        # bucket n holds the values from (n - 1) * width + 1, bucket 0 only zero
        begin = (row["bucket"] - 1) * width + 1 if row["bucket"] > 0 else 0
        bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little").astype(bool)
        bits = bits if row["bucket"] > 0 else bits[:1]
        out[begin:begin + len(bits)] |= bits
    return np.packbits(out[:FILTER_BITS], bitorder="little")


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values.astype(np.int64), FILTER_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_filtered(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows that may have a wanted value in a long column: spares most others the shuffle of a join on it."""
    bits = bit_filter(wanted, column)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(passes(bits, values)))

    return rows.mapInArrow(near, rows.schema)


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the wanted doc_ids."""
    return (bit_filtered(id_text(docs), "doc_id", wanted)
            .join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, one longer than the buffer."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(sums))[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = table[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _chunks(texts: list[bytes], table: np.ndarray, lower: bool) -> Iterator[tuple[bytes, list[int]]]:
    """Joined texts of about CHUNK bytes with the text number of each part; a long text is cut between words."""
    if lower:
        # texts are lower-cased after the cut
        table = table.copy()
        table[0x41:0x5B] = table[0x61:0x7B]
    parts: list[bytes] = []
    numbers: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > 4 * CHUNK:
                cut = np.flatnonzero(~table[np.frombuffer(text, np.uint8, 4 * CHUNK, at)])
                end = at + int(cut[-1]) + 1 if len(cut) else end
            parts.append(text[at:end])
            numbers.append(i)
            held += end - at
            at = end
            if held >= CHUNK:
                yield parts, numbers
                parts, numbers, held = [], [], 0
    if parts:
        yield parts, numbers


def word_hashes(texts: list[bytes], table: np.ndarray = SPACED, lower: bool = True) -> list[np.ndarray]:
    """Per text, the hashes of its words in order. ``lower`` lower-cases A-Z only."""
    return words_and_sizes(texts, table, lower)[0]


def words_and_sizes(texts: list[bytes], table: np.ndarray, lower: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As ``word_hashes``, and the words' numbers of bytes."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    wide: list[list[np.ndarray]] = [[] for _ in texts]
    for parts, numbers in _chunks(texts, table, lower):
        joined = b" ".join(parts)
        buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        starts, ends = word_spans(buf, table)
        hashes = span_hashes(prefix_sums(buf), starts, ends)
        widths = ends - starts
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        cuts = np.searchsorted(starts, begins)
        for j, i in enumerate(numbers):
            out[i].append(hashes[cuts[j]:cuts[j + 1]])
            wide[i].append(widths[cuts[j]:cuts[j + 1]])
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    hashes, sizes = ([np.concatenate(x or empty) if len(x) != 1 else x[0] for x in parts]
                     for parts, empty in ((out, none[0]), (wide, none[1])))
    return hashes, sizes


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        h = np.uint64(n)
        with np.errstate(over="ignore"):
            for w in words:
                h = h * np.uint64(_BASE) + w
        return mix(np.array([h], np.uint64))
    h = words[: n - width + 1].copy()
    for j in range(1, width):
        h *= np.uint64(_BASE)
        h += words[j: n - width + 1 + j]
    h = np.sort(mix(h))
    fresh = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]

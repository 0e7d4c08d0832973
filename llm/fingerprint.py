"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (its lines with a visible character; repeats numbered) are hashed into cells that hold a count and
XORs. Two tables of one size subtract cell by cell; peeling the difference recovers exactly the digests that one
text has and the other lacks. If peeling gets stuck, both texts are sketched again, four times as large.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 24
_MASK = (1 << 64) - 1


def digests(text: str) -> list[int]:
    """64-bit digests of the paragraphs, all different: a repeat is told apart by its number."""
    seen: dict[str, int] = {}
    out = []
    for paragraph in text.split("\n"):
        if paragraph.strip():
            nth = seen[paragraph] = seen.get(paragraph, 0) + 1
            out.append(int.from_bytes(hashlib.blake2b(paragraph.encode(), digest_size=8, salt=nth.to_bytes(8, "little")).digest(), "little"))
    return out


def _places(key: int, third: int) -> tuple[int, int, int, int]:
    h = (key ^ (key >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _MASK
    h ^= h >> 31
    check = (h * 0x9E3779B97F4A7C15 & _MASK) >> 32
    return h % third, third + (h >> 21) % third, 2 * third + (h >> 42) % third, check


def table(keys: list[int], cells: int) -> list[list[int]]:
    """Cells [count, XOR of keys, XOR of checks]."""
    third = cells // 3
    out = [[0, 0, 0] for _ in range(3 * third)]
    for key in keys:
        *places, check = _places(key, third)
        for p in places:
            cell = out[p]
            cell[0] += 1
            cell[1] ^= key
            cell[2] ^= check
    return out


def difference(a: list[list[int]], b: list[list[int]]) -> tuple[set[int], set[int]] | None:
    """Keys only in the first and only in the second table; None if peeling does not empty the difference."""
    third = len(a) // 3
    cells = [[x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]] for x, y in zip(a, b)]
    only_a, only_b = set(), set()
    open_cells = list(range(len(cells)))
    while open_cells:
        count, key, check = cells[open_cells.pop()]
        if count not in (1, -1):
            continue
        *places, expected = _places(key, third)
        if expected != check:
            continue
        side = only_a if count == 1 else only_b
        if key in side:
            return None
        side.add(key)
        for p in places:
            cell = cells[p]
            cell[0] -= count
            cell[1] ^= key
            cell[2] ^= check
            open_cells.append(p)
    return None if any(any(c) for c in cells) else (only_a, only_b)


def written(keys: list[int], cells: int = CELLS) -> str:
    """The fingerprint as text: number of paragraphs, and the cells in base64."""
    packed = b"".join(struct.pack("<iQI", *cell) for cell in table(keys, cells))
    return f"{len(keys)}:{base64.b64encode(packed).decode()}"


def read(fingerprint: str) -> tuple[int, list[list[int]]]:
    n, _, packed = fingerprint.partition(":")
    return int(n), [list(x) for x in struct.iter_unpack("<iQI", base64.b64decode(packed))]


def likeness(a: list[int], b: list[int], first: str, second: str) -> float:
    """1 less the share of paragraphs that only one side has; from the fingerprints, or from larger ones if those fail.
    Two texts without paragraphs are alike."""
    if not a and not b:
        return 1.0
    (_, x), (_, y) = read(first), read(second)
    found = difference(x, y)
    cells = CELLS
    while found is None:
        cells *= 4
        found = difference(table(a, cells), table(b, cells))
    return 1.0 - (len(found[0]) + len(found[1])) / (len(a) + len(b))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, halo, doc_id, text), ranges of descending doc_id (NULL last, ties by the text's hash), sorted within
    partitions. The last rows of a bucket, ``halo`` 1, are the first of the next bucket; after the last comes the first.

    Bounds are approximate quantiles; they only place rows. Only bounds and one key a bucket reach the driver.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = 4 * max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(b) for b in given.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets)})
    edges = np.array(bounds, np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            at = len(edges) - np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            at[ids.is_null().to_numpy(zero_copy_only=False)] = len(edges) + 1
            yield batch.append_column("bucket", pa.array(at, pa.int32()))

    keyed = given.mapInArrow(dealt, "doc_id long, text string, bucket int").withColumn("mark", F.xxhash64("text"))
    heads = sorted(keyed.groupBy("bucket").agg(F.max(F.struct("doc_id", (-F.col("mark")).alias("m"))).alias("k")).collect(),
                   key=lambda r: r.bucket)
    rows = [(r.k.doc_id, -r.k.m, heads[i - 1].bucket) for i, r in enumerate(heads)]
    first = docs.sparkSession.createDataFrame(rows, "head_id long, head_mark long, target int")
    joined = keyed.join(F.broadcast(first), F.expr("doc_id <=> head_id AND mark = head_mark"), "left")
    copies = joined.select("doc_id", "text", "mark", F.explode(F.expr(
        "IF(target IS NULL, array(struct(bucket AS bucket, 0 AS halo)), "
        "array(struct(bucket AS bucket, 0 AS halo), struct(target AS bucket, 1 AS halo)))")).alias("at"))
    return (copies.select("at.*", "doc_id", "text", "mark").repartition("bucket")
            .sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), "mark")
            .select("bucket", "halo", "doc_id", "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``
    (doc_id, text): ``edited`` has the last half of the text replaced by as many characters of the next document.

    NULL is the empty text. Rows stand in descending doc_id, rows of one doc_id by a hash of their text, rows
    without doc_id last; a single row is followed by itself. Other columns are ignored; an empty table
    gives no rows. A task holds two neighbouring texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None

        def made(one: tuple, other: tuple) -> tuple:
            doc_id, text, keys, mark = one
            half = len(text) // 2
            edited = text[:len(text) - half] + other[1][:half]
            edited_keys = digests(edited)
            edited_mark = written(edited_keys)
            return (doc_id, len(text), edited, mark, edited_mark,
                    likeness(keys, edited_keys, mark, edited_mark), likeness(keys, other[2], mark, other[3]))

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                part = batch.slice(at, 512)
                for halo, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("halo", "doc_id", "text"))):
                    if halo and before is None:
                        continue
                    keys = digests(text)
                    here = doc_id, text, keys, written(keys)
                    if before is not None:
                        out.append(made(before, here))
                    before = None if halo else here
                columns = list(zip(*out)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, "
                                          "edited_fingerprint string, near_edited double, near_next double")

"""Suffix dedup: every byte goes that is covered by a string of SPAN bytes which also starts anywhere else.

What can repeat is narrowed without loss first. Each window of SPAN bytes chooses an anchor, the leftmost 32-byte string
with the smallest hash in it; equal windows choose equal anchors at equal places. Windows in a row with one anchor form a
stretch. Stretches whose anchor occurs once in the corpus are unique. Stretches that are equal as a whole are
repeats as a whole. Only unlike stretches of one anchor are left, one of each kind.

Those are shards of text whose Burrows-Wheeler transforms are merged by interleave refinement. The state is an interleave of
the shards' suffixes, in blocks that agree on their first h bytes. A round reads the transform's column (the byte
before each suffix) in interleaved order and distributes the suffixes stably by it: that is the interleave for h + 1, and a
block border where byte or old block changes is a common prefix of length h. A suffix alone in its block stays alone
however it is extended, and leaves. After SPAN rounds, the blocks are the repeated intervals; no suffixes were sorted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.session import cut_lineage
from llm.text import bit_filter, bit_filtered, byte_texts, passes, prefix_sums, span_hashes

SPAN = 200
ANCHOR = 32
CHUNK = 1 << 22
#: kinds of one anchor that a task merges; more are counted window by window in a shuffled aggregate
HOT = 4_000
#: kinds that a merging task is dealt on average
DEAL = 4_000


def stretches(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (first start, number of starts, anchor place after the first start, anchor hash, stretch hash) of
    the windows of a text, a chunk at a time; chunks overlap so that each start belongs to one of them."""
    wide = SPAN - ANCHOR + 1
    for low in range(0, max(len(text) - SPAN + 1, 0), CHUNK):
        buf = np.frombuffer(text, np.uint8)[low:low + CHUNK + SPAN - 1]
        n = len(buf) - SPAN + 1
        sums = prefix_sums(buf)
        at = np.arange(len(buf) - ANCHOR + 1)
        grams = span_hashes(sums, at, at + ANCHOR)
        keyed = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        # sliding minimum: the best of a block's tail and the next block's head
        blocks = -(-len(keyed) // wide)
        padded = np.full(blocks * wide, 0xFFFFFFFFFFFFFFFF, np.uint64)
        padded[:len(keyed)] = keyed
        grid = padded.reshape(blocks, wide)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(tail[:n], head[wide - 1:wide - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        count = np.diff(np.append(first, n))
        place = chosen[first] - first
        yield (first + low, count, place, grams[chosen[first]].view(np.int64),
               span_hashes(sums, first, first + count - 1 + SPAN).view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in byte_texts(batch.column("text")):
            for part in stretches(text):
                yield pa.RecordBatch.from_arrays([pa.array(part[3])], ["anchor"])


STRETCH = "doc_id long, copy long, at long, starts int, place int, anchor long, whole long"


def _repeated(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for i, text in enumerate(byte_texts(part.column("text"))):
                    for x in stretches(text):
                        keep = np.flatnonzero(passes(bits, x[3]))
                        found.append((np.full(len(keep), i), *(c[keep] for c in x)))
                if found:
                    owner, first, count, place, anchor, whole = (np.concatenate(c) for c in zip(*found))
                    who = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(who), part.column("copy").take(who), pa.array(first, pa.int64()),
                         pa.array(count, pa.int32()), pa.array(place, pa.int32()), pa.array(anchor), pa.array(whole)],
                        [c.split()[0] for c in STRETCH.split(", ")])

    return run


SHARD = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("starts", pa.int32()), ("place", pa.int32()),
                   ("kinds", pa.int64()), ("bytes", pa.binary())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted stretch of a document."""
    for batch in batches:
        for raw, wanted in zip(byte_texts(batch.column("text")), batch.column("wanted").to_pylist()):
            for at in range(0, len(wanted), 4096):
                some = pd.DataFrame(wanted[at:at + 4096])
                some["bytes"] = [raw[w["at"]:w["at"] + w["starts"] - 1 + SPAN] for w in wanted[at:at + 4096]]
                yield pa.RecordBatch.from_pandas(some, SHARD, preserve_index=False)


def repeated_starts(texts: list[bytes], starts: np.ndarray, places: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard, start) of all windows that another shard of the same group has at the same place from its anchor."""
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(texts), np.uint8)
    shard = np.repeat(np.arange(len(texts)), starts)
    nth = np.arange(len(shard)) - np.repeat(np.cumsum(starts) - starts, starts)
    # suffixes behind each window; a block begins as the suffixes that stand at one place from one anchor
    suffix = begin[shard] + nth + SPAN
    key = groups[shard].astype(np.int64) * (2 * SPAN + 1) + nth - places[shard] + SPAN
    order = np.argsort(key, kind="stable")
    suffix, key = suffix[order], key[order]
    for h in range(SPAN + 1):
        border = np.ones(len(suffix) + 1, bool)
        border[1:-1] = key[1:] != key[:-1]
        keep = ~(border[:-1] & border[1:])
        if not keep.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = np.cumsum(border[:-1])[keep]
        suffix = suffix[keep]
        if h == SPAN:
            break
        suffix = suffix - 1
        column = buf[suffix]
        order = np.argsort(column, kind="stable")
        suffix = suffix[order]
        key = block[order] * 256 + column[order]
    owner = np.searchsorted(begin, suffix, side="right") - 1
    return owner, suffix - begin[owner]


def _runs(numbers: np.ndarray) -> list[dict]:
    numbers = np.unique(numbers)
    cut = np.flatnonzero(np.diff(numbers) > 1) + 1
    return [{"low": int(x[0]), "high": int(x[-1])} for x in np.split(numbers, cut)] if len(numbers) else []


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("anchor", kind="stable")
    owners, begins, done = [], [], 0
    anchor = frame["anchor"].to_numpy()
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    # whole groups, some thousand shards at a time
    ends = [c for c in cuts.tolist()] + [len(frame)]
    while done < len(frame):
        end = next((e for e in ends if e > done and e - done >= 2000), len(frame))
        part = frame.iloc[done:end]
        owner, start = repeated_starts(part["bytes"].tolist(), part["starts"].to_numpy(np.int64), part["place"].to_numpy(np.int64),
                                       np.unique(part["anchor"].to_numpy(), return_inverse=True)[1])
        owners.append(owner + done)
        begins.append(start)
        done = end
    owner, start = np.concatenate(owners), np.concatenate(begins)
    order = np.argsort(owner, kind="stable")
    which, first = np.unique(owner[order], return_index=True)
    runs = [_runs(x) for x in np.split(start[order], first[1:])] if len(which) else []
    return pd.DataFrame({"anchor": frame["anchor"].to_numpy()[which], "whole": frame["whole"].to_numpy()[which], "runs": runs})


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for anchor, whole, starts, place, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "starts", "place", "bytes"))):
            at = np.arange(starts)
            hashes = span_hashes(prefix_sums(np.frombuffer(raw, np.uint8)), at, at + SPAN).view(np.int64)
            out.append(pd.DataFrame({"anchor": anchor, "whole": whole, "start": at, "place": place - at, "window": hashes}))
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False,
                                             schema=pa.schema([(c, pa.int64()) for c in ("anchor", "whole", "start", "place", "window")]))


RUNS = "anchor long, whole long, runs array<struct<low:int,high:int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts = [], []
        for raw, spans in zip(byte_texts(batch.column("text")), batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for s in sorted(spans or (), key=lambda s: s["b"]):
                if merged and s["b"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["e"])
                else:
                    merged.append([s["b"], s["e"]])
            at, parts = 0, []
            for b, e in merged:
                parts.append(raw[at:b])
                at = e
            kept.append(b"".join([*parts, raw[at:]]))
            counts.append((len(raw), sum(e - b for b, e in merged), len(merged)))
        numbers = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, numbers.T), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs`` (doc_id, text): bytes of the text, bytes
    removed, maximal removed runs, and the bytes left.

    NULL is the empty text; texts shorter than SPAN lose nothing.
    Repeated rows are copies of each other, and so lose all that is SPAN bytes long; a row without doc_id takes part like
    any other. Other columns are ignored; an empty table gives no rows.
    """
    none = -(1 << 62)
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = given.withColumn("copy", F.xxhash64("text"))
    often = cut_lineage(given.where(f"octet_length(text) >= {SPAN}").select("text").mapInArrow(_anchors, "anchor long")
                        .groupBy("anchor").count().where("count > 1").select("anchor"))
    found = cut_lineage(given.where(f"octet_length(text) >= {SPAN}").mapInArrow(_repeated(bit_filter(often, "anchor")), STRETCH)
                        .join(often, "anchor"))
    kinds = cut_lineage(found.groupBy("anchor", "whole", "starts", "place").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "copy", "at")).alias("one")))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_kinds = kinds.join(several, "anchor")
    wanted = cut_lineage(open_kinds.groupBy("one.doc_id", "one.copy").agg(F.collect_list(F.struct(
        "anchor", "whole", "starts", "place", F.col("kinds").cast("long").alias("kinds"), F.col("one.at").alias("at"))).alias("wanted")))
    # repeated rows are combined before they move, and the join lies as they then do: texts move once
    shards = cut_lineage(bit_filtered(given, "doc_id", wanted).dropDuplicates(["doc_id", "copy"])
                         .join(wanted, ["doc_id", "copy"]).select("text", "wanted")
                         .mapInArrow(_texts, "anchor long, whole long, starts int, place int, kinds long, bytes binary"))
    calm = shards.where(f"kinds <= {HOT}")
    deals = max(1, calm.count() // DEAL)
    merged = (calm.withColumn("deal", F.expr(f"pmod(xxhash64(anchor), {deals})")).groupBy("deal")
              .applyInPandas(_merge, RUNS))
    windows = shards.where(f"kinds > {HOT}").mapInArrow(_window_hashes, "anchor long, whole long, start long, place long, window long")
    twice = windows.groupBy("anchor", "place", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    counted = (windows.join(twice, ["anchor", "place", "window"]).groupBy("anchor", "whole")
               .agg(F.collect_set(F.struct(F.col("start").cast("int").alias("low"), F.col("start").cast("int").alias("high"))).alias("runs")))
    whole = kinds.where("n > 1").select("anchor", "whole", F.expr("array(struct(0 AS low, starts - 1 AS high))").alias("runs"))
    runs = merged.union(counted).join(kinds.where("n > 1").select("anchor", "whole"), ["anchor", "whole"], "left_anti").union(whole)
    spans = (found.join(runs, ["anchor", "whole"]).select("doc_id", "copy", "at", F.explode("runs").alias("r"))
             .select("doc_id", "copy", F.struct((F.col("at") + F.col("r.low")).alias("b"), (F.col("at") + F.col("r.high") + SPAN).alias("e")).alias("s"))
             .groupBy("doc_id", "copy").agg(F.collect_set("s").alias("spans")))
    return (given.join(spans, ["doc_id", "copy"], "left").select(F.expr(f"nullif(doc_id, {none})").alias("doc_id"), "text", "spans")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))

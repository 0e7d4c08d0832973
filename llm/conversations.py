"""Repair of conversations as a lightest derivation.

A repaired conversation has role initials ``(s?(ua)+)?``. Items ``[i, state]`` say that the first i rows are read and the
output stands in a state: nothing yet, after a system row, after a user row, after an assistant row. Deductions keep, rerole
or delete a row or insert an empty one; each adds its cost and its letter. These functions never lessen the pair
(cost, audit) and keep its order, so Knuth's agenda finalises an item when it pops it.

Rows are ordered by turn, NULL first, rows of one turn by the SHA-256 digest of role and text, so equal rows are neighbours
and the result does not depend on the order of the table. Long conversations are cut in fragments of at most ``FRAGMENT``
rows: a fragment derives one item ``[start state -> end state]`` for each pair of states, and neighbouring spans combine by
deductions with two antecedents, again to one item a pair. Only row keys (turn, digest, initial) go through that;
texts are shuffled once, by conversation, to the decisions on them.

NULL conv_id is a conversation of its own. NULL role and text are one space. A role that starts with none of s, u and a, an
empty one included, cannot be kept. A repeated row is a duplicate.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.session import cut_lineage

#: rows of a conversation that one agenda reads
FRAGMENT = 1024
#: rows of an output batch
BATCH = 2048

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: the state after one more user or assistant row
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOALS = (NOTHING, ASSISTANT)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = {"su", "ua", "au"}
_SPACE = "concat(' ', char(9), char(10), char(11), char(12), char(13))"

Leg = tuple[int, str]


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with NULL role and text as one space; other columns stay outside."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults set by the checksum of ``conv_id:turn`` (NULL as one space), modulo 20: 0 drops the row, 1 empties
    its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    return (rows_of(conversations).withColumn("fault", F.crc32(key.cast("binary")) % 20).where("fault <> 0")
            .select("conv_id", "turn", F.expr("CASE WHEN fault = 4 THEN 'user' ELSE role END").alias("role"),
                    F.expr("CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
                    F.explode(F.expr("CASE WHEN fault = 3 THEN array(0, 1) ELSE array(0) END")).alias("copy")).drop("copy"))


def _mark() -> F.Column:
    """Digest of role and text."""
    return F.expr("unhex(sha2(concat(length(role), ':', role, text), 256))")


def _keys(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, n, initial, fault): no text. A row is a duplicate if another of its conversation with the
    same mark stands before it; the first of each mark comes from an aggregate combined before its shuffle."""
    keys = cut_lineage(rows.select(
        "conv_id", "turn", _mark().alias("mark"), F.monotonically_increasing_id().alias("n"),
        F.substring("role", 1, 1).alias("initial"),
        F.expr(f"""CASE WHEN rtrim({_SPACE}, text) = '' THEN {BLANK}
            WHEN right(rtrim({_SPACE}, text), 1) IN ('.', '!', '?') THEN 0 ELSE {TRUNCATED} END""").alias("fault")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "n")
    firsts = (keys.groupBy("conv_id", "mark").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
              .where("times > 1").select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first"))
    late = F.coalesce(F.col("first") < place, F.lit(False)) & (F.col("fault") != BLANK)
    return (keys.join(firsts, F.expr("conv_id <=> c AND mark = m"), "left")
            .select("conv_id", "turn", "mark", "n", "initial",
                    F.when(late, F.lit(DUPLICATE)).otherwise(F.col("fault")).alias("fault")))


def legs(initials: list[str], faults: list[int], starts: tuple[int, ...]) -> dict[tuple[int, int], Leg]:
    """Least (cost, audit) from each start state to each end state over all rows given."""
    n = len(initials)
    found: dict[tuple[int, int], Leg] = {}
    for start in starts:
        final: set[tuple[int, int]] = set()
        agenda = [(0, "", 0, start)]
        ends = 0
        while agenda and ends < 4:
            cost, audit, i, state = heapq.heappop(agenda)
            if (i, state) in final:
                continue
            final.add((i, state))
            follower = NEXT[state]
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, follower))
            if i == n:
                found[start, state] = cost, audit
                ends += 1
                continue
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
            if faults[i] in (BLANK, DUPLICATE):
                continue
            stays = cost + (CUT_OFF if faults[i] == TRUNCATED else 0)
            heapq.heappush(agenda, (stays + REROLE, audit + "R", i + 1, follower))
            if initials[i] == NAMES[follower][0]:
                heapq.heappush(agenda, (stays, audit + "K", i + 1, follower))
            elif initials[i] == "s" and state == NOTHING:
                heapq.heappush(agenda, (stays, audit + "K", i + 1, SYSTEM))
    return found


class Span:
    """Items over neighbouring fragments: least (cost, audit) a pair of states, and the state between its two halves."""

    def __init__(self, items: dict, halves: tuple[Span, Span] | None = None, between: dict | None = None, part: int = 0):
        self.items, self.halves, self.between, self.part = items, halves, between, part
        self.level = 0 if halves is None else halves[0].level + 1

    def with_next(self, other: Span) -> Span:
        items: dict[tuple[int, int], Leg] = {}
        between = {}
        for (p, r), (cost, audit) in self.items.items():
            for (s, q), (more, rest) in other.items.items():
                if r == s and ((p, q) not in items or (cost + more, audit + rest) < items[p, q]):
                    items[p, q] = cost + more, audit + rest
                    between[p, q] = r
        return Span(items, (self, other), between)

    def path(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(part, start, end) of each fragment on the lightest derivation."""
        todo = [(self, start, end)]
        while todo:
            span, p, q = todo.pop()
            if span.halves is None:
                yield span.part, p, q
            else:
                middle = span.between[p, q]
                todo += [(span.halves[1], middle, q), (span.halves[0], p, middle)]


FRAGMENTS = """conv_id long, part long, n_rows long, least long, most long, n_turns long, blank long, duplicate long,
truncated long, illegal long, initial_first string, initial_last string,
legs array<struct<p:int,q:int,cost:long,audit:string>>, turns array<long>, marks array<binary>, initials array<string>"""


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)],
                                          schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield packed()
            held = []
    if held:
        yield packed()


_FRAGMENT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("n_rows", pa.int64()), ("least", pa.int64()), ("most", pa.int64()),
     ("n_turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
     ("illegal", pa.int64()), ("initial_first", pa.string()), ("initial_last", pa.string()),
     ("legs", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
     ("turns", pa.list_(pa.int64())), ("marks", pa.list_(pa.binary())), ("initials", pa.list_(pa.string()))])


def _fragment(conv, part: int, rows: list[tuple], starts: tuple[int, ...]) -> tuple:
    turns, marks, initials, faults = map(list, zip(*rows, strict=True))
    known = sorted({t for t in turns if t is not None})
    found = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in legs(initials, faults, starts).items()]
    return (conv, part, len(rows), known[0] if known else None, known[-1] if known else None, len(known),
            *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), initials[0], initials[-1], found, turns, marks, initials)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of a sorted partition. Only its first conversation may have begun in an earlier one."""
    base = TaskContext.get().partitionId() << 33

    def rows() -> Iterator[tuple]:
        part, held, conv, starts = base, [], None, tuple(range(4))
        for c, *row in _columns(batches, ["conv_id", "turn", "mark", "initial", "fault"]):
            if held and (c != conv or len(held) == FRAGMENT):
                yield _fragment(conv, part, held, starts)
                part, held = part + 1, []
                starts = (NOTHING,) if c != conv else tuple(range(4))
            conv = c
            held.append(tuple(row))
        if held:
            yield _fragment(conv, part, held, starts)

    return _batches(rows(), _FRAGMENT_ARROW)


MERGED = """conv_id long, part long, p int, q int, gaps long, blank long, duplicate long, truncated long, illegal long,
cost long, audit string"""
_MERGED_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("p", pa.int32()), ("q", pa.int32()),
                           *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                           ("audit", pa.string())])


def _conversation(conv, fragments: Iterator[tuple]) -> Iterator[tuple]:
    """One row a fragment with its states, and one with part NULL for the conversation."""
    spans: list[Span] = []
    least = most = last_turn = None
    last = ""
    n_turns = blank = duplicate = truncated = illegal = 0
    for part, low, high, turns, b, d, t, i, first, final, found in fragments:
        span = Span({(x["p"], x["q"]): (x["cost"], x["audit"]) for x in found}, part=part)
        if spans:
            illegal += last + first not in LEGAL
        while spans and spans[-1].level == span.level:
            span = spans.pop().with_next(span)
        spans.append(span)
        if low is not None:
            # turns do not fall from one fragment to the next
            n_turns += turns - (low == last_turn)
            least, most, last_turn = low if least is None else least, high, high
        blank, duplicate, truncated, illegal, last = blank + b, duplicate + d, truncated + t, illegal + i, final
    whole = spans.pop()
    while spans:
        whole = spans.pop().with_next(whole)
    (cost, audit), end = min((whole.items[NOTHING, g], g) for g in GOALS if (NOTHING, g) in whole.items)
    for part, p, q in whole.path(NOTHING, end):
        yield conv, part, p, q, *[None] * 7
    gaps = 0 if least is None else most - least + 1 - n_turns
    yield conv, None, None, None, gaps, blank, duplicate, truncated, illegal, cost, audit


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "part", "least", "most", "n_turns", "blank", "duplicate", "truncated", "illegal",
             "initial_first", "initial_last", "legs"]
    return _batches((out for conv, rows in _grouped(_columns(batches, names)) for out in _conversation(conv, rows)), _MERGED_ARROW)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, rest of the rows) of neighbours with an equal first value."""
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1:] for r in group)


DECIDED = "conv_id long, turn long, mark binary, part long, keep boolean, role string, before string, after string"
_DECIDED_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("mark", pa.binary()), ("part", pa.int64()),
                            ("keep", pa.bool_()), ("role", pa.string()), ("before", pa.string()), ("after", pa.string())])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each surviving row: its new role, NULL if unchanged, and the roles of rows inserted beside it."""

    def rows() -> Iterator[tuple]:
        names = ["conv_id", "part", "p", "audit", "turns", "marks", "initials"]
        for conv, part, start, audit, turns, marks, initials in _columns(batches, names):
            state, i, before = start, 0, ""
            kept: tuple | None = None
            for letter in audit:
                if letter == "I":
                    state = NEXT[state]
                    before += f"{NAMES[state]}\n"
                    continue
                if letter == "R" or letter == "K":
                    if kept:
                        yield *kept, ""
                    system = letter == "K" and state == NOTHING and initials[i] == "s"
                    state = SYSTEM if system else NEXT[state]
                    kept = conv, turns[i], marks[i], part, True, NAMES[state] if letter == "R" else None, before
                    before = ""
                i += 1
            if kept:
                yield *kept, before
            elif before:
                yield conv, turns[0], marks[0], part, False, None, before, ""

    return _batches(rows(), _DECIDED_ARROW)


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (conv_id, turn, role, text) to one row a conversation with its faults, cost and audit, and to decisions on
    rows. A conversation's audit is one letter an edit; nothing else of a whole conversation is held in a row."""
    ordered = (_keys(rows).repartitionByRange("conv_id", "turn", "mark", "n")
               .sortWithinPartitions("conv_id", "turn", "mark", "n"))
    fragments = cut_lineage(ordered.mapInArrow(_cut, FRAGMENTS))
    merged = cut_lineage(fragments.drop("turns", "marks", "initials").repartition("conv_id")
                         .sortWithinPartitions("conv_id", "part").mapInArrow(_merge, MERGED))
    totals = merged.where("part IS NULL").drop("part", "p", "q")
    ways = merged.where("part IS NOT NULL").select("part", "p", "q")
    chosen = fragments.join(ways, "part").selectExpr(
        "conv_id", "part", "p", "filter(legs, x -> x.p = p AND x.q = q)[0].audit AS audit", "turns", "marks", "initials")
    return totals, chosen.mapInArrow(_decisions, DECIDED)


REPAIRED = "conv_id long, place long, role string, text string"
_REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
HASHED = "conv_id long, repaired_sha256 string"
_HASHED_ARROW = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
_STREAM = ["conv_id", "turn", "mark", "role", "text", "keep", "before", "after"]


def _lines(rows: Iterator[tuple]) -> Iterator[tuple[str, str]]:
    """(role, text) of one repaired conversation. Decisions on a key come before the rows that have it; of equal rows at
    most one survives."""
    waiting: list[tuple] = []
    key = None
    for turn, mark, role, text, keep, before, after in rows:
        if (turn, mark) != key:
            key, waiting = (turn, mark), []
        if text is None:
            waiting.append((role, keep, before, after))
            continue
        for new_role, stays, first, then in waiting:
            yield from ((name, "") for name in first.split("\n")[:-1])
            if stays:
                yield new_role or role, text
            yield from ((name, "") for name in then.split("\n")[:-1])
        waiting = []


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(((conv, place, role, text) for conv, rows in _grouped(_columns(batches, _STREAM))
                     for place, (role, text) in enumerate(_lines(rows))), _REPAIRED_ARROW)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[tuple]:
        for conv, rows in _grouped(_columns(batches, _STREAM)):
            total, sep = hashlib.sha256(), ""
            for role, text in _lines(rows):
                total.update(f"{sep}{role}:{text}".encode())
                sep = "\n"
            yield conv, total.hexdigest()

    return _batches(digests(), _HASHED_ARROW)


def _stream(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows behind the decisions on them, a conversation in one partition and in order: a hash of it reads it in order."""
    texts = rows.select("conv_id", "turn", _mark().alias("mark"), "role", "text")
    return (texts.unionByName(decisions, allowMissingColumns=True).repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "mark", F.col("text").isNotNull(), "part"))


def repaired_rows(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, inserted rows with an empty text."""
    return _stream(rows, decisions).mapInArrow(_repaired, REPAIRED)


def repaired_hashes(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` of the repaired rows, joined by newlines; rows go by in a stream."""
    return _stream(rows, decisions).mapInArrow(_hashed, HASHED)


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. ``rows`` are the rows to repair, its own if not given; a conv_id without any has zeros, an empty
    audit and the hash of an empty text."""
    rows = rows_of(conversations) if rows is None else rows
    totals, decisions = plan_repairs(rows)
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    hashes = repaired_hashes(rows, decisions).withColumnRenamed("conv_id", "h")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (ids.join(totals, F.expr("id <=> conv_id"), "left").join(hashes, F.expr("id <=> h"), "left")
            .select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))

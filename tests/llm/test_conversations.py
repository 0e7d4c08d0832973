"""Repairs against every edit sequence, and the damage and counts against a plain walk."""

import hashlib
import itertools
import random
import re
import zlib

from llm import conversations as cv

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_faults(rows):
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
    return faults


def plain_repair(rows, inserts):
    """Cheapest of all edit sequences with at most so many inserts in a row, by trying them all from the left."""
    faults = plain_faults(rows)
    best = None
    todo = [(0, "", 0, "", ())]
    while todo:
        i, audit, cost, roles, lines = todo.pop()
        if best is not None and cost > best[0]:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, lines
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        if not re.search("I" * inserts + "$", audit):
            for name in ("user", "assistant"):
                todo.append((i, audit + "I", cost + 5, roles + name[0], (*lines, f"{name}:")))
        if i == len(rows):
            continue
        role, text = rows[i]
        todo.append((i + 1, audit + "D", cost + 2, roles, lines))
        if faults[i] not in ("blank", "duplicate"):
            more = 5 if faults[i] == "truncated" else 0
            if role:
                todo.append((i + 1, audit + "K", cost + more, roles + role[0], (*lines, f"{role}:{text}")))
            for name in ("user", "assistant"):
                todo.append((i + 1, audit + "R", cost + more + 1, roles + name[0], (*lines, f"{name}:{text}")))
    return best


def digest(rows_):
    return sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def want_row(conv, rows, inserts=2):
    rows = digest([r[1:] for r in rows if r[0] == conv])
    faults = plain_faults([r[1:] for r in rows])
    cost, audit, lines = plain_repair([r[1:] for r in rows], inserts)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost,
            "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def random_rows(rng, n_conv, most):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No?", "cut", " ", None, "", "é!\n", "a. b"]
    rows = []
    for conv in range(n_conv):
        for turn in range(rng.randrange(0, most + 1)):
            rows.append((None if conv == 0 else conv, rng.choice([turn, turn, turn, None, turn - 1]),
                         rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts)))
    return rows


def test_matches_all_edit_sequences(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 60, 5)
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, fault int, audit string")
    got = {r.conv_id: r.asDict() for r in cv.repair(frame, cv.damaged(frame)).collect()}
    assert got == {c: want_row(c, plain_damage(rows)) for c in {r[0] for r in rows}}


def test_cut_conversations_equal_whole_ones(spark):
    """Fragments of 1024 rows and borders of partitions inside conversations; the plain side is one long derivation."""
    rng = random.Random(6)
    rows = [(conv, turn, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["So.", "cut off", f"t{turn}.", f"t{turn}"]))
            for conv, n in ((1, 2_600), (2, 3), (3, 1_024), (4, 1_025), (None, 700)) for turn in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r.conv_id: r for r in cv.repair(frame).collect()}
    totals, decisions = cv.plan_repairs(cv.rows_of(frame))
    lines = {}
    for r in sorted(cv.repaired_rows(cv.rows_of(frame), decisions).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv in (1, 2, 3, 4, None):
        mine = [r[2:] for r in rows if r[0] == conv]
        faults = [("", "blank", "duplicate", "truncated").index(f) for f in plain_faults(mine)]
        found = cv.legs([r[0][:1] for r in mine], faults, (0,))
        assert (got[conv].cost, got[conv].audit) == min(found[0, g] for g in cv.GOALS if (0, g) in found)
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == got[conv].repaired_sha256


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cv.repair(spark.createDataFrame([], schema)).count() == 0
    dropped = next(t for t in itertools.count() if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(9, dropped, "user", "Hello.")], schema)
    (row,) = cv.repair(frame, cv.damaged(frame)).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_text_and_repeats(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "Ok.")] + [(1, 1, "assistant", "Ok.")] * 30
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = cv.repair(frame).collect()
    assert (row.duplicate, row.cost, row.audit) == (30, 60, "KK" + "D" * 30)
    text = "user:" + "word " * 300_000 + ".\nassistant:Ok."
    assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()

"""As-of joins and interval membership against plain loops."""

import bisect
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from faretrace.operators import asof

START = date(2024, 1, 1)


def made(rng, n_rows, n_events):
    day = lambda: START + timedelta(rng.randrange(400))
    market = lambda: rng.choice(["A", "A", "A", "A", "B", "C", None])
    rows = [(i, market(), rng.choice([day(), day(), day(), None]) if i % 9 == 0 else day()) for i in range(n_rows)]
    events = [(rng.choice(["A", "B", "B", None, "D"]), day(), rng.choice("xyz")) for _ in range(n_events)] + [("A", None, "q")]
    return rows, events


def want(rows, events):
    out = {}
    for i, m, d in rows:
        mine = sorted((e[1], e[2]) for e in events if e[0] == m and e[1] is not None)
        first = {}
        for e in mine:
            first.setdefault(e[0], e)
        days = sorted(first)
        at = bisect.bisect_right(days, d) - 1 if d else -1
        upper = bisect.bisect_left(days, d) if d else len(days)
        out[i] = (first[days[at]] if d and at >= 0 else None, first[days[upper]] if d and upper < len(days) else None)
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("n_events", [0, 3, 300])
def test_matches_bisection(spark, parts, n_events):
    rows, events = made(random.Random(n_events), 500, n_events)
    df = spark.createDataFrame(rows, "id int, market string, at date")
    ev = spark.createDataFrame(events, "place string, day date, name string")
    got = {r.id: tuple(e and tuple(e) for e in (r.last_event, r.next_event)) for r in
           asof.with_events(df, ev, "at", "day", ["market"], ["place"], ["name"], parts).collect()}
    assert got == want(rows, events)


def test_without_markets_and_nearest(spark):
    df = spark.createDataFrame([(START + timedelta(k),) for k in (0, 3, 4, 5, 30)], "at date")
    ev = spark.createDataFrame([(START + timedelta(k),) for k in (2, 6)], "day date")
    got = asof.with_events(df, ev, "at", "day", parts=3).selectExpr("at", f"{asof.days_to_nearest('at')} AS d").orderBy("at").collect()
    assert [r.d for r in got] == [-2, 1, 2, -1, 24]


def test_plan_has_no_product(spark):
    df = spark.createDataFrame([(1, "A", START)], "id int, market string, at date")
    ev = spark.createDataFrame([("A", START)], "market string, day date")
    plan = asof.with_events(df, ev, "at", "day", ["market"], parts=2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_many_overlapping_intervals(spark):
    rng = random.Random(7)
    folds = [(i, rng.choice(["train", "test"]), START + timedelta(a), START + timedelta(a + rng.randrange(90)))
             for i, a in ((i, rng.randrange(-50, 400)) for i in range(5_000))]
    rows = [(i, START + timedelta(rng.randrange(300)) if i % 50 else None, rng.random() < 0.2) for i in range(300)]
    intervals = spark.createDataFrame(folds, "fold int, side string, start date, end date")
    df = spark.createDataFrame(rows, "id int, at date, flag boolean")
    got = {(r.id, r.fold) for r in asof.in_intervals(df, intervals, "at").collect()}
    assert got == {(i, f) for i, d, _ in rows if d for f, _, a, b in folds if a <= d <= b}
    counts = {r.fold: (r.rows, r.positives) for r in asof.interval_counts(df, intervals, "at", "flag").collect()}
    assert counts == {f: (sum(a <= d <= b for _, d, _ in rows if d), sum(a <= d <= b for _, d, y in rows if d and y)) for f, _, a, b in folds}
    plan = asof.in_intervals(df, intervals, "at")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tasks_do_not_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(asof, "ROWS_A_PART", 50)
    rows, events = made(random.Random(8), 2000, 100)
    df = spark.createDataFrame(rows, "id int, market string, at date")
    ev = spark.createDataFrame(events, "place string, day date, name string")
    found = asof.with_events(df, ev, "at", "day", ["market"], ["place"], ["name"])
    sizes = found.select("id", F.spark_partition_id().alias("task")).groupBy("task").count().agg({"count": "max"}).first()[0]
    assert sizes < 500
    assert {r.id: tuple(e and tuple(e) for e in (r.last_event, r.next_event)) for r in found.collect()} == want(rows, events)

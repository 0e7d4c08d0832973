"""Daily sketches: merged ranges against the exact answers, hot days, empty tables and missing values."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from faretrace.operators import sketches, splits
from faretrace.plans.quantiles import exact_quantiles

D0 = date(2022, 5, 1)


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows on one day, values with many ties, some NULL."""
    return spark.range(60_000, numPartitions=7).selectExpr(
        "concat('r', id % 2) AS route", "id % 9000 AS item",
        f"date_add(DATE '{D0}', CASE WHEN id % 3 = 0 THEN 4 ELSE CAST(id % 41 AS INT) END) AS flightDate",
        "CASE WHEN id % 100 <> 7 THEN round(pow(pmod(xxhash64(id), 100000) / 1000D, 1.7), 1) END AS fare").cache()


def spans(spark, *bounds):
    rows = [(i, "span", D0 + timedelta(a), D0 + timedelta(b)) for i, (a, b) in enumerate(bounds)]
    return spark.createDataFrame(rows, "fold int, side string, start date, end date")


def test_ranges_keep_to_the_rank_error(spark, facts):
    daily = sketches.daily_quantiles(facts, "fare", ["route"])
    bounds = [(0, 40), (4, 4), (0, 3), (5, 30), (11, 12)]
    got = sketches.quantiles_between(daily, spans(spark, *bounds), {"low": 0.05, "mid": 0.5, "high": 0.95}, ["route"]).collect()
    assert len(got) == 2 * len(bounds)
    for r in got:
        a, b = bounds[r["fold"]]
        values = sorted(x[0] for x in facts.where(F.col("flightDate").between(D0 + timedelta(a), D0 + timedelta(b)))
                        .where(F.col("route") == r["route"]).where("fare IS NOT NULL").select("fare").collect())
        assert r["n"] == len(values)
        for name, f in (("low", 0.05), ("mid", 0.5), ("high", 0.95)):
            under, upto = sum(v < r[name] for v in values), sum(v <= r[name] for v in values)
            off = 2 * sketches.rank_error() * len(values) + 1
            assert r[name] in values and under - off <= f * len(values) <= upto + off


def test_few_rows_are_exact_and_appended_days_count(spark, facts):
    few = facts.where("item < 8").limit(150)
    daily = sketches.daily_quantiles(few, "fare")
    again = daily.where(F.col("day") <= D0 + timedelta(9)).union(daily.where(F.col("day") > D0 + timedelta(9)))
    [a], [b] = (sketches.quantiles_between(d, spans(spark, (0, 99)), {"mid": 0.5}).collect() for d in (daily, again))
    assert a == b and a["n"] == few.where("fare IS NOT NULL").count()
    exact = exact_quantiles(few, "fare", {"mid": 0.5}).first()["mid"]
    values = sorted(r[0] for r in few.where("fare IS NOT NULL").select("fare").collect())
    at = len(values) // 2
    assert a["mid"] in values[max(at - 1, 0):at + 1] and values[at - 1] <= exact <= values[at]


def test_key_estimates_within_their_error_and_exact_when_small(spark, facts):
    folds = splits.rolling_origin_splits(facts, 3, 5, min_train_days=20)
    intervals = sketches.fold_intervals(facts, folds)
    exact = {r["fold"]: r for r in splits.group_leakage(facts, folds, "item").collect()}
    for log_size, sure in ((8, False), (14, True)):
        got = sketches.leakage_estimates(sketches.daily_keys(facts, "item", log_size=log_size), intervals, log_size).collect()
        assert {r["fold"] for r in got} == set(exact)
        for r in got:
            want = exact[r["fold"]]
            assert (r["error_groups"] == 0) is sure
            assert abs(r["test_groups"] - want["test_groups"]) <= r["error_groups"]
            assert abs(r["leaking_groups"] - want["leaking_groups"]) <= r["error_groups"]
            if sure:
                assert r["leaking_pct"] == pytest.approx(want["leaking_pct"])


def test_range_merges_do_not_read_the_facts_again(spark, facts):
    table = spark.createDataFrame(sketches.daily_keys(facts, "item").collect(), "day date, keys binary")
    intervals = sketches.fold_intervals(facts, splits.rolling_origin_splits(facts, 3, 5, min_train_days=20))
    plan = sketches.leakage_estimates(table, intervals)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "InMemoryRelation" not in plan


def test_empty_and_missing(spark, facts):
    none = facts.where("false")
    assert sketches.daily_quantiles(none, "fare").count() == sketches.daily_keys(none, "item").count() == 0
    blank = facts.withColumn("fare", F.lit(None).cast("double")).withColumn("item", F.lit(None).cast("long"))
    assert sketches.daily_quantiles(blank, "fare").count() == sketches.daily_keys(blank, "item").count() == 0
    daily = sketches.daily_keys(facts.where(F.col("flightDate") == D0 + timedelta(20)), "item")
    only_test = spark.createDataFrame([(1, "train", D0, D0), (1, "test", D0 + timedelta(20), D0 + timedelta(20)), (2, "test", D0, D0)],
                                      "fold int, side string, start date, end date")
    [r] = sketches.leakage_estimates(daily, only_test).collect()
    assert r["fold"] == 1 and r["test_groups"] > 0 and r["leaking_groups"] == 0

"""Distributed order, prefix sums and exact quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faretrace.operators import profile
from faretrace.plans import quantiles
from faretrace.plans.ordering import ordered_rank, running_totals
from faretrace.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaab"), round(rng.gauss(100, 40), 2) if rng.random() > .3 else 77.0)
            for i in range(900)]
    rows += [(1000, "c", 1e12), (1001, "c", -5.0), (1002, None, 3.0), (1003, None, None)]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(6).cache()


@pytest.mark.parametrize("parts", [None, 19])
def test_ordered_rank(numbers, parts):
    got = ordered_rank(numbers, ["v", "id"], "pos", parts).orderBy("pos").collect()
    want = sorted(((r["v"], r["id"]) for r in numbers.collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r["pos"] for r in got] == list(range(len(want)))
    assert [(r["v"], r["id"]) for r in got] == want


@pytest.mark.parametrize("parts", [None, 19])
def test_running_totals(numbers, parts):
    got = running_totals(numbers, ["id"], {"upto": "id"}, parts).orderBy("id").collect()
    assert [r["upto"] for r in got] == list(np.cumsum([r["id"] for r in got]))
    assert set(got[0].asDict()) == {"id", "g", "v", "upto"}


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("limit", [10**6, 5, 1])
def test_exact_quantiles(numbers, by, limit):
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.937, "hi": 1.0}
    got = quantiles.exact_quantiles(numbers, "v", wanted, by, limit=limit).collect()
    groups = {}
    for r in numbers.where("v IS NOT NULL").collect():
        groups.setdefault(r["g"] if by else None, []).append(r["v"])
    assert len(got) == len(groups)
    for row in got:
        values = groups[row["g"] if by else None]
        for name, f in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values, f), rel=1e-12)


def test_narrowing_makes_progress_on_far_apart_clusters(spark):
    rows = [(float(i) * 1e-9,) for i in range(300)] + [(1e9 + i,) for i in range(300)]
    df = spark.createDataFrame(rows, "v double")
    got = quantiles.exact_quantiles(df, "v", {"mid": 0.5}, limit=4).first()
    assert got["mid"] == pytest.approx(np.median([r[0] for r in rows]))


def test_describe_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    got = {r["g"]: r for r in profile.describe(df, "v", ["g"]).collect()}
    assert got["a"]["q50"] == 1.5 and got["a"]["count"] == 2
    assert got["b"]["q50"] is None and got["b"]["count"] == 0


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(11)], "g string, v double")
    got = profile.histogram(df, "v", 5, "g").orderBy("bin").collect()
    assert [r["rows"] for r in got] == [2, 2, 2, 2, 3]
    assert sum(r["density"] * 2.0 for r in got) == pytest.approx(1.0)


def test_histogram_of_one_value_has_no_density(spark):
    df = spark.createDataFrame([("a", 3.0)] * 4, "g string, v double")
    [row] = profile.histogram(df, "v", 5, "g").collect()
    assert (row["bin"], row["rows"], row["density"]) == (4, 4, None)


def test_value_counts_share_is_of_all_rows(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    got = [(r["value"], r["rows"], r["share_pct"]) for r in profile.value_counts(df, "c").collect()]
    assert got == [("x", 2, 50.0), ("y", 1, 25.0)]


def test_sampled_trajectories_are_reproducible(spark):
    df = spark.createDataFrame([("r", f"l{i}") for i in range(50)] + [("s", "m")],
                               "route string, legId string")
    a, b = (sorted(profile.sample_trajectories(d, 7).collect())
            for d in (df, df.repartition(5).orderBy(F.desc("legId"))))
    assert a == b and len(a) == 2


def test_checkpoint_folder_of_the_session_is_used(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("limit", [10**6, 2])
@pytest.mark.parametrize("name", ["side", "name", "lo", "rank", "v", "n", "q", "weight", "__group1"])
def test_quantiles_by_any_column_name(spark, name, limit):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(20)], f"`{name}` int, fare double")
    got = quantiles.exact_quantiles(df, "fare", {"mid": 0.5}, [name], limit=limit).collect()
    assert {r[name]: r["mid"] for r in got} == {0: 9.0, 1: 10.0}


def test_compare_distributions_on_the_narrowed_route(spark, monkeypatch):
    from faretrace.operators import profile
    df = spark.createDataFrame([(float(i),) for i in range(50)], "fare double")
    want = sorted(map(tuple, profile.compare_distributions(df, "fare", "fare < 40").collect()))
    monkeypatch.setattr(profile, "quantiles_of", lambda t, f, by=(): quantiles.quantiles_of(t, f, by, limit=3))
    assert sorted(map(tuple, profile.compare_distributions(df, "fare", "fare < 40").collect())) == want

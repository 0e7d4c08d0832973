"""Windows, labels and the split of hot trajectories, against hand-made and pandas results."""

import math
import random
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, fare_obs
from faretrace.operators import features, profile, spikes
from faretrace.params import SWEEP_WINDOWS
from faretrace.plans.trajectory import Trajectory, hot_groups, on_trajectories
from faretrace.schema import MissingColumns
from faretrace.sources.ingest import clean

SCHEMA = "legId string, searchDate date, totalFare double"
DAY0 = date(2022, 5, 1)


def frame(spark, legs, shuffle=False):
    rows = [(leg, DAY0 + timedelta(days=i), None if v is None else float(v))
            for leg, values in legs.items() for i, v in enumerate(values)]
    if shuffle:
        random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name, leg="a"):
    return [r[name] for r in df.where(F.col("legId") == leg).orderBy("searchDate").collect()]


def labelled(df, window=5, min_periods=5, sigma=2.0, direction="up"):
    stats = spikes.add_rolling_stats(df, window=window, min_periods=min_periods)
    return spikes.label_spikes(stats, sigma=sigma, direction=direction)


def test_flat_window_then_jump(spark):
    out = labelled(frame(spark, {"a": [1, 1, 1, 1, 1, 9, 1]}))
    z = column(out, "spikeZ")
    assert z[:5] == [None] * 5
    assert z[5] == math.inf
    assert z[6] == pytest.approx(-0.4472, abs=1e-4)
    assert column(out, "isLabelable") == [False] * 6 + [True]
    assert column(out, "isSpike") == [False] * 7


def test_flat_window_without_jump_has_no_z(spark):
    assert column(labelled(frame(spark, {"a": [2] * 7})), "spikeZ") == [None] * 7


def test_min_periods_count_values_not_rows(spark):
    out = spikes.add_rolling_stats(frame(spark, {"a": [1, None, 3, 4, 5, 6, 7]}),
                                   window=3, min_periods=2)
    assert column(out, "rollMean") == [None, None, None, 2.0, 3.5, 4.0, 5.0]


def test_minimum_history(spark):
    out = labelled(frame(spark, {"a": [1], "b": [1, 2, 3, 4, 5], "c": [1, 2, 3, 4, 5, 6]}),
                   window=10)
    assert column(out, "isLabelable", "a") == [False]
    assert column(out, "isLabelable", "b") == [False] * 5
    assert column(out, "isLabelable", "c") == [False] * 5 + [True]


def test_interleaved_input_does_not_leak_between_legs(spark):
    legs = {"a": list(range(8)), "b": [100 + v for v in range(8)]}
    ordered, mixed = (spikes.add_rolling_stats(frame(spark, legs, s), window=3, min_periods=1)
                      for s in (False, True))
    for leg in legs:
        assert column(ordered, "rollMean", leg) == column(mixed, "rollMean", leg)
        assert column(mixed, "rollMean", leg)[0] is None


def test_run_of_three_is_one_event(spark):
    df = frame(spark, {"a": [0] * 5}).withColumns({
        "rollMean": F.lit(0.0), "rollStd": F.lit(1.0),
        "totalFare": F.when(F.day("searchDate").isin(2, 3, 4), 5.0).otherwise(0.0)})
    out = spikes.label_spikes(df, sigma=2.0, direction="up")
    assert column(out, "isSpike") == [False, True, True, True, False]
    assert column(out, "isSpikeEvent") == [False, True, False, False, False]


@pytest.mark.parametrize("direction,expected", [
    ("up", [True, False, False]), ("down", [False, True, False]), ("both", [True, True, False])])
def test_threshold_is_inclusive(spark, direction, expected):
    df = frame(spark, {"a": [14, 6, 13]}).withColumns(
        {"rollMean": F.lit(10.0), "rollStd": F.lit(2.0)})
    assert column(spikes.label_spikes(df, sigma=2.0, direction=direction), "isSpike") == expected


def test_unknown_direction_and_missing_baseline(spark):
    df = frame(spark, {"a": [1, 2]})
    with pytest.raises(MissingColumns, match="rollStd"):
        spikes.label_spikes(df)
    with pytest.raises(ValueError, match="direction"):
        labelled(df, direction="sideways").collect()


def test_sweep_min_periods_round_half_even():
    assert [spikes.sweep_min_periods(w) for w in SWEEP_WINDOWS] == [3, 3, 4, 5, 7, 10, 15]


def _random_legs(seed=11, legs=25):
    rng = random.Random(seed)
    out = {}
    for i in range(legs):
        fare, values = 100.0, []
        for _ in range(rng.choice([1, 2, 5, 6, 9, 33, 60])):
            if rng.random() < 0.35:
                fare = round(fare * rng.uniform(0.7, 1.5), 2)
            values.append(None if rng.random() < 0.05 else fare)
        out[f"leg{i}"] = values
    return out


def test_baseline_and_labels_match_pandas(spark):
    legs = _random_legs()
    got = labelled(frame(spark, legs, shuffle=True), window=10, min_periods=5).toPandas()
    got = got.sort_values(["legId", "searchDate"]).reset_index(drop=True)
    for leg, values in legs.items():
        s = pd.Series(values, dtype=float)
        mean, std = (getattr(s.rolling(10, min_periods=5), f)().shift(1) for f in ("mean", "std"))
        mine = got[got.legId == leg]
        np.testing.assert_allclose(mine.rollMean.astype(float), mean, atol=1e-9)
        np.testing.assert_allclose(mine.rollStd.astype(float), std, atol=1e-6)
        able = std > 1e-9
        hit = ((s - mean) / std >= 2.0) & able
        clear = ~(((s - mean) / std - 2.0).abs() < 1e-6)  # away from exact ties
        assert (mine.isSpike.to_numpy()[clear] == hit.to_numpy()[clear]).all()


def test_future_values_change_nothing_before_them(spark):
    legs = {"a": [10, 12, 11, 15, 9, 14, 20, 8, 13, 12, 11]}
    changed = {"a": legs["a"][:7] + [500, 1, 700, 2]}
    extra = {"seatsRemaining": F.lit(3), "flightDate": F.lit(date(2022, 7, 1))}

    def past(df):
        out = features.add_lagged_features(
            spikes.detect_spikes(df.withColumns(extra), params=replace(FIXTURE, min_periods=3)))
        kept = [c for c in out.columns if c not in ("totalFare", "spikeZ", "isSpike", "isSpikeEvent")]
        return out.where(F.col("searchDate") <= DAY0 + timedelta(days=7)).select(kept)

    a, b = (past(frame(spark, x)).orderBy("searchDate").collect() for x in (legs, changed))
    assert a == b


def _same_rows(left, right):
    cols = sorted(left.columns)
    assert cols == sorted(right.columns)
    assert dict(left.dtypes) == dict(right.dtypes)
    a, b = (sorted(map(repr, df.select([F.round(c, 9).alias(c) if t == "double" else F.col(c)
                                        for c, t in sorted(df.dtypes)]).collect()))
            for df in (left, right))
    assert a == b


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """A third of all rows in one trajectory, the rest as supplied."""
    obs = fare_obs(spark, sf).transform(clean)
    hot = obs.withColumn("legId", F.when(F.col("obsId") % 3 == 0, "hot").otherwise(F.col("legId")))
    return hot.cache()


CUT = replace(FARE_TRAJECTORY, hot_rows=40)


def test_hot_trajectories_are_found_and_small_inputs_not_probed(skewed):
    found = dict(hot_groups(skewed, CUT))
    assert found["hot"] == skewed.where("legId = 'hot'").count()
    assert hot_groups(skewed, replace(CUT, hot_rows=10**6)) == []


def test_split_trajectories_give_the_same_features(skewed):
    whole = features.observations_to_features(
        skewed, replace(FARE_TRAJECTORY, hot_rows=10**9), FIXTURE)
    _same_rows(whole, features.observations_to_features(skewed, CUT, FIXTURE))


@pytest.mark.parametrize("hot_rows", [7, 12, 40])
def test_block_edges_and_lookback_longer_than_a_block(skewed, hot_rows):
    traj = replace(CUT, hot_rows=hot_rows)
    whole = spikes.sweep_windows(skewed, replace(FARE_TRAJECTORY, hot_rows=10**9))
    _same_rows(whole, spikes.sweep_windows(skewed, traj))


def test_split_tables_agree(skewed):
    plain = replace(FARE_TRAJECTORY, hot_rows=10**9)
    for table in (profile.cadence_table, profile.cadence_summary, profile.step_profile,
                  profile.change_sizes, spikes.sigma_table):
        _same_rows(table(skewed, plain), table(skewed, CUT))
    _same_rows(features.sequence_windows(skewed, 6, plain), features.sequence_windows(skewed, 6, CUT))


def test_split_without_broadcasts(skewed, monkeypatch):
    from faretrace.plans import ordering
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 0)
    _same_rows(spikes.add_rolling_stats(skewed, replace(FARE_TRAJECTORY, hot_rows=10**9)),
               spikes.add_rolling_stats(skewed, CUT))


@pytest.mark.parametrize("hot_rows", [30, 10**9])
def test_rows_without_a_key_have_no_trajectory(spark, hot_rows):
    rows = [(None if i % 2 else f"l{i % 5}", DAY0 + timedelta(days=i), float(i % 13)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = spikes.detect_spikes(df, Trajectory(hot_rows=hot_rows)).collect()
    strays = [r for r in labelled if r["legId"] is None]
    assert len(strays) == 100 and not any(r["isLabelable"] or r["isSpike"] or r["isSpikeEvent"] for r in strays)
    assert all(r["rollMean"] is None and r["spikeZ"] is None for r in strays)
    _same_rows(df.where("legId IS NOT NULL").transform(spikes.detect_spikes, Trajectory(hot_rows=10**9)),
               spikes.detect_spikes(df, Trajectory(hot_rows=hot_rows)).where("legId IS NOT NULL"))


def test_one_exchange_and_one_sort_for_the_whole_feature_frame(spark, sf):
    obs = fare_obs(spark, sf).transform(clean)
    out = features.observations_to_features(obs, FARE_TRAJECTORY, FIXTURE)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_sequence_windows_keep_null_slots(spark):
    out = features.sequence_windows(frame(spark, {"a": [1, None, 3, 4]}), 2)
    got = [[x["totalFare"] for x in s] for s in column(out, "sequence")]
    assert got == [[1.0, None], [None, 3.0]]


def test_body_needs_the_order_columns(spark):
    with pytest.raises(MissingColumns):
        on_trajectories(spark.range(3), Trajectory(), lambda d, t: d, 1)

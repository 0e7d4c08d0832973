"""Scalar expressions, feature groups, the leakage guard and the design matrix."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, fare_obs
from faretrace.functions import frames, scalars
from faretrace.operators import features
from faretrace.params import DEFAULTS
from faretrace.schema import FEATURE_COLUMNS, FEATURE_GROUPS, LEAKY_COLUMNS, MODEL_COLUMNS
from faretrace.sources.ingest import clean


def apply(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", *[e("x").alias(f"c{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
    return [[r[f"c{k}"] for r in rows] for k in range(len(exprs))]


def test_durations(spark):
    [minutes] = apply(spark, ["PT5H", "PT47M", "P1DT2H30M", None, "bad", "PT8H47M"], "string",
                      scalars.duration_minutes)
    assert minutes == [300, 47, 150, 0, 0, 527]


def test_segments(spark):
    n, first, single = apply(spark, ["A||B", None, "A", "A||A||A"], "string",
                             scalars.segment_count, scalars.first_segment, scalars.single_valued)
    assert n == [2, 1, 1, 3]
    assert first == ["A", None, "A", "A"]
    assert single == [False, True, True, True]


def test_local_hour_ignores_the_offset(spark):
    hour, part, rank = apply(
        spark, ["2022-04-17T23:05:00.000-04:00||x", "2022-04-17T00:05:00.000-04:00", None, "junk"],
        "string", lambda c: F.expr(scalars.local_hour(c)), lambda c: scalars.daypart(scalars.local_hour(c)),
        lambda c: scalars.daypart_rank(scalars.local_hour(c)))
    assert hour == [23, 0, None, None]
    assert part == ["night", "red-eye", None, None]
    assert rank == [5, 0, None, None]


def test_dayparts_are_right_closed(spark):
    [part] = apply(spark, [5, 6, 8, 9, 12, 17, 21, 22], "int", scalars.daypart)
    assert part == ["red-eye", "early", "early", "morning", "morning", "afternoon", "evening", "night"]


def test_horizon_bins(spark):
    [label] = apply(spark, [0, 1, 3, 4, 45, 46, 61, 62, None], "int", scalars.horizon_bin)
    assert label == [None, "1-3", "1-3", "4-7", "31-45", "46-60", "46-60", None, None]


def test_nearest_holiday_sign_and_tie(spark):
    days = [date(2022, 6, 27), date(2022, 5, 28), date(2022, 9, 5), date(2022, 11, 19), None]
    [signed] = apply(spark, days, "date",
                     lambda c: scalars.days_to_nearest_holiday(c, DEFAULTS.holidays))
    assert signed == [7, -2, 0, 75, None]


def test_calendar(spark):
    df = spark.createDataFrame([(date(2022, 9, 4),), (date(2022, 9, 5),), (date(2022, 9, 6),), (None,)],
                               "flightDate date")
    rows = features.add_calendar_features(df).collect()
    assert [r["dayOfWeek"] for r in rows] == [6, 0, 1, None]
    assert [r["isWeekend"] for r in rows] == [True, False, False, False]
    assert [r["isHoliday"] for r in rows] == [False, True, False, False]
    assert [r["isSummerSeason"] for r in rows] == [True, True, False, False]
    assert [r["weekOfYear"] for r in rows] == [35, 36, 36, None]


def test_safe_ratio_and_z_follow_ansi(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], "d double, s double")
    got = df.selectExpr(f"{frames.ratio('d', 's')} AS r",
                        f"{frames.z_score('d', '0D', 's')} AS z").collect()
    assert [r["r"] for r in got] == [None, None, None, 1.5]
    assert [r["z"] for r in got] == [float("inf"), None, float("-inf"), 1.5]


def test_feature_catalog(spark):
    rows = {r["group"]: r["n"] for r in features.feature_catalog(spark).collect()}
    assert rows == {"temporal": 6, "calendar": 3, "itinerary": 8, "lagged": 12, "categorical": 3}
    assert len(FEATURE_COLUMNS) == len(set(FEATURE_COLUMNS)) == 32
    assert len(MODEL_COLUMNS) == 40
    assert features.feature_groups(spark).count() == 32


def test_leak_guard_fires_both_ways():
    features.assert_no_leaky_features(FEATURE_COLUMNS)
    for name in LEAKY_COLUMNS:
        with pytest.raises(features.LeakyFeatures, match=name):
            features.assert_no_leaky_features([*FEATURE_COLUMNS, name])


def test_lag_one_z_uses_the_baseline_of_the_row(spark):
    rows = [("a", date(2022, 5, 1) + timedelta(days=i), v, i, float(i + 1), 2.0 if i else 0.0)
            for i, v in enumerate([10.0, 14.0, 12.0, 20.0])]
    df = spark.createDataFrame(
        rows, "legId string, searchDate date, totalFare double, seatsRemaining int, rollMean double, rollStd double")
    got = features.add_lagged_features(df).orderBy("searchDate").collect()
    assert [r["zLag1"] for r in got] == [None, 4.0, 5.5, 4.0]
    assert [r["fareAccel"] for r in got] == [None, None, None, -6.0]
    assert [r["observationIndex"] for r in got] == [0, 1, 2, 3]
    assert [r["seatsChangeLag1"] for r in got] == [None, None, 1, 1]


def test_composed_and_single_pass_pipelines_agree(spark, sf):
    from faretrace.operators.spikes import add_days_before_departure, detect_spikes
    obs = fare_obs(spark, sf).transform(clean)
    steps = features.build_feature_frame(
        detect_spikes(add_days_before_departure(obs), FARE_TRAJECTORY, FIXTURE),
        FARE_TRAJECTORY, FIXTURE)
    single = features.observations_to_features(obs, FARE_TRAJECTORY, FIXTURE)
    assert set(steps.columns) == set(single.columns)
    assert steps.exceptAll(single.select(steps.columns)).count() == 0
    assert set(FEATURE_COLUMNS) <= set(single.columns)


@pytest.mark.parametrize("literal", [1_000, 1])
def test_encode(spark, monkeypatch, literal):
    monkeypatch.setattr(features, "LITERAL_DOMAIN", literal)
    df = spark.createDataFrame(
        [(1, "b", "night", True, 1.5), (2, "a", None, False, None), (3, None, "red-eye", None, 2.0),
         (4, "c", "early", True, 0.0)],
        "id int, airline string, departureTimeOfDay string, isNonStop boolean, x double")
    got = features.encode(df, ["airline", "departureTimeOfDay", "isNonStop", "x"]).orderBy("id").collect()
    assert [tuple(r[c] for c in df.columns[1:]) for r in got] == [
        (1.0, 5.0, 1.0, 1.5), (0.0, -1.0, 0.0, None), (-1.0, 0.0, -1.0, 2.0), (2.0, 1.0, 1.0, 0.0)]


def test_groups_cover_no_leaky_column():
    assert not LEAKY_COLUMNS & {c for names in FEATURE_GROUPS.values() for c in names}

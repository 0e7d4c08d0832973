"""Fold layout, embargo, leakage guards and fold tables."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from faretrace.operators import splits
from faretrace.schema import MissingColumns

D0 = date(2022, 5, 1)


def rows(spark, offsets, legs=None):
    data = [(f"l{legs[i] if legs else i}", D0 + timedelta(days=d), i % 4 == 0)
            for i, d in enumerate(offsets)]
    return spark.createDataFrame(data, "legId string, flightDate date, isSpikeEvent boolean")


def days(fold):
    return [(d - D0).days for d in fold.row()[1:]]


def test_windows_tile_the_end(spark):
    folds = splits.rolling_origin_splits(rows(spark, range(100)), 3, 10)
    assert [days(f) for f in folds] == [[0, 69, 70, 79], [0, 79, 80, 89], [0, 89, 90, 99]]
    assert [f.index for f in folds] == [1, 2, 3]


def test_sliding_window_and_gap(spark):
    folds = splits.rolling_origin_splits(rows(spark, range(100)), 2, 10, gap_days=3, train_days=20)
    assert [days(f) for f in folds] == [[57, 76, 80, 89], [67, 86, 90, 99]]


def test_train_window_is_clipped_at_the_start(spark):
    [first, _] = splits.rolling_origin_splits(rows(spark, range(60)), 2, 10, train_days=500)
    assert first.train_start == D0


def test_empty_windows_are_skipped_and_folds_renumbered(spark):
    offsets = [d for d in range(100) if not 80 <= d < 90]
    folds = splits.rolling_origin_splits(rows(spark, offsets), 3, 10)
    assert [f.index for f in folds] == [1, 2]
    assert days(folds[1]) == [0, 89, 90, 99]


def test_layout_errors(spark):
    df = rows(spark, range(40))
    with pytest.raises(ValueError, match="n_splits"):
        splits.rolling_origin_splits(df, 0)
    with pytest.raises(ValueError, match="min_train_days=30"):
        splits.rolling_origin_splits(df, 2, 10)
    with pytest.raises(MissingColumns):
        splits.rolling_origin_splits(df, 2, 10, date_col="nope")
    with pytest.raises(ValueError, match="no dates"):
        splits.rolling_origin_splits(df.where("false"), 1, 1)
    assert splits.rolling_origin_splits(df, 2, 5, min_train_days=30)
    with pytest.raises(ValueError, match="gap of 1"):
        splits.rolling_origin_splits(df, 2, 5, gap_days=1, min_train_days=30)


def test_timestamps_keep_their_last_day(spark):
    df = spark.createDataFrame([(D0 + timedelta(days=i),) for i in range(50)], "d date").select(
        (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")).alias("flightDate"))
    [fold] = splits.rolling_origin_splits(df, 1, 7)
    assert fold.n_test(df) == 7 and fold.n_train(df) == 43
    assert "test 2022-06-13..2022-06-19" in str(fold)


@pytest.mark.parametrize("fraction,cut", [(0.2, 8), (0.9, 0), (0.5, 5), (0.05, 9)])
def test_chronological_cut_truncates(spark, fraction, cut):
    fold = splits.chronological_split(rows(spark, range(10)), fraction)
    assert (fold.test_start - D0).days == cut
    assert (fold.train_end - D0).days == cut - 1
    assert fold.n_train(rows(spark, range(10))) == cut


def test_chronological_cut_is_on_distinct_dates(spark):
    fold = splits.chronological_split(rows(spark, [0] * 50 + list(range(1, 10))), 0.2, gap_days=2)
    assert days(fold) == [0, 5, 8, 9]
    with pytest.raises(ValueError, match="test_fraction"):
        splits.chronological_split(rows(spark, range(3)), 1.0)


def test_folds_are_disjoint_and_assignment_matches_the_filters(spark):
    rng = random.Random(2)
    df = rows(spark, [rng.randrange(90) for _ in range(400)])
    folds = splits.rolling_origin_splits(df, 3, 9)
    sides = splits.assign_folds(df, folds)
    for f in folds:
        assert f.train_end < f.test_start
        assert sides.where(f"fold = {f.index} AND side = 'train'").count() == f.n_train(df)
        assert sides.where(f"fold = {f.index} AND side = 'test'").count() == f.n_test(df)
    per_row = sides.where("side = 'test'").groupBy("legId").count().agg(F.max("count")).first()[0]
    assert per_row == 1


def test_leak_guard_fires_both_ways(spark):
    df = rows(spark, range(60))
    folds = splits.rolling_origin_splits(df, 2, 10)
    splits.assert_no_group_leakage(df, folds)
    spread = rows(spark, range(60), legs=[i % 7 for i in range(60)])
    with pytest.raises(splits.GroupLeakage, match=r"fold 1: 7 legId"):
        splits.assert_no_group_leakage(spread, folds)
    assert splits.shared_groups(spread, folds[0]).count() == 7
    assert splits.group_leakage(spread, folds[1]).first()["leaking_pct"] == 100.0


def test_describe_folds(spark):
    df = rows(spark, range(60), legs=[i // 2 for i in range(60)])
    folds = splits.rolling_origin_splits(df, 2, 10)
    one, two = splits.describe_folds(df, folds).orderBy("fold").collect()
    assert (one["train_rows"], one["test_rows"]) == (40, 10)
    assert (one["train_flights"], one["test_flights"]) == (20, 5)
    assert (one["test_positives"], one["test_pos_rate_pct"]) == (3, 30.0)
    assert two["train_rows"] == 50
    bare = splits.describe_folds(df, folds, label_col=None, group_col=None)
    assert "test_flights" not in bare.columns and "test_positives" not in bare.columns
    assert bare.orderBy("fold").first()["test_rows"] == 10


def test_fold_filter_reaches_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.to_date("o_orderdate").alias("flightDate"), "o_orderkey")
    path_plan = splits.Fold(1, D0, D0, D0, D0).test(orders)
    plan = path_plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_fold_filter_is_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(D0, 1)], "flightDate date, x int").write.parquet(path)
    fold = splits.Fold(1, D0, D0, D0, D0)
    plan = fold.test(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(flightDate" in pushed and "LessThanOrEqual(flightDate" in pushed

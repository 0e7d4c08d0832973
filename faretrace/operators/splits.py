"""Time-aware validation folds, as dates on the driver and filters on the cluster.

Folds are a handful of date intervals. Nothing per row is ever materialised for
them: membership is a range predicate that reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrace.functions.frames import ratio
from faretrace.functions.scalars import percent
from faretrace.schema import require_columns

FOLD_SCHEMA = ("fold int, train_start date, train_end date, test_start date, test_end date")


class GroupLeakage(AssertionError):
    """A trajectory sits on both sides of a fold."""


@dataclass(frozen=True)
class Fold:
    """One train/test division of a date axis; both intervals are inclusive."""

    index: int
    train_start: date
    train_end: date
    test_start: date
    test_end: date
    date_col: str = "flightDate"

    def in_train(self) -> str:
        """SQL condition on the date column."""
        return (f"to_date(`{self.date_col}`) BETWEEN DATE '{self.train_start}' "
                f"AND DATE '{self.train_end}'")

    def in_test(self) -> str:
        return (f"to_date(`{self.date_col}`) BETWEEN DATE '{self.test_start}' "
                f"AND DATE '{self.test_end}'")

    def train(self, df: DataFrame) -> DataFrame:
        """Training rows; a bare range filter, so Parquet row groups can be skipped."""
        return df.where(self.in_train())

    def test(self, df: DataFrame) -> DataFrame:
        return df.where(self.in_test())

    def n_train(self, df: DataFrame) -> int:
        return self.train(df).count()

    def n_test(self, df: DataFrame) -> int:
        return self.test(df).count()

    def row(self) -> tuple[int, date, date, date, date]:
        return (self.index, self.train_start, self.train_end, self.test_start, self.test_end)

    def __str__(self) -> str:
        return (f"fold {self.index}: train {self.train_start}..{self.train_end}, "
                f"test {self.test_start}..{self.test_end}")


def as_folds(folds: Fold | Sequence[Fold]) -> list[Fold]:
    return [folds] if isinstance(folds, Fold) else list(folds)


def rolling_origin_splits(df: DataFrame, n_splits: int = 5, test_days: int = 14,
                          date_col: str = "flightDate", gap_days: int = 0,
                          train_days: int | None = None,
                          min_train_days: int = 30) -> list[Fold]:
    """Walk-forward folds whose test windows tile the end of the period.

    ``train_days`` makes the training window slide instead of grow; ``gap_days``
    is an embargo before each test window. Windows without rows are left out and
    the remaining folds renumbered. One row of dates and flags reaches the driver,
    from one pass: the distinct dates are shuffled once and read twice.
    """
    if n_splits < 1:
        raise ValueError(f"n_splits={n_splits}: at least one fold is needed")
    require_columns(df, [date_col], "rolling_origin_splits")
    # the test on n keeps Catalyst from dropping the grouping, so both reads share its shuffle
    days = (df.select(F.to_date(date_col).alias("d")).where("d IS NOT NULL")
            .groupBy("d").agg(F.expr("count(1) AS n")).where("n > 0"))
    opens_at = [1 - (n_splits - k) * test_days for k in range(n_splits)]
    start, end, *filled = days.withColumn("hi", days.agg(F.max("d")).scalar()).agg(
        F.min("d"), F.max("d"), *[
            F.expr(f"bool_or(d BETWEEN date_add(hi, {at}) AND date_add(hi, {at + test_days - 1}))")
            for at in opens_at]).first()
    if start is None:
        raise ValueError("no dates to split")

    day = timedelta(days=1)
    _require_history(start, end + opens_at[0] * day, gap_days, min_train_days)

    def fold(index: int, opens: date) -> Fold:
        train_end = opens - (1 + gap_days) * day
        slid = start if train_days is None else max(start, train_end - (train_days - 1) * day)
        return Fold(index, slid, train_end, opens, min(opens + (test_days - 1) * day, end), date_col)

    starts = [end + at * day for at, any_rows in zip(opens_at, filled, strict=True) if any_rows]
    if not starts:
        raise ValueError("every test window is empty")
    return [fold(index, opens) for index, opens in enumerate(starts, 1)]


def _require_history(start: date, first_test: date, gap_days: int, least: int) -> None:
    days = (first_test - start).days - gap_days
    if days < least:
        raise ValueError(f"only {days} training days lie before the first fold with a gap of {gap_days}, "
                         f"fewer than min_train_days={least}")


def distinct_dates(df: DataFrame, date_col: str = "flightDate") -> DataFrame:
    return df.select(F.to_date(date_col).alias(date_col)).where(
        F.col(date_col).isNotNull()).distinct()


def chronological_split(df: DataFrame, test_fraction: float = 0.2,
                        date_col: str = "flightDate", gap_days: int = 0) -> Fold:
    """One cut at the (1 - test_fraction) point of the distinct dates."""
    if not 0 < test_fraction < 1:
        raise ValueError(f"test_fraction={test_fraction} is not strictly between 0 and 1")
    require_columns(df, [date_col], "chronological_split")
    days = distinct_dates(df, date_col)
    n, start, end = days.agg(F.count(F.lit(1)), F.min(date_col), F.max(date_col)).first()
    if not n:
        raise ValueError("no dates to split")
    at = int(n * (1 - test_fraction))  # truncation of the double product is intended
    cut = days.orderBy(date_col).offset(at).limit(1).first()[0]
    return Fold(1, start, cut - timedelta(days=1 + gap_days), cut, end, date_col)


def folds_frame(spark: SparkSession, folds: Fold | Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame([f.row() for f in as_folds(folds)], FOLD_SCHEMA)


def assign_folds(df: DataFrame, folds: Fold | Sequence[Fold]) -> DataFrame:
    """One output row per (row, fold, side) membership, with ``fold`` and ``side``.

    The folds become an array literal of at most two entries per fold, so the rows
    never move: no join, no shuffle.
    """
    sides = ", ".join(
        f"CASE WHEN {member} THEN struct({fold.index} AS fold, '{side}' AS side) END"
        for fold in as_folds(folds)
        for side, member in (("train", fold.in_train()), ("test", fold.in_test())))
    return df.select("*", F.expr(f"inline(array_compact(array({sides})))"))


def _per_group(df: DataFrame, folds: list[Fold], group_col: str,
               label: str | None = None) -> DataFrame:
    """One row per group with its train rows, test rows and test positives for every fold."""
    aggs = []
    for f in folds:
        aggs.append(f"count_if({f.in_train()}) AS tr{f.index}")
        aggs.append(f"count_if({f.in_test()}) AS te{f.index}")
        if label is not None:
            aggs.append(f"count_if({f.in_test()} AND {label}) AS po{f.index}")
    return df.groupBy(group_col).agg(*[F.expr(a) for a in aggs])


def group_leakage(df: DataFrame, folds: Fold | Sequence[Fold],
                  group_col: str = "legId") -> DataFrame:
    """Per fold: groups in the test part, groups also in training, and their share.

    One shuffle on the group serves all folds; rows are not multiplied by folds.
    """
    folds = as_folds(folds)
    rows = ", ".join(
        f"struct({f.index} AS fold, count_if(te{f.index} > 0) AS test_groups, "
        f"count_if(te{f.index} > 0 AND tr{f.index} > 0) AS leaking_groups)" for f in folds)
    per_group = _per_group(df, folds, group_col).where(F.col(group_col).isNotNull())
    return per_group.agg(F.expr(f"array({rows}) AS folds")).selectExpr("inline(folds)").withColumn(
        "leaking_pct", percent("leaking_groups", "test_groups", empty=0.0))


def shared_groups(df: DataFrame, fold: Fold, group_col: str = "legId") -> DataFrame:
    """Group keys present on both sides of one fold."""
    sides = df.groupBy(group_col).agg(F.expr(f"bool_or({fold.in_train()}) AS a"),
                                      F.expr(f"bool_or({fold.in_test()}) AS b"))
    return sides.where("a AND b").select(group_col)


def assert_no_group_leakage(df: DataFrame, folds: Fold | Sequence[Fold],
                            group_col: str = "legId") -> None:
    """Raise for the first fold with a group on both sides."""
    bad = (group_leakage(df, folds, group_col).where("leaking_groups > 0")
           .orderBy("fold").first())
    if bad is not None:
        raise GroupLeakage(f"fold {bad['fold']}: {bad['leaking_groups']} {group_col} value(s) "
                           "are in both train and test; split on the departure date")


def describe_folds(df: DataFrame, folds: Fold | Sequence[Fold],
                   label_col: str | None = "isSpikeEvent",
                   group_col: str | None = "legId") -> DataFrame:
    """Fold dates, sizes, distinct trajectories and test balance, one row per fold."""
    folds = as_folds(folds)
    label = None
    if label_col is not None and label_col in df.columns:
        label = f"CAST(`{label_col}` AS BOOLEAN)"
    if group_col is None:
        df, key = df.withColumn("__one", F.to_date(folds[0].date_col)), "__one"
    else:
        key = group_col
    per_group = _per_group(df, folds, key, label)

    names = ("fold", "train_start", "train_end", "test_start", "test_end")
    rows = []
    for f in folds:
        i, known = f.index, f"`{key}` IS NOT NULL"
        index, *dates = f.row()
        fields = [f"{index} AS fold", *[f"DATE '{d}' AS {n}"
                                        for n, d in zip(names[1:], dates, strict=True)]]
        fields += [f"sum(tr{i}) AS train_rows", f"sum(te{i}) AS test_rows"]
        if group_col is not None:
            fields += [f"count_if(tr{i} > 0 AND {known}) AS train_flights",
                       f"count_if(te{i} > 0 AND {known}) AS test_flights"]
        if label is not None:
            share = ratio(f"sum(po{i}) * 100D", f"sum(te{i})")
            fields += [f"sum(po{i}) AS test_positives",
                       f"bround({share}, 2) AS test_pos_rate_pct"]
        rows.append(f"struct({', '.join(fields)})")
    return per_group.agg(F.expr(f"array({', '.join(rows)}) AS folds")).selectExpr("inline(folds)")

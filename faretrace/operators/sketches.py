"""Mergeable daily summaries kept as a table: quantiles of a value and key sets. Any range of days is answered by merging them.

The facts are read once, when the table is made; its size is one sketch a (day, group), whatever the number of rows. A day is
added by appending its rows. Answers carry a stated error; ``exact_quantiles`` and ``group_leakage`` stay the exact way.
Intervals are tables (fold, side, start, end) as in ``asof.in_intervals``; they may overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.functions.scalars import percent
from faretrace.operators.asof import in_intervals
from faretrace.operators.splits import Fold, as_folds

#: size of a quantile sketch, and binary logarithm of the size of a key sketch
QUANTILE_SIZE, KEYS_LOG = 200, 12


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """Share of ranks that a quantile is off, which 99 of 100 quantiles keep to; fixed values of the published sketch."""
    return 2.296 / size ** 0.9021


def daily_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), day: str = "flightDate", size: int = QUANTILE_SIZE) -> DataFrame:
    """(*by, day, sketch) of every day; rows without a day or a value are in no sketch. Partial sketches are merged, so a
    day or group with most of the rows is summed where its rows lie."""
    return (df.where(F.col(day).isNotNull() & F.col(value).isNotNull())
            .groupBy(*by, F.to_date(day).alias("day"))
            .agg(F.expr(f"kll_sketch_agg_double(CAST(`{value}` AS DOUBLE), {size})").alias("sketch")))


def quantiles_between(sketches: DataFrame, intervals: DataFrame, fractions: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(fold, side, *by, n, one column a fraction) of each interval that holds rows. ``n`` is exact; a quantile is a value
    that occurs, and its rank is off by ``rank_error`` of the sketches' size."""
    merged = (in_intervals(sketches, intervals, "day").groupBy("fold", "side", *by)
              .agg(F.expr("kll_merge_agg_double(sketch)").alias("merged")))
    return merged.select("fold", "side", *by, F.expr("kll_sketch_get_n_double(merged)").alias("n"), *(
        F.expr(f"kll_sketch_get_quantile_double(merged, {float(f)!r}D)").alias(name) for name, f in fractions.items()))


def daily_keys(df: DataFrame, key: str = "legId", day: str = "flightDate", log_size: int = KEYS_LOG) -> DataFrame:
    """(day, keys) of every day; rows without a day or a key are in no sketch."""
    return (df.where(F.col(day).isNotNull() & F.col(key).isNotNull()).groupBy(F.to_date(day).alias("day"))
            .agg(F.expr(f"theta_sketch_agg(CAST(`{key}` AS STRING), {log_size})").alias("keys")))


def fold_intervals(df: DataFrame, folds: Fold | Sequence[Fold]) -> DataFrame:
    """The two sides of each fold as intervals, in the session of ``df``."""
    rows = [(f.row()[0], side, start, end) for f in as_folds(folds)
            for side, start, end in (("train", *f.row()[1:3]), ("test", *f.row()[3:5]))]
    return df.sparkSession.createDataFrame(rows, "fold int, side string, start date, end date")


def leakage_estimates(sketches: DataFrame, intervals: DataFrame, log_size: int = KEYS_LOG) -> DataFrame:
    """(fold, test_groups, leaking_groups, leaking_pct, error_groups) of intervals with sides 'train' and 'test'.

    ``error_groups`` bounds both estimates by three standard errors of the larger side's sketch; sides of at most
    2 ** log_size keys are counted exactly, and it is 0. A fold without test rows is absent.
    """
    sides = (in_intervals(sketches, intervals, "day").groupBy("fold", "side")
             .agg(F.expr(f"theta_union_agg(keys, {log_size})").alias("merged"))
             .groupBy("fold").agg(*(F.expr(f"max(CASE WHEN side = '{s}' THEN merged END) AS {s}") for s in ("train", "test"))))
    counted = sides.where("test IS NOT NULL").select(
        "fold", F.expr("theta_sketch_estimate(test)").alias("test_groups"),
        F.expr("coalesce(CASE WHEN train IS NOT NULL THEN theta_sketch_estimate(theta_intersection(train, test)) END, 0L)").alias("leaking_groups"),
        F.expr("greatest(theta_sketch_estimate(test), theta_sketch_estimate(train))").alias("larger"))
    size = 1 << log_size
    return counted.withColumn("leaking_pct", percent("leaking_groups", "test_groups", empty=0.0)).selectExpr(
        "fold", "test_groups", "leaking_groups", "leaking_pct",
        f"CASE WHEN larger <= {size} THEN 0D ELSE 3 * larger / sqrt({size}D) END AS error_groups")

"""Seasonal ARIMA with regressors on the daily mean fare of every route, fold by fold.

Two stages of least squares (Hannan and Rissanen): a long autoregression gives first innovations, then the series is
regressed on its own lags, the innovations' lags and the regressors. Both stages are normal equations summed by (fold, route)
in one aggregate; coefficients are shared by the routes of a fold, each route has its own level. One-step forecasts
come from the innovations recursion along each route, over training and test days.

A step is a row of the daily series, as in the other forecasters: a date without a fare is no step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretrace.functions import scalars
from faretrace.operators.profile import series_lags
from faretrace.operators.splits import Fold
from faretrace.params import DEFAULTS, Params
from faretrace.session import ship_package

DAY = "flightDate"
REGRESSORS = ("isHoliday", "isSummerSeason")
#: added to the diagonal of normal equations, as a share of it: a regressor that never changes gets no weight
RIDGE = 1e-9


@dataclass(frozen=True)
class Order:
    """Lags of the autoregressive and moving-average terms, lags that are subtracted first, and the length of the first
    stage's autoregression."""

    ar: tuple[int, ...] = (1, 7)
    ma: tuple[int, ...] = (1, 7)
    differences: tuple[int, ...] = ()
    first_stage: int = 8

    def lags(self) -> range:
        return range(1, max(self.first_stage, *self.ar, *self.ma) + 1)


def difference_weights(differences: Sequence[int]) -> dict[int, float]:
    """{lag: weight} of the series after all differences; lag 0 has weight 1."""
    weights = {0: 1.0}
    for d in differences:
        weights = reduce(lambda w, kv: w | {kv[0] + d: w.get(kv[0] + d, 0.0) - kv[1]}, weights.items(), dict(weights))
    return {k: v for k, v in weights.items() if v}


def series(df: DataFrame, order: Order = Order(), params: Params = DEFAULTS) -> DataFrame:
    """(route, date, mean_fare, base, w, w1, w2, ..., regressors): ``w`` is the differenced series, ``base`` what was
    subtracted, NULL where history is missing."""
    weights = difference_weights(order.differences)
    back = [k for k in weights if k]
    daily = series_lags(df, back) if back else series_lags(df, (1,)).drop("lag1")
    base = reduce(lambda a, k: a - F.lit(weights[k]) * F.col(f"lag{k}"), back, F.lit(0.0))
    along = Window.partitionBy("route").orderBy(DAY)
    out = daily.withColumn("base", base).withColumn("w", F.col("mean_fare") - F.col("base"))
    return out.select(
        "route", DAY, "mean_fare", "base", "w", *(F.lag("w", k).over(along).alias(f"w{k}") for k in order.lags()),
        scalars.is_holiday(DAY, params.holidays).cast("double").alias("isHoliday"),
        scalars.in_season(DAY, params.season_start, params.season_end).cast("double").alias("isSummerSeason"))


def _by_fold(frame: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """A row once for each fold that it trains or tests, with ``train``."""
    ways = ", ".join(f"CASE WHEN {f.in_train()} THEN struct({f.index} AS fold, true AS train) "
                     f"WHEN {f.in_test()} THEN struct({f.index} AS fold, false AS train) END" for f in folds)
    return frame.withColumn("way", F.expr(f"explode(filter(array({ways}), x -> x IS NOT NULL))")).select("way.*", *frame.columns)


def _moments(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Sums and sums of products of target and inputs, one row a (fold, route); incomplete rows are left out."""
    z = ["w", *inputs]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(z) for b in z[i:]]
    return (rows.where("train").dropna(subset=z).groupBy("fold", "route")
            .agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in z), *products))


def _coefficients(moments: DataFrame, inputs: Sequence[str]) -> dict[int, list[float]]:
    """{fold: coefficients}: products around each route's means, summed over routes; one row a fold reaches the driver."""
    z = ["w", *inputs]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    around = [F.sum(F.expr(f"{z[i]}_x_{z[j]} - sum_{z[i]} * sum_{z[j]} / n")).alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for row in moments.groupBy("fold").agg(*around).collect():
        full = np.zeros((len(z), len(z)))
        for i, j in pairs:
            full[i, j] = full[j, i] = row[f"c{i}_{j}"]
        inner = full[1:, 1:]
        inner = inner + np.diag(RIDGE * np.maximum(np.diag(inner), 1.0))
        out[row["fold"]] = np.linalg.solve(inner, full[0, 1:]).tolist()
    return out


def _fitted(moments: DataFrame, inputs: Sequence[str]) -> tuple[DataFrame, dict[int, list[float]]]:
    """(fold, route, level) and the coefficients of each fold."""
    known = _coefficients(moments, inputs)
    explained = reduce(lambda a, c: a + c, (_weight(known, i) * F.col(f"sum_{c}") for i, c in enumerate(inputs)), F.lit(0.0))
    return moments.select("fold", "route", ((F.col("sum_w") - explained) / F.col("n")).alias("level")), known


def _weight(known: dict[int, list[float]], i: int) -> F.Column:
    """The i-th coefficient of a row's fold."""
    return reduce(lambda c, fold: c.when(F.col("fold") == fold, F.lit(known[fold][i])), known, F.when(F.lit(False), F.lit(0.0)))


def forecasts(df: DataFrame, folds: Sequence[Fold], order: Order = Order(), params: Params = DEFAULTS) -> DataFrame:
    """(fold, route, date, mean_fare, forecast): one-step forecasts of the test days of every fold; NULL where a route has no
    complete training day or not enough history. A route's days go through one task: they are a calendar."""
    ship_package(df.sparkSession)
    rows = _by_fold(series(df, order, params), folds)
    first_inputs = [*(f"w{k}" for k in range(1, order.first_stage + 1)), *REGRESSORS]
    levels, known = _fitted(_moments(rows, first_inputs), first_inputs)
    along = Window.partitionBy("fold", "route").orderBy(DAY)
    rows = rows.join(levels, ["fold", "route"], "left")
    guess = reduce(lambda a, c: a + c, (_weight(known, i) * F.col(c) for i, c in enumerate(first_inputs)), F.col("level"))
    rows = rows.withColumn("e", F.col("w") - guess).drop("level")
    rows = rows.select("*", *(F.lag("e", k).over(along).alias(f"e{k}") for k in order.ma))
    inputs = [*(f"w{k}" for k in order.ar), *(f"e{k}" for k in order.ma), *REGRESSORS]
    levels, known = _fitted(_moments(rows, inputs), inputs)
    wanted = rows.join(levels, ["fold", "route"], "left").select(
        "fold", "route", "train", DAY, "mean_fare", "base", "w", "level", *(f"w{k}" for k in order.ar), *REGRESSORS)
    n_ar, ma = len(order.ar), order.ma

    def recur(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values(DAY)
        beta = known.get(int(days["fold"].iloc[0]))
        given = days[[*(f"w{k}" for k in order.ar), *REGRESSORS]].to_numpy(float)
        level, w = days["level"].to_numpy(float), days["w"].to_numpy(float)
        out, innovations = np.full(len(days), np.nan), np.zeros(len(days))
        if beta is not None:
            plain = level + given @ np.array([*beta[:n_ar], *beta[n_ar + len(ma):]])
            for t in range(len(days)):
                out[t] = plain[t] + sum(b * innovations[t - k] for b, k in zip(beta[n_ar:], ma) if t >= k)
                innovations[t] = 0.0 if np.isnan(out[t] + w[t]) else w[t] - out[t]
        days["forecast"] = out + days["base"].to_numpy(float)
        return days.loc[~days["train"].to_numpy(bool), ["fold", "route", DAY, "mean_fare", "forecast"]]

    schema = f"fold int, route string, {DAY} date, mean_fare double, forecast double"
    done = wanted.groupBy("fold", "route").applyInPandas(recur, schema)
    return done.withColumn("forecast", F.nanvl("forecast", F.lit(None).cast("double")))

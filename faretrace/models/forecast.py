"""Fare-level forecasters on the daily series and on trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, OneHotEncoder, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.functions import scalars
from faretrace.models.scoring import regression_errors
from faretrace.operators.profile import series_lags
from faretrace.operators.splits import Fold
from faretrace.params import DEFAULTS, Params

#: trajectory forecasts that need no fitting: model name to forecast column
BASELINES = {"last_fare": "fareLag1", "rolling_mean": "rollMean", "drift": "driftForecast"}


def seasonal_naive(df: DataFrame, season: int = 7) -> DataFrame:
    """Daily mean fare per route with the value one season (in rows) earlier as forecast."""
    return series_lags(df, (season,)).withColumnRenamed(f"lag{season}", "forecast")


def autoregression_frame(df: DataFrame, params: Params = DEFAULTS,
                         lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    """Daily series, its lags and the calendar regressors; complete rows only."""
    day = "flightDate"
    frame = series_lags(df, lags).withColumns({
        "isHoliday": scalars.is_holiday(day, params.holidays).cast("double"),
        "isSummerSeason": scalars.in_season(
            day, params.season_start, params.season_end).cast("double"),
    })
    return frame.dropna(subset=[f"lag{k}" for k in lags])


def autoregression_forecast(df: DataFrame, fold: Fold, params: Params = DEFAULTS,
                            lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    """Least-squares autoregression with calendar regressors and a level per route.

    Fitted on the fold's training dates, one-step forecasts on its test dates; NULL
    forecasts if no training row is complete. One route needs no level of its own.
    """
    frame = autoregression_frame(df, params, lags)
    inputs = [*[f"lag{k}" for k in lags], "isHoliday", "isSummerSeason"]
    routes = fold.train(frame).select("route").distinct().count()
    if not routes:
        return fold.test(frame).select("route", "flightDate", "mean_fare",
                                       F.lit(None).cast("double").alias("forecast"))
    levels = [
        StringIndexer(inputCol="route", outputCol="routeIndex", handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="routeIndex", outputCol="routeFlags"),
    ] if routes > 1 else []
    model = Pipeline(stages=[
        *levels,
        VectorAssembler(inputCols=[*inputs, *(["routeFlags"] if levels else [])], outputCol="inputs"),
        LinearRegression(featuresCol="inputs", labelCol="mean_fare", predictionCol="forecast",
                         regParam=1e-6, solver="normal"),
    ]).fit(fold.train(frame))
    return model.transform(fold.test(frame)).select("route", "flightDate", "mean_fare", "forecast")


def baseline_scores(features: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """RMSE and MAE of the no-fit trajectory forecasts on every fold's test rows.

    (fold, model, rows, rmse, mae) from one scan: rows carry their forecasts as an
    array that is unpacked after the fold filter.
    """
    withdrift = features.withColumn("driftForecast", F.col("fareLag1") + F.col("fareChangeLag1"))
    in_fold = " ".join(f"WHEN {f.in_test()} THEN {f.index}" for f in folds)
    forecasts = ", ".join(f"struct('{model}' AS model, {column} AS forecast)"
                          for model, column in BASELINES.items())
    long = withdrift.withColumn("fold", F.expr(f"CASE {in_fold} END")).where(
        "fold IS NOT NULL").selectExpr("totalFare", "fold", f"inline(array({forecasts}))")
    return regression_errors(long, "totalFare", "forecast", ["fold", "model"])

"""Trajectory windows on both adapters."""

from pyspark.sql import functions as F

from faretrace.fixtures import FARE_TRAJECTORY, PRICE_TRAJECTORY, fare_obs, price_obs
from faretrace.functions import frames
from faretrace.operators import profile, spikes
from faretrace.plans.trajectory import on_trajectories
from registry.core import features, labelled, observations, query, sql

KEY = ["legId", "obsId"]


@query("w1_rolling_mean", sql("SELECT legId, obsId, rollMean FROM stats"), doubles="rollMean")
def _(spark, sf):
    return spikes.add_rolling_stats(observations(spark, sf), FARE_TRAJECTORY).select(
        *KEY, "rollMean")


@query("w2_rolling_std", sql("SELECT legId, obsId, rollStd FROM stats"), doubles="rollStd")
def _(spark, sf):
    return spikes.add_rolling_stats(observations(spark, sf), FARE_TRAJECTORY).select(
        *KEY, "rollStd")


PRICE_FRAME = ("PARTITION BY legId ORDER BY shipTs, orderKey, lineNumber, suppKey "
               "ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING")


@query("w1_w2_rolling_price", sql(f"""
SELECT orderKey, lineNumber, legId, suppKey,
 CASE WHEN count(totalFare) OVER f >= 5 THEN avg(totalFare) OVER f END AS rollMean,
 CASE WHEN count(totalFare) OVER f >= 5 THEN stddev_samp(totalFare) OVER f END AS rollStd
FROM price WINDOW f AS ({PRICE_FRAME.format(10)})"""), doubles="rollMean rollStd")
def _(spark, sf):
    return spikes.add_rolling_stats(price_obs(spark, sf), PRICE_TRAJECTORY).select(
        "orderKey", "lineNumber", "legId", "suppKey", "rollMean", "rollStd")


@query("w3_min_periods_gate", sql("""
SELECT legId, obsId, CASE WHEN count(d) OVER f >= 4 THEN avg(d) OVER f END AS rollMean
FROM (SELECT *, totalTravelDistance + totalFare AS d FROM obs) AS t
WINDOW f AS (PARTITION BY legId ORDER BY searchTs, obsId ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""),
    doubles="rollMean")
def _(spark, sf):
    gappy = observations(spark, sf).withColumn("d", F.col("totalTravelDistance") + F.col("totalFare"))
    return spikes.add_rolling_stats(gappy, FARE_TRAJECTORY, window=4, min_periods=4,
                                    value="d").select(*KEY, "rollMean")


def _lagged(name, columns, doubles):
    @query(name, sql(f"SELECT legId, obsId, {', '.join(columns)} FROM feat"), doubles=doubles)
    def _(spark, sf):
        return features(spark, sf).select(*KEY, *columns)


_lagged("w4_fare_lags", ["fareLag1", "fareLag2", "fareLag3"], "fareLag1 fareLag2 fareLag3")
_lagged("w5_fare_momentum", ["fareChangeLag1", "fareChangeLag2", "fareAccel"],
        "fareChangeLag1 fareChangeLag2 fareAccel")
_lagged("w6_z_lag", ["zLag1"], "zLag1")
_lagged("w7_seat_lags", ["seatsRemainingLag1", "seatsChangeLag1"], "")
_lagged("w8_observation_index", ["observationIndex"], "")
_lagged("w9_roll_std_ratio", ["rollStdRatio"], "rollStdRatio")


@query("w10_run_starts", sql("SELECT legId, obsId, isSpike, isSpikeEvent FROM labelled"))
def _(spark, sf):
    return labelled(spark, sf).select(*KEY, "isSpike", "isSpikeEvent")


@query("w11_cadence_gap", sql("""
SELECT legId, obsId, CAST(datediff('day', lag(searchDate) OVER w, searchDate) AS INTEGER) AS gap
FROM fare WINDOW w AS (PARTITION BY legId ORDER BY searchTs, obsId)"""))
def _(spark, sf):
    return on_trajectories(
        fare_obs(spark, sf), FARE_TRAJECTORY,
        lambda d, t: d.withColumn("gap", frames.gap_days("searchDate", t.over())), 1,
    ).select(*KEY, "gap")


@query("w12_fare_change", sql("""
SELECT legId, change AS fare_change FROM (
 SELECT legId, totalFare - lag(totalFare) OVER (PARTITION BY legId ORDER BY shipTs, orderKey, lineNumber, suppKey) AS change
 FROM price) AS t WHERE change IS NOT NULL"""), doubles="fare_change")
def _(spark, sf):
    return profile.fare_changes(price_obs(spark, sf), PRICE_TRAJECTORY)


DAILY = ("daily", "SELECT flightDate, route, avg(totalFare) AS mean_fare FROM coach GROUP BY 1, 2")


@query("w13_series_lags", sql("""
SELECT flightDate, route, mean_fare, lag(mean_fare, 1) OVER w AS lag1, lag(mean_fare, 7) OVER w AS lag7,
 lag(mean_fare, 14) OVER w AS lag14
FROM daily WINDOW w AS (PARTITION BY route ORDER BY flightDate)""", DAILY),
    doubles="mean_fare lag1 lag7 lag14")
def _(spark, sf):
    return profile.series_lags(observations(spark, sf))


@query("w14_duplicate_rows", sql("""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM fare GROUP BY legId, searchDate) AS t"""))
def _(spark, sf):
    return profile.duplicate_keys(fare_obs(spark, sf))

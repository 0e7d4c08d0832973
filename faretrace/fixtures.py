"""Adapters that give the supplied tables the shape of fare observations.

The text is plain SQL that Spark and other engines read alike, so the oracle
queries start from the same rows.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from faretrace.params import DEFAULTS
from faretrace.plans.trajectory import Trajectory

FARE_OBS_SQL = """
SELECT CAST(user_id AS STRING) AS legId, event_id AS obsId, ts AS searchTs, CAST(ts AS DATE) AS searchDate,
 CAST(DATE '2024-01-15' + CAST(user_id * 7 % 41 AS INT) AS DATE) AS flightDate,
 CASE user_id % 4 WHEN 0 THEN 'JFK' WHEN 1 THEN 'LAX' WHEN 2 THEN 'BOS' ELSE 'LGA' END AS startingAirport,
 CASE user_id % 4 WHEN 0 THEN 'LAX' WHEN 1 THEN 'JFK' WHEN 2 THEN 'LGA' ELSE 'BOS' END AS destinationAirport,
 CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'PT5H' WHEN 2 THEN 'PT47M' WHEN 3 THEN 'P1DT2H30M' ELSE concat('PT', CAST(user_id % 11 + 1 AS STRING), 'H', CAST(user_id % 60 AS STRING), 'M') END AS travelDuration,
 CAST(user_id % 2 AS INT) AS elapsedDays, user_id % 4 = 1 AS isBasicEconomy, user_id % 29 = 0 AS isRefundable, user_id % 3 = 0 AS isNonStop,
 value * CAST(0.875 AS DOUBLE) AS baseFare, value AS totalFare, CAST(event_id % 10 AS INT) AS seatsRemaining,
 CASE WHEN event_id % 160 = 0 THEN NULL ELSE CAST(200 + user_id % 50 * 50 AS DOUBLE) END AS totalTravelDistance,
 concat(CAST(CAST(DATE '2024-01-15' + CAST(user_id * 7 % 41 AS INT) AS DATE) AS STRING), 'T', lpad(CAST(user_id % 24 AS STRING), 2, '0'), ':30:00.000-05:00') AS segmentsDepartureTimeRaw,
 CASE WHEN user_id % 37 = 14 THEN NULL WHEN user_id % 3 = 0 THEN concat('Air ', CAST(user_id % 5 AS STRING)) WHEN user_id % 3 = 1 THEN concat('Air ', CAST(user_id % 5 AS STRING), '||Air ', CAST(user_id % 5 AS STRING)) ELSE concat('Air ', CAST(user_id % 5 AS STRING), '||Air ', CAST((user_id + 1) % 5 AS STRING)) END AS segmentsAirlineName,
 CASE WHEN user_id % 13 = 12 THEN 'business' WHEN user_id % 13 = 11 THEN 'coach||business' WHEN user_id % 3 = 0 THEN 'coach' ELSE 'coach||coach' END AS segmentsCabinCode
FROM {events}
WHERE CAST(ts AS DATE) < CAST(DATE '2024-01-15' + CAST(user_id * 7 % 41 AS INT) AS DATE)
"""

PRICE_OBS_SQL = """
SELECT l_partkey AS legId, CAST(l_shipdate AS DATE) AS searchDate, l_shipdate AS shipTs,
 l_orderkey AS orderKey, l_linenumber AS lineNumber, l_suppkey AS suppKey,
 l_extendedprice AS totalFare, CAST(l_quantity AS INT) AS seatsRemaining,
 concat(l_returnflag, '-', l_linestatus) AS route
FROM {lineitem}
"""

FARE_TRAJECTORY = Trajectory("legId", "searchTs", ("obsId",))
PRICE_TRAJECTORY = Trajectory("legId", "shipTs", ("orderKey", "lineNumber", "suppKey"))

#: the study's parameters moved to the dates of the supplied tables
FIXTURE = replace(
    DEFAULTS,
    search_start=date(2024, 1, 1), search_end=date(2024, 2, 5),
    flight_start=date(2024, 1, 15), flight_end=date(2024, 2, 24),
    full_trajectory_end=date(2024, 2, 6), probe_date=date(2024, 2, 14),
    holidays=(date(2024, 1, 15), date(2024, 1, 29), date(2024, 2, 19)),
    season_start=date(2024, 1, 20), season_end=date(2024, 2, 10),
    n_splits=3, test_days=7, min_train_days=14, min_route_rows=500,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fare_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FARE_OBS_SQL, events=table(spark, sf_dir, "events"))


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRICE_OBS_SQL, lineitem=table(spark, sf_dir, "lineitem"))

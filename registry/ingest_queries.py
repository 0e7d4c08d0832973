"""Sources, population filters and reports on the supplied tables."""

from datetime import date

from faretrace.fixtures import FIXTURE, fare_obs, table
from faretrace.models.boosting import before_test, route_sizes
from faretrace.operators import profile
from faretrace.operators.splits import Fold
from faretrace.sources import ingest
from registry.core import CUTOFF, labelled, model_rows, observations, query, sql


@query("s1_extract_routes", sql(
    "SELECT legId, obsId, totalFare FROM fare WHERE startingAirport || destinationAirport IN ('JFKLAX', 'BOSLGA')"),
    doubles="totalFare")
def _(spark, sf):
    return ingest.on_routes(fare_obs(spark, sf), ("JFK-LAX", "BOS-LGA")).select(
        "legId", "obsId", "totalFare")


@query("s2_row_count_report", sql(
    "SELECT count(*) AS rows, CAST(2156316 AS BIGINT) AS expected, count(*) = 2156316 AS as_expected FROM fare"))
def _(spark, sf):
    return ingest.row_count_report(fare_obs(spark, sf))


@query("s6_category_domain", sql("""
SELECT column_name, value, count(*) AS rows FROM (
 SELECT 'startingAirport' AS column_name, startingAirport AS value FROM fare
 UNION ALL SELECT 'segmentsAirlineName', segmentsAirlineName FROM fare
 UNION ALL SELECT 'segmentsCabinCode', segmentsCabinCode FROM fare) AS u
WHERE value IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    return ingest.category_domain(
        fare_obs(spark, sf), ["startingAirport", "segmentsAirlineName", "segmentsCabinCode"])


@query("s8_parquet_source",
       "SELECT user_id, event_id, value FROM events WHERE value > 50", doubles="value")
def _(spark, sf):
    return ingest.read_stage(spark, f"{sf}/events.parquet", ["user_id", "event_id", "value"]) \
        .where("value > 50")


@query("s11_clean_observations", sql("SELECT legId, obsId, route, segmentsCabinCode FROM coach"))
def _(spark, sf):
    return fare_obs(spark, sf).transform(ingest.clean).select(
        "legId", "obsId", "route", "segmentsCabinCode")


@query("s12_shape", sql("SELECT count(*) AS rows, CAST(19 AS BIGINT) AS columns FROM fare"))
def _(spark, sf):
    return ingest.shape(fare_obs(spark, sf))


@query("p1_filter_coach_only", sql("SELECT legId, obsId, segmentsCabinCode, totalFare FROM coach"),
       doubles="totalFare")
def _(spark, sf):
    return ingest.filter_coach_only(fare_obs(spark, sf)).select(
        "legId", "obsId", "segmentsCabinCode", "totalFare")


@query("p2_removed_rows", sql("""
SELECT n AS before, k AS after, n - k AS removed, 100.0 * CAST(n - k AS DOUBLE) / n AS removed_pct
FROM (SELECT count(*) AS n, (SELECT count(*) FROM coach) AS k FROM fare) AS c"""),
    doubles="removed_pct")
def _(spark, sf):
    return ingest.coach_filter_report(fare_obs(spark, sf))


@query("p3_add_route", sql(
    "SELECT legId, obsId, startingAirport || '-' || destinationAirport AS route FROM fare"))
def _(spark, sf):
    return ingest.add_route(fare_obs(spark, sf)).select("legId", "obsId", "route")


@query("p4_days_before_departure", sql("SELECT legId, obsId, daysBeforeDeparture FROM obs"))
def _(spark, sf):
    return observations(spark, sf).select("legId", "obsId", "daysBeforeDeparture")


@query("p5_censoring_cutoff", sql(
    f"SELECT legId, obsId, flightDate FROM coach WHERE flightDate <= {CUTOFF}"))
def _(spark, sf):
    cleaned = fare_obs(spark, sf).transform(ingest.clean)
    return ingest.departing_by(cleaned, FIXTURE.full_trajectory_end).select(
        "legId", "obsId", "flightDate")


@query("p6_labelable_rows", sql("SELECT legId, obsId, spikeZ FROM labelled WHERE isLabelable"),
       doubles="spikeZ")
def _(spark, sf):
    return labelled(spark, sf).where("isLabelable").select("legId", "obsId", "spikeZ")


@query("p7_holiday_band", sql("""
SELECT legId, obsId, daysToNearestHoliday FROM feat WHERE daysToNearestHoliday BETWEEN -3 AND 3"""))
def _(spark, sf):
    from registry.core import features
    return profile.near_holiday(features(spark, sf), band=3).select(
        "legId", "obsId", "daysToNearestHoliday")


LONG_SQL = """SELECT legId FROM fare GROUP BY legId HAVING count(DISTINCT searchDate) >= 25"""


@query("p8_long_trajectories", sql(LONG_SQL))
def _(spark, sf):
    return profile.long_trajectories(fare_obs(spark, sf), at_least=25)


@query("j1_semi_join_keys", sql(
    f"SELECT legId, obsId, totalFare FROM fare WHERE legId IN ({LONG_SQL})"), doubles="totalFare")
def _(spark, sf):
    obs = fare_obs(spark, sf)
    return profile.keep_groups(obs, profile.long_trajectories(obs, at_least=25)).select(
        "legId", "obsId", "totalFare")


@query("p9_route_training_slice", sql("""
SELECT route, count(*) AS rows FROM model WHERE flightDate < DATE '2024-02-04'
GROUP BY route HAVING count(*) >= 500"""))
def _(spark, sf):
    fold = Fold(1, date(2024, 1, 1), date(2024, 2, 3), date(2024, 2, 4), date(2024, 2, 17))
    return route_sizes(before_test(model_rows(spark, sf), fold), FIXTURE.min_route_rows)


@query("j5_aligned_summaries", """
SELECT p_brand AS value, count(*) AS rows, 100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM part) AS share_pct
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""", doubles="share_pct")
def _(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), "p_brand")

"""Calendar and itinerary expressions, feature groups and the design matrix."""

from pyspark.sql import functions as F

from faretrace.fixtures import FIXTURE, table
from faretrace.functions import scalars
from faretrace.operators import asof, features as feats
from faretrace.schema import FEATURE_GROUPS
from registry.core import (
    DAYPART_CASE, HORIZON_CASE, HORIZON_RANK_CASE, features, model_rows, observations, query, sql,
)

KEY = ["legId", "obsId"]


def _itinerary(name, column, doubles=""):
    @query(name, sql(f"SELECT legId, obsId, {column} FROM feat"), doubles=doubles)
    def _(spark, sf):
        return observations(spark, sf).transform(feats.add_itinerary_features).select(*KEY, column)


def _calendar(name, column):
    @query(name, sql(f"SELECT legId, obsId, {column} FROM feat"))
    def _(spark, sf):
        return feats.add_calendar_features(observations(spark, sf), FIXTURE).select(*KEY, column)


_itinerary("f1_travel_duration", "travelDurationMinutes", "travelDurationMinutes")
_calendar("f2_day_of_week", "dayOfWeek")
_calendar("f3_is_weekend", "isWeekend")
_calendar("f4_month", "month")
_calendar("f5_week_of_year", "weekOfYear")
_calendar("f6_is_holiday", "isHoliday")
_calendar("f7_days_to_nearest_holiday", "daysToNearestHoliday")
_calendar("f8_is_summer_season", "isSummerSeason")
_itinerary("f9_segment_count", "nSegments")
_itinerary("f10_airline", "airline")
_itinerary("f11_single_carrier", "isSingleCarrier")
_itinerary("f12_departure_hour", "departureHour")
_itinerary("f13_departure_time_of_day", "departureTimeOfDay")


@query("j3_nearest_holiday_orders", """
SELECT o_orderkey, CAST(delta AS INTEGER) AS delta FROM (
 SELECT o_orderkey, datediff('day', h, CAST(o_orderdate AS DATE)) AS delta,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(datediff('day', h, CAST(o_orderdate AS DATE))), h) AS rn
 FROM orders, (VALUES (DATE '1994-07-04'), (DATE '1995-12-25'), (DATE '1996-05-27'), (DATE '1997-01-01')) AS t(h)) AS r
WHERE rn = 1""")
def _(spark, sf):
    from datetime import date
    days = [date(1994, 7, 4), date(1995, 12, 25), date(1996, 5, 27), date(1997, 1, 1)]
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.days_to_nearest_holiday("to_date(o_orderdate)", days).alias("delta"))


@query("j4_holiday_membership", sql(
    "SELECT legId, obsId, flightDate FROM obs WHERE flightDate IN (SELECT h FROM holidays)"))
def _(spark, sf):
    return observations(spark, sf).where(
        scalars.is_holiday("flightDate", FIXTURE.holidays)).select(*KEY, "flightDate")


@query("f14_horizon_bin", sql(f"""
SELECT legId, obsId, {HORIZON_CASE.format('daysBeforeDeparture')} AS horizon,
 CAST({HORIZON_RANK_CASE.format('daysBeforeDeparture')} AS INTEGER) AS horizon_rank FROM obs"""))
def _(spark, sf):
    days = "daysBeforeDeparture"
    return observations(spark, sf).select(
        *KEY, scalars.horizon_bin(days).alias("horizon"),
        scalars.horizon_rank(days).alias("horizon_rank"))


@query("f15_date_parts", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS month,
 CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS INTEGER) AS days_left FROM orders""")
def _(spark, sf):
    day = "to_date(o_orderdate)"
    return table(spark, sf, "orders").select(
        "o_orderkey", F.expr(day).alias("day"), scalars.month_key(day).alias("month"),
        scalars.days_between("DATE '1998-12-31'", day).alias("days_left"))


@query("f16_zero_as_null", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem""",
    doubles="ratio")
def _(spark, sf):
    from faretrace.functions.frames import ratio
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        f"{ratio('l_extendedprice', 'l_discount')} AS ratio")


@query("f17_half_even_rounding", """
SELECT p_partkey, round_even(CAST(p_size AS DOUBLE) / 2, 0) AS halves FROM part""", doubles="halves")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", scalars.half_even("p_size / 2D", 0).alias("halves"))


CALENDAR = ["dayOfWeek", "isWeekend", "month", "weekOfYear", "isHoliday", "daysToNearestHoliday",
            "isSummerSeason"]
ITINERARY = ["nSegments", "airline", "isSingleCarrier", "departureHour", "departureTimeOfDay",
             "travelDurationMinutes"]
LAGGED_DOUBLES = ("fareLag1 fareLag2 fareLag3 fareChangeLag1 fareChangeLag2 fareAccel zLag1 "
                  "rollMean rollStd rollStdRatio")


@query("e1_calendar_features", sql(f"SELECT legId, obsId, {', '.join(CALENDAR)} FROM feat"))
def _(spark, sf):
    return feats.add_calendar_features(observations(spark, sf), FIXTURE).select(*KEY, *CALENDAR)


@query("e2_itinerary_features", sql(f"SELECT legId, obsId, {', '.join(ITINERARY)} FROM feat"),
       doubles="travelDurationMinutes")
def _(spark, sf):
    return feats.add_itinerary_features(observations(spark, sf)).select(*KEY, *ITINERARY)


@query("e3_lagged_features", sql(
    f"SELECT legId, obsId, observationIndex, {', '.join(FEATURE_GROUPS['lagged'])} FROM feat"),
    doubles=LAGGED_DOUBLES)
def _(spark, sf):
    return features(spark, sf).select(*KEY, "observationIndex", *FEATURE_GROUPS["lagged"])


@query("e4_feature_frame", sql(f"""
SELECT legId, obsId, route, daysBeforeDeparture, isNonStop, isBasicEconomy, isRefundable, totalTravelDistance,
 {', '.join(CALENDAR)}, {', '.join(ITINERARY)}, observationIndex, {', '.join(FEATURE_GROUPS['lagged'])},
 isSpike, isSpikeEvent, totalFare FROM model"""),
    doubles=LAGGED_DOUBLES + " totalTravelDistance travelDurationMinutes totalFare")
def _(spark, sf):
    return model_rows(spark, sf).select(
        *KEY, "route", "daysBeforeDeparture", "isNonStop", "isBasicEconomy", "isRefundable",
        "totalTravelDistance", *CALENDAR, *ITINERARY, "observationIndex",
        *FEATURE_GROUPS["lagged"], "isSpike", "isSpikeEvent", "totalFare")


DAYPART_CODE = DAYPART_CASE
for _i, _name in enumerate(("red-eye", "early", "morning", "afternoon", "evening", "night")):
    DAYPART_CODE = DAYPART_CODE.replace(f"'{_name}'", str(_i))


@query("e7_encoded_design", sql(f"""
SELECT m.legId, obsId, CAST(r.code AS DOUBLE) AS route, CAST(coalesce(a.code, -1) AS DOUBLE) AS airline,
 CAST(coalesce({DAYPART_CODE}, -1) AS DOUBLE) AS departureTimeOfDay,
 CAST(CAST(isNonStop AS INTEGER) AS DOUBLE) AS isNonStop, CAST(daysBeforeDeparture AS DOUBLE) AS daysBeforeDeparture
FROM model AS m
LEFT JOIN (SELECT route, dense_rank() OVER (ORDER BY route) - 1 AS code FROM (SELECT DISTINCT route FROM model) AS x) AS r ON r.route = m.route
LEFT JOIN (SELECT airline, dense_rank() OVER (ORDER BY airline) - 1 AS code FROM (SELECT DISTINCT airline FROM model WHERE airline IS NOT NULL) AS y) AS a ON a.airline = m.airline"""),
    doubles="route airline departureTimeOfDay isNonStop daysBeforeDeparture")
def _(spark, sf):
    wanted = ["route", "airline", "departureTimeOfDay", "isNonStop", "daysBeforeDeparture"]
    design = feats.encode(model_rows(spark, sf), wanted)
    return design.select(*KEY, *[F.col(c).cast("double").alias(c) for c in wanted])


@query("m13_sequence_windows", sql("""
SELECT legId, obsId, CAST(10 AS INTEGER) AS length,
 first_value(totalFare) OVER f AS oldest, last_value(totalFare) OVER f AS newest, s AS total
FROM (SELECT *, count(*) OVER g AS n, sum(totalFare) OVER g AS s FROM obs
 WINDOW g AS (PARTITION BY legId ORDER BY searchTs, obsId ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS t
WINDOW f AS (PARTITION BY legId ORDER BY searchTs, obsId ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
QUALIFY n = 10"""), doubles="oldest newest total")
def _(spark, sf):
    from faretrace.fixtures import FARE_TRAJECTORY
    return feats.sequence_windows(observations(spark, sf), 10, FARE_TRAJECTORY).selectExpr(
        *KEY, "size(sequence) AS length", "get(sequence.totalFare, 0) AS oldest",
        "get(sequence.totalFare, 9) AS newest",
        "aggregate(sequence.totalFare, 0D, (a, x) -> a + x) AS total")


# ---- events and intervals as tables --------------------------------------


@query("j3_asof_events", """
WITH rows AS (SELECT l_orderkey AS orderKey, l_linenumber AS lineNumber, CAST(l_shipdate AS DATE) AS day FROM lineitem),
events AS (SELECT DISTINCT o_orderkey % 7 + 1 AS market, CAST(o_orderdate AS DATE) AS at FROM orders),
past AS (SELECT r.*, e.at AS last_at FROM rows AS r ASOF LEFT JOIN events AS e ON r.lineNumber = e.market AND r.day >= e.at),
onward AS (SELECT p.*, e.at AS next_at FROM past AS p ASOF LEFT JOIN events AS e ON p.lineNumber = e.market AND p.day <= e.at)
SELECT orderKey, lineNumber, day, last_at, next_at, CAST(CASE WHEN last_at IS NULL OR next_at - day < day - last_at THEN day - next_at
 ELSE day - last_at END AS INTEGER) AS days_to_nearest FROM onward""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS orderKey", "l_linenumber AS lineNumber", "CAST(l_shipdate AS DATE) AS day")
    events = table(spark, sf, "orders").selectExpr("o_orderkey % 7 + 1 AS market", "CAST(o_orderdate AS DATE) AS at")
    found = asof.with_events(rows, events, "day", "at", ["lineNumber"], ["market"])
    return found.selectExpr("orderKey", "lineNumber", "day", "last_event.day AS last_at", "next_event.day AS next_at",
                            f"{asof.days_to_nearest('day')} AS days_to_nearest")


@query("j2_interval_counts", """
WITH folds AS (SELECT p_partkey AS fold, DATE '1992-01-01' + CAST(p_partkey * 13 % 2400 AS INTEGER) AS s, CAST(p_size AS INTEGER) AS w FROM part),
i AS (SELECT fold, 'train' AS side, s AS a, s + 3 * w AS b FROM folds UNION ALL SELECT fold, 'test', s + 3 * w + 1, s + 4 * w FROM folds)
SELECT fold, side, count(l_orderkey) AS rows, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS positives
FROM i LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) BETWEEN a AND b GROUP BY fold, side""")
def _(spark, sf):
    folds = table(spark, sf, "part").selectExpr(
        "p_partkey AS fold", "CAST(DATE'1992-01-01' + CAST(p_partkey * 13 % 2400 AS INT) AS DATE) AS s", "CAST(p_size AS INT) AS w")
    intervals = folds.selectExpr("fold", """inline(array(struct('train' AS side, s AS start, date_add(s, 3 * w) AS end),
        struct('test' AS side, date_add(s, 3 * w + 1) AS start, date_add(s, 4 * w) AS end)))""")
    lines = table(spark, sf, "lineitem").selectExpr("CAST(l_shipdate AS DATE) AS day", "l_returnflag = 'R' AS flag")
    return asof.interval_counts(lines, intervals, "day", "flag")

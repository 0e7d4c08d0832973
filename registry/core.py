"""Registration helper, shared frames and the shared SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretrace.fixtures import FARE_OBS_SQL, FARE_TRAJECTORY, FIXTURE, PRICE_OBS_SQL, fare_obs
from faretrace.operators.features import observations_to_features
from faretrace.operators.spikes import add_days_before_departure, detect_spikes
from faretrace.sources.ingest import clean

Query = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
#: moves rounding ties off short decimals: a mean of cents may end in exactly ...5
NUDGE = "1.7e-7"


def rounded(df: DataFrame) -> DataFrame:
    """Engines differ in the last bits of a double; compare six decimals."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({
        c: F.expr(f"round(`{c}` + {NUDGE}D, {DIGITS}) + 0D") for c in doubles})


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query; ``doubles`` names the SQL columns to round like Spark's."""

    def register(fn: Query) -> Query:
        if name in SPARK:
            raise ValueError(f"query {name} registered twice")
        SPARK[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = _with_rounding(sql, doubles.split())
        return fn

    return register


def _with_rounding(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    parts = ", ".join(f'(round("{c}" + CAST({NUDGE} AS DOUBLE), {DIGITS}) + CAST(0 AS DOUBLE)) AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({parts}) FROM (\n{sql}\n) AS q"


# ---- frames --------------------------------------------------------------


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coach observations with route and booking horizon."""
    return fare_obs(spark, sf_dir).transform(clean).transform(add_days_before_departure)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_spikes(observations(spark, sf_dir), FARE_TRAJECTORY, FIXTURE)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = fare_obs(spark, sf_dir).transform(clean)
    return observations_to_features(cleaned, FARE_TRAJECTORY, FIXTURE)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where("isLabelable")


# ---- SQL building blocks -------------------------------------------------

P = FIXTURE
CUTOFF = f"DATE '{P.full_trajectory_end}'"
_COACH = ", ".join(f"'{c}'" for c in P.coach_codes)
_HOLIDAYS = ", ".join(f"(DATE '{h}')" for h in P.holidays)
HORIZON_CASE = ("CASE WHEN {0} > 0 AND {0} <= 3 THEN '1-3' WHEN {0} > 3 AND {0} <= 7 THEN '4-7' "
                "WHEN {0} > 7 AND {0} <= 14 THEN '8-14' WHEN {0} > 14 AND {0} <= 21 THEN '15-21' "
                "WHEN {0} > 21 AND {0} <= 30 THEN '22-30' WHEN {0} > 30 AND {0} <= 45 THEN '31-45' "
                "WHEN {0} > 45 AND {0} <= 61 THEN '46-60' END")
HORIZON_RANK_CASE = ("CASE WHEN {0} > 0 AND {0} <= 3 THEN 0 WHEN {0} > 3 AND {0} <= 7 THEN 1 "
                     "WHEN {0} > 7 AND {0} <= 14 THEN 2 WHEN {0} > 14 AND {0} <= 21 THEN 3 "
                     "WHEN {0} > 21 AND {0} <= 30 THEN 4 WHEN {0} > 30 AND {0} <= 45 THEN 5 "
                     "WHEN {0} > 45 AND {0} <= 61 THEN 6 END")
DAYPART_CASE = ("CASE WHEN departureHour > -1 AND departureHour <= 5 THEN 'red-eye' "
                "WHEN departureHour <= 8 THEN 'early' WHEN departureHour <= 12 THEN 'morning' "
                "WHEN departureHour <= 17 THEN 'afternoon' WHEN departureHour <= 21 THEN 'evening' "
                "WHEN departureHour <= 24 THEN 'night' END")

CTES = {
    "fare": FARE_OBS_SQL.format(events="events"),
    "coach": f"""SELECT *, startingAirport || '-' || destinationAirport AS route
 FROM fare WHERE segmentsCabinCode IN ({_COACH})""",
    "obs": "SELECT *, CAST(datediff('day', searchDate, flightDate) AS INTEGER) AS daysBeforeDeparture FROM coach",
    "stats": f"""SELECT *,
 CASE WHEN count(totalFare) OVER f >= {P.min_periods} THEN avg(totalFare) OVER f END AS rollMean,
 CASE WHEN count(totalFare) OVER f >= {P.min_periods} THEN stddev_samp(totalFare) OVER f END AS rollStd
 FROM obs WINDOW f AS (PARTITION BY legId ORDER BY searchTs, obsId ROWS BETWEEN {P.window} PRECEDING AND 1 PRECEDING)""",
    "scored": """SELECT *, coalesce(rollStd > 0, false) AS isLabelable,
 CASE WHEN rollStd = 0 THEN CASE WHEN totalFare > rollMean THEN CAST('inf' AS DOUBLE) WHEN totalFare < rollMean THEN CAST('-inf' AS DOUBLE) END
 ELSE (totalFare - rollMean) / rollStd END AS spikeZ FROM stats""",
    "state": f"SELECT *, coalesce(isLabelable AND spikeZ >= {P.sigma}, false) AS isSpike FROM scored",
    "labelled": """SELECT *, isSpike AND NOT lag(isSpike, 1, false) OVER (PARTITION BY legId ORDER BY searchTs, obsId) AS isSpikeEvent
 FROM state""",
    "holidays": f"SELECT h FROM (VALUES {_HOLIDAYS}) AS t(h)",
    "nearest": """SELECT d, CAST(delta AS INTEGER) AS delta FROM (
 SELECT d, datediff('day', h, d) AS delta, row_number() OVER (PARTITION BY d ORDER BY abs(datediff('day', h, d)), h) AS rn
 FROM (SELECT DISTINCT flightDate AS d FROM fare) AS days CROSS JOIN holidays) AS r WHERE rn = 1""",
    "lagged": """SELECT *, lag(totalFare, 1) OVER w AS fareLag1, lag(totalFare, 2) OVER w AS fareLag2, lag(totalFare, 3) OVER w AS fareLag3,
 lag(seatsRemaining, 1) OVER w AS seatsRemainingLag1, lag(seatsRemaining, 2) OVER w AS seatsLag2,
 row_number() OVER w - 1 AS observationIndex
 FROM labelled WINDOW w AS (PARTITION BY legId ORDER BY searchTs, obsId)""",
    "feat": f"""SELECT l.*, CAST(isodow(flightDate) - 1 AS INTEGER) AS dayOfWeek, isodow(flightDate) >= 6 AS isWeekend,
 CAST(month(flightDate) AS INTEGER) AS month, CAST(weekofyear(flightDate) AS INTEGER) AS weekOfYear,
 flightDate IN (SELECT h FROM holidays) AS isHoliday, n.delta AS daysToNearestHoliday,
 flightDate BETWEEN DATE '{P.season_start}' AND DATE '{P.season_end}' AS isSummerSeason,
 CAST(coalesce(len(string_split(segmentsAirlineName, '||')), 1) AS INTEGER) AS nSegments,
 CASE WHEN segmentsAirlineName IS NOT NULL THEN split_part(segmentsAirlineName, '||', 1) END AS airline,
 coalesce(list_unique(string_split(segmentsAirlineName, '||')) = 1, true) AS isSingleCarrier,
 TRY_CAST(substr(segmentsDepartureTimeRaw, 12, 2) AS INTEGER) AS departureHour,
 {DAYPART_CASE.replace('departureHour', 'TRY_CAST(substr(segmentsDepartureTimeRaw, 12, 2) AS INTEGER)')} AS departureTimeOfDay,
 coalesce(TRY_CAST(regexp_extract(travelDuration, '(\\d+)H', 1) AS DOUBLE), 0) * 60
  + coalesce(TRY_CAST(regexp_extract(travelDuration, '(\\d+)M', 1) AS DOUBLE), 0) AS travelDurationMinutes,
 fareLag1 - fareLag2 AS fareChangeLag1, fareLag2 - fareLag3 AS fareChangeLag2,
 (fareLag1 - fareLag2) - (fareLag2 - fareLag3) AS fareAccel,
 (fareLag1 - rollMean) / nullif(rollStd, 0) AS zLag1, seatsRemainingLag1 - seatsLag2 AS seatsChangeLag1,
 rollStd / nullif(rollMean, 0) AS rollStdRatio
 FROM lagged AS l LEFT JOIN nearest AS n ON n.d = l.flightDate""",
    "model": "SELECT * FROM feat WHERE isLabelable",
    "price": PRICE_OBS_SQL.format(lineitem="lineitem"),
}


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` behind the CTEs it (transitively) mentions; ``extra`` adds its own."""
    own = dict(extra)
    everything = {**CTES, **own}
    wanted: list[str] = []

    def visit(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name, definition in everything.items():
            if name in words and name not in wanted:
                wanted.append(name)
                visit(definition)

    visit(body)
    if not wanted:
        return body
    ordered = [n for n in everything if n in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({everything[n]})" for n in ordered) + "\n" + body

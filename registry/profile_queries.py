"""Audits and profiles on the supplied tables."""

from pyspark.sql import functions as F

from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, PRICE_TRAJECTORY, fare_obs, price_obs, table
from faretrace.operators import profile
from faretrace.params import ROUTES
from faretrace.schema import FEATURE_GROUPS, MODELLING_COLUMNS
from faretrace.sources.ingest import is_coach
from registry.core import (
    CUTOFF, HORIZON_CASE, HORIZON_RANK_CASE, features, labelled, model_rows, observations, query,
    sql,
)

STATS = "mean std min q25 q50 q75 max"


def describe_sql(value: str, source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,
 quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max
FROM (SELECT {lead}CAST({value} AS DOUBLE) AS v FROM {source} ) AS t {group}"""


@query("a1_describe_fare", sql(describe_sql("totalFare", "fare ")), doubles=STATS)
def _(spark, sf):
    return profile.describe(fare_obs(spark, sf), "totalFare")


@query("a1_describe_price_by_flag", describe_sql("l_extendedprice", "lineitem", "l_returnflag"),
       doubles=STATS)
def _(spark, sf):
    return profile.describe(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("a2_before_after", sql(f"""
SELECT b.statistic, b.x AS before, a.x AS after, a.x - b.x AS change FROM
 (UNPIVOT (SELECT CAST(count AS DOUBLE) AS count, mean, std, min, q25, q50, q75, max FROM ({describe_sql('totalFare', 'fare ')}) AS s) ON COLUMNS(*) INTO NAME statistic VALUE x) AS b
 JOIN (UNPIVOT (SELECT CAST(count AS DOUBLE) AS count, mean, std, min, q25, q50, q75, max FROM ({describe_sql('totalFare', 'coach ')}) AS s) ON COLUMNS(*) INTO NAME statistic VALUE x) AS a
 ON a.statistic = b.statistic"""), doubles="before after change")
def _(spark, sf):
    return profile.compare_distributions(fare_obs(spark, sf), "totalFare", is_coach())


@query("a3_cabin_counts", sql("""
SELECT segmentsCabinCode AS value, count(*) AS rows, 100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fare) AS share_pct
FROM fare WHERE segmentsCabinCode IS NOT NULL GROUP BY 1"""), doubles="share_pct")
def _(spark, sf):
    return profile.value_counts(fare_obs(spark, sf), "segmentsCabinCode")


@query("o3_top_dates", sql("""
SELECT searchDate AS value, count(*) AS rows, 100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fare) AS share_pct
FROM fare GROUP BY 1 ORDER BY rows DESC, value LIMIT 12"""), doubles="share_pct")
def _(spark, sf):
    return profile.value_counts(fare_obs(spark, sf), "searchDate", top=12)


@query("a4_cabin_split", sql("""
SELECT k AS members, n - k AS others, 100.0 * CAST(k AS DOUBLE) / n AS member_pct,
 100.0 * CAST(n - k AS DOUBLE) / n AS other_pct, d AS distinct_codes
FROM (SELECT count(*) AS n, count(DISTINCT segmentsCabinCode) AS d, (SELECT count(*) FROM coach) AS k FROM fare) AS c"""),
    doubles="member_pct other_pct")
def _(spark, sf):
    return profile.class_split(fare_obs(spark, sf), is_coach(), "segmentsCabinCode")


GROUP_SUMMARY = """SELECT {0}, count({1}) AS rows, avg({1}) AS mean, quantile_cont({1}, 0.5) AS median,
 stddev_samp({1}) AS std, min({1}) AS min, max({1}) AS max FROM {2} WHERE {0} IS NOT NULL GROUP BY {0}"""


@query("a5_route_summary", sql(GROUP_SUMMARY.format("route", "totalFare", "coach")),
       doubles="mean median std min max")
def _(spark, sf):
    return profile.group_summary(observations(spark, sf), "route", "totalFare")


@query("o2_segment_summary", GROUP_SUMMARY.format("c_mktsegment", "c_acctbal", "customer"),
       doubles="mean median std min max")
def _(spark, sf):
    return profile.group_summary(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


_NULL_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS total FROM fare"
    for c in MODELLING_COLUMNS)


@query("a6_null_audit", sql(f"""
SELECT column_name, nulls, 100.0 * CAST(nulls AS DOUBLE) / total AS share_pct FROM ({_NULL_COUNTS}) AS u WHERE nulls > 0"""),
    doubles="share_pct")
def _(spark, sf):
    return profile.null_audit(fare_obs(spark, sf), MODELLING_COLUMNS)


@query("a7_null_audit_by_route", sql("""
SELECT route, 100.0 * CAST(count(*) FILTER (WHERE travelDuration IS NULL) AS DOUBLE) / count(*) AS "travelDuration_null_pct",
 100.0 * CAST(count(*) FILTER (WHERE totalTravelDistance IS NULL) AS DOUBLE) / count(*) AS "totalTravelDistance_null_pct"
FROM coach GROUP BY route"""), doubles="travelDuration_null_pct totalTravelDistance_null_pct")
def _(spark, sf):
    return profile.null_audit_by(observations(spark, sf), "route",
                                 ["travelDuration", "totalTravelDistance"])


@query("a8_coverage_bounds", sql(f"""
SELECT *, DATE '{FIXTURE.search_start}' AS search_min_expected, DATE '{FIXTURE.search_end}' AS search_max_expected,
 DATE '{FIXTURE.flight_start}' AS flight_min_expected, DATE '{FIXTURE.flight_end}' AS flight_max_expected,
 CAST(datediff('day', search_max, flight_max) AS INTEGER) AS overhang_days
FROM (SELECT min(searchDate) AS search_min, max(searchDate) AS search_max, min(flightDate) AS flight_min,
 max(flightDate) AS flight_max FROM coach) AS b"""))
def _(spark, sf):
    return profile.coverage_bounds(observations(spark, sf), FIXTURE)


@query("a9_rows_by_month", sql("""
SELECT strftime(flightDate, '%Y-%m') AS month, count(*) AS rows,
 100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM coach) AS share_pct FROM coach GROUP BY 1"""),
    doubles="share_pct")
def _(spark, sf):
    return profile.rows_by_month(observations(spark, sf))


@query("a10_horizon_describe", sql(describe_sql("daysBeforeDeparture", "obs ")), doubles=STATS)
def _(spark, sf):
    return profile.describe(observations(spark, sf), "daysBeforeDeparture")


@query("a11_point_date_count", sql(
    f"SELECT count(*) AS rows FROM coach WHERE flightDate = DATE '{FIXTURE.probe_date}'"))
def _(spark, sf):
    return profile.rows_on(observations(spark, sf), FIXTURE.probe_date)


@query("a12_censoring_by_month", sql("""
SELECT strftime(flightDate, '%Y-%m') AS month, count(*) AS rows, min(daysBeforeDeparture) AS closest_to_departure,
 max(daysBeforeDeparture) AS furthest_from_departure FROM obs GROUP BY 1"""))
def _(spark, sf):
    return profile.censoring_by_month(observations(spark, sf))


CLOSEST = ("closest", "SELECT flightDate, min(daysBeforeDeparture) AS near, count(*) AS n FROM obs GROUP BY 1")


@query("a13_closest_observation", sql("""
SELECT count(*) AS dates, count(*) FILTER (WHERE near > 7) AS censored_dates,
 100.0 * CAST(count(*) FILTER (WHERE near > 7) AS DOUBLE) / count(*) AS censored_pct,
 min(flightDate) FILTER (WHERE near > 7) AS first_censored FROM closest""", CLOSEST),
    doubles="censored_pct")
def _(spark, sf):
    return profile.censoring_summary(observations(spark, sf))


@query("a14_cutoff_report", sql(f"""
SELECT {CUTOFF} AS cutoff, edge AS derived_cutoff, CAST(sum(n) AS BIGINT) AS rows,
 CAST(sum(n) FILTER (WHERE flightDate <= {CUTOFF}) AS BIGINT) AS retained,
 100.0 * CAST(sum(n) FILTER (WHERE flightDate <= {CUTOFF}) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS retained_pct,
 CAST(sum(n) FILTER (WHERE flightDate <= edge) AS BIGINT) AS derived_retained
FROM closest, (SELECT max(flightDate) AS edge FROM closest WHERE flightDate < (SELECT min(flightDate) FROM closest WHERE near > 7)) AS e
GROUP BY edge""", CLOSEST), doubles="retained_pct")
def _(spark, sf):
    return profile.cutoff_report(observations(spark, sf), FIXTURE)


def crosstab_sql(key: str, source: str, where: str = "true") -> str:
    cols = ", ".join(f"avg(totalFare) FILTER (WHERE route = '{r}') AS {r.replace('-', '_')}"
                     for r in ROUTES)
    return f"SELECT {key}, {cols} FROM {source} WHERE {where} GROUP BY {key}"


ROUTE_NAMES = " ".join(r.replace("-", "_") for r in ROUTES)


@query("a15_daily_mean_by_route", sql(crosstab_sql("flightDate", "coach")), doubles=ROUTE_NAMES)
def _(spark, sf):
    return profile.daily_mean_by_route(observations(spark, sf))


DAILY = ("daily", "SELECT flightDate, route, avg(totalFare) AS mean_fare FROM coach GROUP BY 1, 2")


@query("a16_autocorrelation", sql("""
SELECT route, lag_1, lag_7, lag_14, lag_7 > lag_1 AS weekly_dominant FROM (
SELECT route, CASE WHEN count(lag1) > 1 THEN corr(mean_fare, lag1) END AS lag_1,
 CASE WHEN count(lag7) > 1 THEN corr(mean_fare, lag7) END AS lag_7,
 CASE WHEN count(lag14) > 1 THEN corr(mean_fare, lag14) END AS lag_14
FROM (SELECT *, lag(mean_fare, 1) OVER w AS lag1, lag(mean_fare, 7) OVER w AS lag7, lag(mean_fare, 14) OVER w AS lag14
 FROM daily WINDOW w AS (PARTITION BY route ORDER BY flightDate)) AS s GROUP BY route) AS c""", DAILY),
    doubles="lag_1 lag_7 lag_14")
def _(spark, sf):
    return profile.autocorrelation(observations(spark, sf))


@query("a17_trajectory_contract", sql("""
SELECT count(*) AS trajectories, count(*) FILTER (WHERE d > 1) AS recurring,
 100.0 * CAST(count(*) FILTER (WHERE d > 1) AS DOUBLE) / count(*) AS recurring_pct,
 count(*) FILTER (WHERE f > 1) AS spanning_departures
FROM (SELECT legId, count(DISTINCT searchDate) AS d, count(DISTINCT flightDate) AS f FROM fare GROUP BY 1) AS t"""),
    doubles="recurring_pct")
def _(spark, sf):
    return profile.trajectory_contract(fare_obs(spark, sf))


@query("a18_duplicate_key_count", sql("""
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM price GROUP BY legId, searchDate) AS t"""))
def _(spark, sf):
    return profile.duplicate_keys(price_obs(spark, sf))


_LENGTHS = " UNION ALL ".join(f"""SELECT CAST({n} AS INTEGER) AS observations, count(*) FILTER (WHERE d >= {n}) AS flights_with_at_least,
 100.0 * CAST(count(*) FILTER (WHERE d >= {n}) AS DOUBLE) / count(*) AS share_pct FROM lengths"""
                              for n in (5, 10, 15, 20, 30, 40, 60))


@query("a19_length_coverage", sql(_LENGTHS, (
    "lengths", "SELECT legId, count(DISTINCT searchDate) AS d FROM fare GROUP BY 1")),
    doubles="share_pct")
def _(spark, sf):
    return profile.length_coverage(fare_obs(spark, sf))


GAPS = ("gaps", """SELECT datediff('day', lag(searchDate) OVER w, searchDate) AS gap
 FROM price WINDOW w AS (PARTITION BY legId ORDER BY shipTs, orderKey, lineNumber, suppKey)""")


@query("a20_cadence_table", sql("""
SELECT CAST(gap AS INTEGER) AS gap_days, count(*) AS rows,
 100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(gap) FROM gaps) AS share_pct
FROM gaps WHERE gap IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 7""", GAPS), doubles="share_pct")
def _(spark, sf):
    return profile.cadence_table(price_obs(spark, sf), PRICE_TRAJECTORY)


@query("a20_cadence_summary", sql("""
SELECT quantile_cont(gap, 0.5) AS median_gap, avg(gap) AS mean_gap, count(*) FILTER (WHERE gap > 7) AS long_gaps,
 100.0 * CAST(count(*) FILTER (WHERE gap > 7) AS DOUBLE) / count(gap) AS long_gap_pct FROM gaps""", GAPS),
    doubles="median_gap mean_gap long_gap_pct")
def _(spark, sf):
    return profile.cadence_summary(price_obs(spark, sf), PRICE_TRAJECTORY)


CHANGES = ("changes", """SELECT totalFare - lag(totalFare) OVER (PARTITION BY legId ORDER BY searchTs, obsId) AS c FROM fare""")


@query("a21_step_profile", sql("""
SELECT count(*) FILTER (WHERE c = 0) AS unchanged, count(c) AS compared,
 100.0 * CAST(count(*) FILTER (WHERE c = 0) AS DOUBLE) / count(c) AS unchanged_pct,
 (SELECT quantile_cont(n, 0.5) FROM (SELECT count(DISTINCT totalFare) AS n FROM fare GROUP BY legId) AS d) AS median_distinct_fares
FROM changes""", CHANGES), doubles="unchanged_pct median_distinct_fares")
def _(spark, sf):
    return profile.step_profile(fare_obs(spark, sf), FARE_TRAJECTORY)


@query("a21_change_sizes", sql(describe_sql("abs(c)", "changes WHERE c <> 0"), CHANGES),
       doubles=STATS)
def _(spark, sf):
    return profile.change_sizes(fare_obs(spark, sf), FARE_TRAJECTORY)


def _booking_curve_sql() -> str:
    names = [r.replace("-", "_") for r in ROUTES]
    means = ", ".join(f"avg(totalFare) FILTER (WHERE route = '{r}') AS {n}"
                      for r, n in zip(ROUTES, names, strict=True))
    case, rank = (c.format("daysBeforeDeparture") for c in (HORIZON_CASE, HORIZON_RANK_CASE))
    rise = ", ".join(f"""((SELECT {n} FROM curve WHERE horizon = '1-3') / nullif((SELECT {n} FROM curve WHERE horizon = '46-60'), 0) - 1) * 100 AS {n}"""
                     for n in names)
    return sql(f"""SELECT * FROM curve
UNION ALL SELECT 'rise 46-60 -> 1-3 (%)', 7, {rise}""", (
        "curve", f"""SELECT {case} AS horizon, CAST({rank} AS INTEGER) AS horizon_rank, {means}
 FROM obs WHERE {rank} IS NOT NULL GROUP BY 1, 2"""))


@query("a22_booking_curve", _booking_curve_sql(), doubles=ROUTE_NAMES)
def _(spark, sf):
    return profile.booking_curve(observations(spark, sf))


@query("a23_horizon_fare_correlation", sql(
    "SELECT corr(daysBeforeDeparture, totalFare) AS correlation FROM obs"), doubles="correlation")
def _(spark, sf):
    return profile.horizon_fare_correlation(observations(spark, sf))


_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_DAY_NAME = "CASE d " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_DAYS)) + " END"


@query("a24_weekday_profile", sql(f"""
SELECT route, {', '.join(f"max(m) FILTER (WHERE d = {i}) AS {n}" for i, n in enumerate(_DAYS))},
 max(day) FILTER (WHERE hi = 1) AS peak_day, max(day) FILTER (WHERE lo = 1) AS cheapest_day,
 max(m) / nullif(min(m), 0) AS peak_to_trough
FROM (SELECT *, {_DAY_NAME} AS day, row_number() OVER (PARTITION BY route ORDER BY m DESC, d) AS hi,
 row_number() OVER (PARTITION BY route ORDER BY m, d) AS lo FROM (
 SELECT route, isodow(flightDate) - 1 AS d, round_even(avg(mean_fare), 1) AS m FROM daily GROUP BY 1, 2) AS a) AS b
GROUP BY route""", DAILY), doubles=" ".join(_DAYS) + " peak_to_trough")
def _(spark, sf):
    return profile.weekday_profile(observations(spark, sf))


@query("a25_horizon_event_rate", sql(f"""
SELECT {HORIZON_CASE.format('daysBeforeDeparture')} AS horizon,
 CAST({HORIZON_RANK_CASE.format('daysBeforeDeparture')} AS INTEGER) AS horizon_rank, count(*) AS labelable,
 count(*) FILTER (WHERE isSpikeEvent) AS events,
 100.0 * CAST(count(*) FILTER (WHERE isSpikeEvent) AS DOUBLE) / count(*) AS event_rate_pct
FROM labelled WHERE isLabelable AND daysBeforeDeparture BETWEEN 1 AND 61 GROUP BY 1, 2"""),
    doubles="event_rate_pct")
def _(spark, sf):
    return profile.horizon_event_rate(labelled(spark, sf))


@query("a26_class_balance", sql("""
SELECT labelable, minority, labelable - minority AS majority, CAST(labelable - minority AS DOUBLE) / nullif(minority, 0) AS imbalance_ratio
FROM (SELECT count(*) FILTER (WHERE isLabelable) AS labelable, count(*) FILTER (WHERE isSpikeEvent) AS minority FROM labelled) AS c"""),
    doubles="imbalance_ratio")
def _(spark, sf):
    return profile.class_balance(labelled(spark, sf))


@query("a26_minority_by_route", sql("""
SELECT route, count(*) FILTER (WHERE isSpikeEvent) AS minority FROM labelled WHERE isLabelable GROUP BY route"""))
def _(spark, sf):
    return profile.minority_by(labelled(spark, sf))


@query("a27_weekday_by_route", sql(crosstab_sql('"dayOfWeek"', "feat")), doubles=ROUTE_NAMES)
def _(spark, sf):
    return profile.crosstab_mean(features(spark, sf), "dayOfWeek", ROUTES)


@query("a28_holiday_distance_by_route", sql(crosstab_sql(
    '"daysToNearestHoliday"', "feat", "daysToNearestHoliday BETWEEN -21 AND 21")),
    doubles=ROUTE_NAMES)
def _(spark, sf):
    near = profile.near_holiday(features(spark, sf))
    return profile.crosstab_mean(near, "daysToNearestHoliday", ROUTES)


@query("a29_departure_hour_by_route", sql(crosstab_sql('"departureHour"', "feat")),
       doubles=ROUTE_NAMES)
def _(spark, sf):
    return profile.crosstab_mean(features(spark, sf), "departureHour", ROUTES)


@query("a30_airline_summary", sql("""
SELECT airline, count(*) AS rows, avg(totalFare) AS mean_fare, quantile_cont(totalFare, 0.5) AS median_fare,
 100.0 * CAST(count(*) FILTER (WHERE isSpikeEvent) AS DOUBLE) / count(*) AS spike_rate,
 100.0 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM feat) AS share_pct
FROM feat WHERE airline IS NOT NULL GROUP BY airline"""),
    doubles="mean_fare median_fare spike_rate share_pct")
def _(spark, sf):
    return profile.airline_summary(features(spark, sf))


_HEALTH = " UNION ALL ".join(f"""SELECT '{c}' AS feature, 100.0 * CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS null_pct,
 avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std FROM model"""
                             for c in FEATURE_GROUPS["lagged"])


@query("a32_feature_health", sql(_HEALTH), doubles="null_pct mean std")
def _(spark, sf):
    return profile.feature_health(model_rows(spark, sf))


@query("a33_counters", sql("""
SELECT count(*) AS rows, count(*) FILTER (WHERE isLabelable) AS labelable, count(*) FILTER (WHERE isSpikeEvent) AS events,
 count(DISTINCT legId) AS trajectories FROM labelled"""))
def _(spark, sf):
    return profile.counters(labelled(spark, sf))


def histogram_sql(source: str, value: str, by: str, bins: int, low: str) -> str:
    return f"""SELECT {by}, bin, lo + bin * w AS bin_start, n AS rows, n / (sum(n) OVER (PARTITION BY {by}) * w) AS density
FROM (SELECT {by}, CAST(least(floor(({value} - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w, count(*) AS n
 FROM (SELECT {by}, {value}, lo, (hi - lo) / {bins} AS w FROM {source} ,
  (SELECT {low} AS lo, max({value}) AS hi FROM {source} ) AS e) AS x GROUP BY 1, 2, 3, 4) AS y"""


@query("a34_fare_histogram", sql(histogram_sql("coach", "totalFare", "route", 80, "min(totalFare)")),
       doubles="bin_start density")
def _(spark, sf):
    return profile.histogram(observations(spark, sf), "totalFare", 80, "route")


@query("a34_balance_histogram", histogram_sql("supplier", "s_acctbal", "s_nationkey", 119, "min(s_acctbal)"),
       doubles="bin_start density")
def _(spark, sf):
    return profile.histogram(table(spark, sf, "supplier"), "s_acctbal", 119, "s_nationkey")


QUANTS = """SELECT {0}, min({1}) AS min, quantile_cont({1}, 0.25) AS q25, quantile_cont({1}, 0.5) AS q50,
 quantile_cont({1}, 0.75) AS q75, max({1}) AS max FROM {2} GROUP BY {0}"""


@query("a35_quantiles_by_route", sql(QUANTS.format("route", "totalFare", "coach")),
       doubles="min q25 q50 q75 max")
def _(spark, sf):
    return profile.quantile_table(observations(spark, sf), "totalFare", "route")


@query("a35_quantiles_by_brand", QUANTS.format("p_brand", "p_retailprice", "part"),
       doubles="min q25 q50 q75 max")
def _(spark, sf):
    return profile.quantile_table(table(spark, sf, "part"), "p_retailprice", ["p_brand"])


@query("a36_first_per_trajectory", sql("""
SELECT legId, segmentsAirlineName FROM (SELECT *, row_number() OVER (PARTITION BY legId ORDER BY searchTs, obsId) AS rn
 FROM fare WHERE segmentsAirlineName IS NOT NULL) AS t WHERE rn = 1"""))
def _(spark, sf):
    return profile.first_per_trajectory(fare_obs(spark, sf), "segmentsAirlineName", FARE_TRAJECTORY)


@query("o4_sampled_trajectories", sql(f"""
SELECT route, legId FROM (SELECT DISTINCT route, legId FROM obs WHERE route IS NOT NULL) AS d
QUALIFY row_number() OVER (PARTITION BY route ORDER BY md5(CAST(legId AS VARCHAR) || '#{FIXTURE.seed}'), legId) = 1"""))
def _(spark, sf):
    return profile.sample_trajectories(observations(spark, sf), seed=FIXTURE.seed)


@query("o5_trajectory_extract", sql("""
SELECT legId, obsId, daysBeforeDeparture, totalFare FROM obs WHERE legId = (SELECT min(legId) FROM obs)"""),
    doubles="totalFare")
def _(spark, sf):
    obs = observations(spark, sf)
    first = obs.agg(F.min("legId").alias("legId")).scalar()
    return profile.trajectory_extract(obs, first, FARE_TRAJECTORY).select(
        "legId", "obsId", "daysBeforeDeparture", "totalFare")

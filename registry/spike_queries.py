"""Spike labels and their summary tables."""


from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, PRICE_TRAJECTORY, price_obs
from faretrace.operators import spikes
from faretrace.params import SIGMA_LEVELS, SWEEP_WINDOWS
from faretrace.sources.ingest import departing_by
from registry.core import CUTOFF, labelled, observations, query, sql

KEY = ["legId", "obsId"]
SUMMARY = """count(*) AS rows, count(*) FILTER (WHERE isLabelable) AS labelable,
 count(*) FILTER (WHERE isSpike) AS spike_obs, count(*) FILTER (WHERE isSpikeEvent) AS spike_events"""
RATES = """100.0 * CAST(labelable AS DOUBLE) / rows AS labelable_pct,
 coalesce(100.0 * CAST(spike_obs AS DOUBLE) / nullif(labelable, 0), 0) AS obs_rate_pct,
 coalesce(100.0 * CAST(spike_events AS DOUBLE) / nullif(labelable, 0), 0) AS event_rate_pct"""
RATE_NAMES = "labelable_pct obs_rate_pct event_rate_pct"


@query("l1_labelable", sql("SELECT legId, obsId, isLabelable FROM labelled"))
def _(spark, sf):
    return labelled(spark, sf).select(*KEY, "isLabelable")


@query("l2_spike_z", sql("SELECT legId, obsId, spikeZ FROM labelled"), doubles="spikeZ")
def _(spark, sf):
    return labelled(spark, sf).select(*KEY, "spikeZ")


def _direction(direction, test):
    @query(f"l3_label_{direction}", sql(f"""
SELECT legId, obsId, hit AS isSpike,
 hit AND NOT lag(hit, 1, false) OVER (PARTITION BY legId ORDER BY searchTs, obsId) AS isSpikeEvent
FROM (SELECT *, coalesce(isLabelable AND {test}, false) AS hit FROM scored) AS t"""))
    def _(spark, sf):
        return spikes.detect_spikes(observations(spark, sf), FARE_TRAJECTORY, FIXTURE,
                                    direction=direction).select(*KEY, "isSpike", "isSpikeEvent")


_direction("up", "spikeZ >= 2.0")
_direction("down", "spikeZ <= -2.0")
_direction("both", "abs(spikeZ) >= 2.0")


@query("l4_spike_state", sql("SELECT legId, obsId, isSpike FROM state"))
def _(spark, sf):
    based = spikes.add_rolling_stats(observations(spark, sf), FARE_TRAJECTORY)
    return spikes.label_spikes(based, FARE_TRAJECTORY, sigma=2.0, direction="up").select(
        *KEY, "isSpike")


@query("l5_spike_events", sql("SELECT legId, obsId, searchTs FROM labelled WHERE isSpikeEvent"))
def _(spark, sf):
    return labelled(spark, sf).where("isSpikeEvent").select(*KEY, "searchTs")


@query("l6_summary_by_route", sql(f"""
SELECT *, {RATES} FROM (SELECT route, {SUMMARY} FROM labelled WHERE flightDate <= {CUTOFF} GROUP BY route) AS s"""),
    doubles=RATE_NAMES)
def l6_summary_by_route(spark, sf):
    kept = departing_by(observations(spark, sf), FIXTURE.full_trajectory_end)
    return spikes.spike_summary(spikes.detect_spikes(kept, FARE_TRAJECTORY, FIXTURE), "route")


@query("l6_summary_by_route_uncut", sql(f"""
SELECT *, {RATES} FROM (SELECT route, {SUMMARY} FROM labelled GROUP BY route) AS s"""),
    doubles=RATE_NAMES)
def _(spark, sf):
    return spikes.spike_summary(labelled(spark, sf), ["route"])


@query("l6_summary_all", sql(f"""
SELECT 'all' AS scope, *, {RATES} FROM (SELECT {SUMMARY} FROM labelled) AS s"""),
    doubles=RATE_NAMES)
def _(spark, sf):
    return spikes.spike_summary(labelled(spark, sf))


def sweep_sql(source: str, order: str) -> str:
    parts = []
    for w in SWEEP_WINDOWS:
        mp = spikes.sweep_min_periods(w)
        parts.append(f"""SELECT CAST({w} AS INTEGER) AS "window", CAST({mp} AS INTEGER) AS min_periods, count(*) AS rows,
 count(*) FILTER (WHERE lab) AS labelable, count(*) FILTER (WHERE hit) AS spike_obs,
 count(*) FILTER (WHERE hit AND NOT prev) AS spike_events
FROM (SELECT lab, hit, lag(hit, 1, false) OVER (PARTITION BY legId ORDER BY {order}) AS prev
 FROM (SELECT *, coalesce(d > 0, false) AS lab, coalesce(d > 0 AND (totalFare - m) / nullif(d, 0) >= 2.0, false) AS hit
 FROM (SELECT *, CASE WHEN count(totalFare) OVER f >= {mp} THEN avg(totalFare) OVER f END AS m,
  CASE WHEN count(totalFare) OVER f >= {mp} THEN stddev_samp(totalFare) OVER f END AS d
  FROM {source} WINDOW f AS (PARTITION BY legId ORDER BY {order} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)) AS a) AS b) AS c""")
    return f"""SELECT "window", min_periods, labelable, spike_obs, spike_events, {RATES},
 CAST(spike_obs AS DOUBLE) / greatest(spike_events, 1) AS obs_per_event
FROM ({' UNION ALL '.join(parts)}) AS s"""


@query("l7_window_sweep", sql(sweep_sql("obs ", "searchTs, obsId")),
       doubles=RATE_NAMES + " obs_per_event")
def _(spark, sf):
    return spikes.sweep_windows(observations(spark, sf), FARE_TRAJECTORY)


@query("l7_window_sweep_price", sql(sweep_sql("price ", "shipTs, orderKey, lineNumber, suppKey")),
       doubles=RATE_NAMES + " obs_per_event")
def _(spark, sf):
    return spikes.sweep_windows(price_obs(spark, sf), PRICE_TRAJECTORY)


def _sigma_sql() -> str:
    parts = []
    for s in SIGMA_LEVELS:
        parts.append(f"""SELECT CAST({s} AS DOUBLE) AS sigma, count(*) FILTER (WHERE isLabelable) AS labelable,
 count(*) FILTER (WHERE hit) AS spike_obs, count(*) FILTER (WHERE hit AND NOT prev) AS spike_events
FROM (SELECT *, lag(hit, 1, false) OVER (PARTITION BY legId ORDER BY searchTs, obsId) AS prev
 FROM (SELECT *, coalesce(isLabelable AND spikeZ >= {s}, false) AS hit FROM scored) AS a) AS b""")
    return f"""SELECT sigma, spike_obs, spike_events,
 coalesce(100.0 * CAST(spike_obs AS DOUBLE) / nullif(labelable, 0), 0) AS obs_rate_pct,
 coalesce(100.0 * CAST(spike_events AS DOUBLE) / nullif(labelable, 0), 0) AS event_rate_pct,
 CAST(labelable - spike_events AS DOUBLE) / greatest(spike_events, 1) AS imbalance_ratio
FROM ({' UNION ALL '.join(parts)}) AS s"""


@query("l8_sigma_table", sql(_sigma_sql()),
       doubles="sigma obs_rate_pct event_rate_pct imbalance_ratio")
def _(spark, sf):
    return spikes.sigma_table(observations(spark, sf), FARE_TRAJECTORY, FIXTURE)


@query("l9_rate_report", sql(f"""
SELECT rows, labelable, spike_obs, spike_events, CAST(spike_obs AS DOUBLE) / nullif(spike_events, 0) AS obs_per_event,
 100.0 * CAST(spike_obs AS DOUBLE) / rows AS obs_rate_all_pct, 100.0 * CAST(spike_events AS DOUBLE) / rows AS event_rate_all_pct,
 {RATES} FROM (SELECT {SUMMARY} FROM labelled) AS s"""),
    doubles=RATE_NAMES + " obs_per_event obs_rate_all_pct event_rate_all_pct")
def _(spark, sf):
    return spikes.rate_report(labelled(spark, sf))

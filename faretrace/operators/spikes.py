"""Causal baselines, spike states and events, and the tables that summarise them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretrace.functions import frames
from faretrace.functions.scalars import days_between, percent
from faretrace.params import DEFAULTS, SIGMA_LEVELS, SWEEP_WINDOWS, Params
from faretrace.plans.trajectory import Trajectory, on_trajectories
from faretrace.schema import require_columns

#: a verdict needs a scale: a deviation that exists and is not zero
LABELABLE = "coalesce({std} > 0, false)"


def add_days_before_departure(df: DataFrame, flight_col: str = "flightDate",
                              search_col: str = "searchDate") -> DataFrame:
    """Booking horizon of each observation in whole days."""
    return df.withColumn("daysBeforeDeparture", days_between(flight_col, search_col))


def rolling_columns(df: DataFrame, traj: Trajectory, window: int, min_periods: int,
                    value: str = "totalFare") -> DataFrame:
    """The baseline inside an open trajectory layout (see ``on_trajectories``)."""
    return df.withColumns({
        "rollMean": frames.rolling_mean(value, traj.over(), window, min_periods),
        "rollStd": frames.rolling_std(value, traj.over(), window, min_periods),
    })


def label_columns(df: DataFrame, traj: Trajectory, sigma: float, direction: str,
                  value: str = "totalFare") -> DataFrame:
    """Verdict columns inside an open trajectory layout."""
    hit = frames.beyond("spikeZ", sigma, direction)
    return (
        df.withColumns({
            "isLabelable": F.expr(LABELABLE.format(std="rollStd")),
            "spikeZ": F.expr(frames.z_score(value, "rollMean", "rollStd")),
        })
        .withColumn("isSpike", F.expr(f"coalesce(isLabelable AND {hit}, false)"))
        .withColumn("isSpikeEvent", frames.run_start("isSpike", traj.over()))
    )


def add_rolling_stats(df: DataFrame, traj: Trajectory = Trajectory(),
                      window: int = DEFAULTS.window, min_periods: int = DEFAULTS.min_periods,
                      value: str = "totalFare") -> DataFrame:
    """Mean and sample deviation of the ``window`` rows before each row, that row excluded."""
    require_columns(df, [value], "add_rolling_stats")
    return on_trajectories(
        df, traj, lambda d, t: rolling_columns(d, t, window, min_periods, value), lookback=window)


def label_spikes(df: DataFrame, traj: Trajectory = Trajectory(), sigma: float = DEFAULTS.sigma,
                 direction: str = "both", value: str = "totalFare") -> DataFrame:
    """``spikeZ``, ``isLabelable``, ``isSpike`` and ``isSpikeEvent`` from an attached baseline."""
    require_columns(df, [value, "rollMean", "rollStd"], "label_spikes (run add_rolling_stats first)")
    return on_trajectories(
        df, traj, lambda d, t: label_columns(d, t, sigma, direction, value), lookback=1)


def detect_spikes(df: DataFrame, traj: Trajectory = Trajectory(), params: Params = DEFAULTS,
                  value: str = "totalFare", direction: str | None = None) -> DataFrame:
    """Baseline and labels in one layout: one exchange and one sort for everything."""
    require_columns(df, [value], "detect_spikes")

    def body(d: DataFrame, t: Trajectory) -> DataFrame:
        d = rolling_columns(d, t, params.window, params.min_periods, value)
        return label_columns(d, t, params.sigma, direction or params.direction, value)

    return on_trajectories(df, traj, body, lookback=params.window + 1)


# ---- summaries -----------------------------------------------------------


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "labelable_pct": percent("labelable", "rows", empty=0.0),
        "obs_rate_pct": percent("spike_obs", "labelable", empty=0.0),
        "event_rate_pct": percent("spike_events", "labelable", empty=0.0),
    })


def spike_summary(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Coverage and spike rates per group (or one row ``all``); rates over labelable rows.

    Rows without a group are in no group's row.
    """
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    counts = df.groupBy(*keys).agg(
        F.expr("count(1) AS rows"), F.expr("count_if(isLabelable) AS labelable"),
        F.expr("count_if(isSpike) AS spike_obs"), F.expr("count_if(isSpikeEvent) AS spike_events"),
    )
    if by is None:
        counts = counts.select(F.lit("all").alias("scope"), "*")
    return _rates(counts)


def sweep_min_periods(window: int, ratio: float = 0.5) -> int:
    """Required history for one sweep window: half-even share of it, never under 3."""
    return max(3, round(window * ratio))


def _count_variants(df: DataFrame, traj: Trajectory,
                    stats: Callable[[str], dict[str, Column]],
                    variants: dict[str, tuple[str, str]], lookback: int) -> DataFrame:
    """Counts for several label variants from one layout; one row per variant.

    ``stats`` makes the rolling columns from an OVER clause. ``variants`` maps the SQL
    literal naming a variant to its coverage and spike conditions over those columns.
    """
    pairs = list(variants.items())

    def body(d: DataFrame, t: Trajectory) -> DataFrame:
        d = d.withColumns(stats(t.over()))
        d = d.withColumns({f"s{i}": F.expr(f"coalesce({able} AND {hit}, false)")
                           for i, (_, (able, hit)) in enumerate(pairs)})
        return d.withColumns({f"e{i}": frames.run_start(f"s{i}", t.over())
                              for i in range(len(pairs))})

    rows = ", ".join(
        f"struct({name} AS variant, count_if({able}) AS labelable, "
        f"count_if(s{i}) AS spike_obs, count_if(e{i}) AS spike_events)"
        for i, (name, (able, _)) in enumerate(pairs))
    totals = on_trajectories(df, traj, body, lookback).agg(
        F.expr("count(1) AS rows"), F.expr(f"array({rows}) AS variants"))
    return totals.selectExpr("rows", "inline(variants)")


def sweep_windows(df: DataFrame, traj: Trajectory = Trajectory(),
                  windows: Sequence[int] = SWEEP_WINDOWS, sigma: float = DEFAULTS.sigma,
                  min_periods_ratio: float = 0.5, direction: str = "up",
                  value: str = "totalFare") -> DataFrame:
    """One row per window size; all sizes share a single exchange and sort."""
    needs = {n: sweep_min_periods(n, min_periods_ratio) for n in windows}

    def stats(over: str) -> dict[str, Column]:
        return {
            # the deviation carries the minimum-history gate for both
            **{f"m{n}": frames.rolling_mean(value, over, n, 1) for n in needs},
            **{f"d{n}": frames.rolling_std(value, over, n, p) for n, p in needs.items()},
        }

    variants = {
        str(n): (LABELABLE.format(std=f"d{n}"),
                 frames.beyond(frames.z_score(value, f"m{n}", f"d{n}"), sigma, direction))
        for n in windows
    }
    narrow = df.select(traj.group, *traj.order, value)
    counted = _count_variants(narrow, traj, stats, variants, max(windows) + 1)
    required = " ".join(f"WHEN {n} THEN {p}" for n, p in needs.items())
    return _rates(counted).selectExpr(
        "variant AS window", f"CASE variant {required} END AS min_periods", "labelable",
        "labelable_pct", "spike_obs", "spike_events", "obs_rate_pct", "event_rate_pct",
        "spike_obs / greatest(spike_events, 1) AS obs_per_event")


def sigma_table(df: DataFrame, traj: Trajectory = Trajectory(), params: Params = DEFAULTS,
                sigmas: Sequence[float] = SIGMA_LEVELS, direction: str = "up",
                value: str = "totalFare") -> DataFrame:
    """One row per threshold on the same baseline, from one layout."""

    def stats(over: str) -> dict[str, Column]:
        return {
            "m": frames.rolling_mean(value, over, params.window, 1),
            "d": frames.rolling_std(value, over, params.window, params.min_periods),
        }

    z = frames.z_score(value, "m", "d")
    variants = {
        f"CAST({float(s)!r} AS DOUBLE)": (LABELABLE.format(std="d"),
                                          frames.beyond(z, s, direction))
        for s in sigmas
    }
    narrow = df.select(traj.group, *traj.order, value)
    counted = _count_variants(narrow, traj, stats, variants, params.window + 1)
    return _rates(counted).selectExpr(
        "variant AS sigma", "spike_obs", "spike_events", "obs_rate_pct", "event_rate_pct",
        "(labelable - spike_events) / greatest(spike_events, 1) AS imbalance_ratio")


def rate_report(labelled: DataFrame) -> DataFrame:
    """One row of totals with rates over all rows and over labelable rows."""
    return spike_summary(labelled).select(
        "rows", "labelable", "labelable_pct", "spike_obs", "spike_events",
        F.expr(f"{frames.ratio('spike_obs', 'spike_events')} AS obs_per_event"),
        percent("spike_obs", "rows", empty=0.0).alias("obs_rate_all_pct"),
        percent("spike_events", "rows", empty=0.0).alias("event_rate_all_pct"),
        "obs_rate_pct", "event_rate_pct",
    )

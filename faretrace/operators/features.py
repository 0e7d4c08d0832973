"""Predictors that are knowable before the observation they predict."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretrace.functions import frames, scalars
from faretrace.operators import spikes
from faretrace.params import DAYPART_LABELS, DEFAULTS, Params
from faretrace.plans.ordering import ordered_rank
from faretrace.plans.trajectory import Trajectory, on_trajectories
from faretrace.schema import FEATURE_GROUPS, LEAKY_COLUMNS, require_columns

#: categories up to this many become a literal lookup, more a joined code table
LITERAL_DOMAIN = 1_000


class LeakyFeatures(AssertionError):
    """A predictor reveals the label."""


def assert_no_leaky_features(columns: Iterable[str]) -> None:
    """Raise, naming the offenders, when a predictor is derived from the predicted fare."""
    found = sorted(LEAKY_COLUMNS.intersection(columns))
    if found:
        raise LeakyFeatures(f"predictors that give the label away: {', '.join(found)}")


def feature_catalog(spark: SparkSession) -> DataFrame:
    """(group, n, features) of every predictor group."""
    rows = [(g, len(names), ", ".join(names)) for g, names in FEATURE_GROUPS.items()]
    return spark.createDataFrame(rows, "`group` string, n int, features string")


def feature_groups(spark: SparkSession) -> DataFrame:
    """(feature, group) dimension for labelling importances; 32 rows."""
    rows = [(name, g) for g, names in FEATURE_GROUPS.items() for name in names]
    return spark.createDataFrame(rows, "feature string, `group` string")


def add_calendar_features(df: DataFrame, params: Params = DEFAULTS,
                          date_col: str = "flightDate") -> DataFrame:
    day = date_col
    return df.withColumns({
        "dayOfWeek": scalars.day_of_week(day),
        "isWeekend": scalars.is_weekend(day),
        "month": F.month(day),
        "weekOfYear": scalars.iso_week(day),
        "isHoliday": scalars.is_holiday(day, params.holidays),
        "daysToNearestHoliday": scalars.days_to_nearest_holiday(day, params.holidays),
        "isSummerSeason": scalars.in_season(day, params.season_start, params.season_end),
    })


def add_itinerary_features(df: DataFrame) -> DataFrame:
    carriers = "segmentsAirlineName"
    hour = scalars.local_hour("segmentsDepartureTimeRaw")
    return df.withColumns({
        "nSegments": scalars.segment_count(carriers),
        "airline": scalars.first_segment(carriers),
        "isSingleCarrier": scalars.single_valued(carriers),
        "departureHour": F.expr(hour),
        "departureTimeOfDay": scalars.daypart(hour),
        "travelDurationMinutes": scalars.duration_minutes("travelDuration"),
    })


def lag_columns(df: DataFrame, traj: Trajectory, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Lagged observations and momentum inside an open trajectory layout."""
    over = traj.over()

    def fare(k: int) -> str:
        return frames.past("totalFare", over, k)

    def seats(k: int) -> str:
        return frames.past("seatsRemaining", over, k)

    step1, step2 = f"({fare(1)} - {fare(2)})", f"({fare(2)} - {fare(3)})"
    texts = {
        **{f"fareLag{k}": fare(k) for k in lags},
        "fareChangeLag1": step1,
        "fareChangeLag2": step2,
        "fareAccel": f"{step1} - {step2}",
        # the baseline is the one at this row, which already contains the previous fare
        "zLag1": frames.ratio(f"{fare(1)} - rollMean", "rollStd"),
        "seatsRemainingLag1": seats(1),
        "seatsChangeLag1": f"{seats(1)} - {seats(2)}",
        "rollStdRatio": frames.ratio("rollStd", "rollMean"),
    }
    return df.withColumns({
        **{name: F.expr(text) for name, text in texts.items()},
        "observationIndex": traj.position(),
    })


def add_lagged_features(df: DataFrame, traj: Trajectory = Trajectory(),
                        lags: Sequence[int] = DEFAULTS.lags) -> DataFrame:
    require_columns(df, ["totalFare", "seatsRemaining", "rollMean", "rollStd"],
                    "add_lagged_features")
    return on_trajectories(df, traj, lambda d, t: lag_columns(d, t, lags),
                           lookback=max(3, *lags))


def build_feature_frame(df: DataFrame, traj: Trajectory = Trajectory(),
                        params: Params = DEFAULTS) -> DataFrame:
    """All predictors on a labelled frame."""
    return (
        df.transform(add_calendar_features, params)
        .transform(add_itinerary_features)
        .transform(add_lagged_features, traj, params.lags)
    )


def observations_to_features(df: DataFrame, traj: Trajectory = Trajectory(),
                             params: Params = DEFAULTS) -> DataFrame:
    """From cleaned observations to labels and predictors in one exchange and one sort."""

    def body(d: DataFrame, t: Trajectory) -> DataFrame:
        d = spikes.rolling_columns(d, t, params.window, params.min_periods)
        d = spikes.label_columns(d, t, params.sigma, params.direction)
        return lag_columns(d, t, params.lags)

    windowed = on_trajectories(
        spikes.add_days_before_departure(df), traj, body,
        lookback=max(params.window + 1, *params.lags))
    return windowed.transform(add_calendar_features, params).transform(add_itinerary_features)


def sequence_windows(df: DataFrame, length: int, traj: Trajectory = Trajectory(),
                     columns: Sequence[str] = ("totalFare",)) -> DataFrame:
    """``sequence``: the previous ``length`` observations, oldest first.

    Rows with fewer than ``length`` predecessors are not training examples and go.
    A NULL inside an observation stays in its struct, so it keeps its slot.
    """

    def body(d: DataFrame, t: Trajectory) -> DataFrame:
        frame = f"({t.over()} ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"
        return d.withColumn("sequence", F.expr(
            f"collect_list(struct({', '.join(columns)})) OVER {frame}"))

    return on_trajectories(df, traj, body, lookback=length).where(F.size("sequence") == length)


# ---- design matrix -------------------------------------------------------


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): dense codes over the sorted distinct non-null values."""
    domain = df.select(column).where(F.col(column).isNotNull()).distinct()
    return ordered_rank(domain, [column], "code").withColumn("code", F.col("code").cast("int"))


def _literal_codes(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]] | None:
    """Sorted distinct values of all ``columns`` from one job, or None when there are many."""
    fields = ", ".join(f"struct('{c}' AS name, `{c}` AS value)" for c in columns)
    pairs = df.selectExpr(f"inline(array({fields}))").where("value IS NOT NULL").distinct()
    found = pairs.limit(LITERAL_DOMAIN + 1).collect()
    if len(found) > LITERAL_DOMAIN:
        return None
    # bytewise, as the engine orders text
    return {c: sorted((r["value"] for r in found if r["name"] == c), key=lambda v: v.encode())
            for c in columns}


def _code_joined(df: DataFrame, column: str, domain_of: DataFrame) -> DataFrame:
    named = category_codes(domain_of, column).withColumnRenamed(column, "__value")
    return (
        df.join(named, F.col(column) == F.col("__value"), "left")
        .withColumn(column, F.coalesce("code", F.lit(-1))).drop("code", "__value")
    )


def encode(df: DataFrame, columns: Sequence[str], domain_of: DataFrame | None = None) -> DataFrame:
    """Design columns as floats: text to codes, flags to 0/1, ordered bins by rank.

    A missing category or flag is -1; a missing number stays NULL. Text codes come
    from ``domain_of`` (default: ``df``); columns not listed pass through.
    """
    types = {f.name: f.dataType for f in df.schema}
    ordinal = {"departureTimeOfDay": DAYPART_LABELS}
    for column in ordinal.keys() & set(columns):
        cases = " ".join(f"WHEN {label!r} THEN {i}" for i, label in enumerate(ordinal[column]))
        df = df.withColumn(column, F.expr(f"CASE `{column}` {cases} ELSE -1 END"))
    for column in columns:
        if isinstance(types[column], T.BooleanType):
            df = df.withColumn(column, F.expr(f"coalesce(CAST(`{column}` AS INT), -1)"))
    text = [c for c in columns if c not in ordinal and isinstance(types[c], T.StringType)]
    source = domain_of if domain_of is not None else df
    codes = _literal_codes(source, text) if text else {}
    for column in text:
        if codes is None:
            df = _code_joined(df, column, source)
        else:
            known = [F.lit(x) for i, v in enumerate(codes[column]) for x in (v, i)]
            found = F.try_element_at(F.create_map(*known), F.col(column)) if known else F.lit(None)
            df = df.withColumn(column, F.coalesce(found, F.lit(-1)))
    return df.withColumns({c: F.expr(f"CAST(`{c}` AS FLOAT)") for c in columns})

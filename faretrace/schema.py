"""Table contracts: the source file's schema and the three persisted stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The 17 columns the study reads, in file order, with Spark types.
OBSERVATION = T.StructType([
    T.StructField("legId", T.StringType()),
    T.StructField("searchDate", T.DateType()),
    T.StructField("flightDate", T.DateType()),
    T.StructField("startingAirport", T.StringType()),
    T.StructField("destinationAirport", T.StringType()),
    T.StructField("travelDuration", T.StringType()),
    T.StructField("elapsedDays", T.IntegerType()),
    T.StructField("isBasicEconomy", T.BooleanType()),
    T.StructField("isRefundable", T.BooleanType()),
    T.StructField("isNonStop", T.BooleanType()),
    T.StructField("baseFare", T.DoubleType()),
    T.StructField("totalFare", T.DoubleType()),
    T.StructField("seatsRemaining", T.IntegerType()),
    T.StructField("totalTravelDistance", T.DoubleType()),
    T.StructField("segmentsDepartureTimeRaw", T.StringType()),
    T.StructField("segmentsAirlineName", T.StringType()),
    T.StructField("segmentsCabinCode", T.StringType()),
])
MODELLING_COLUMNS = tuple(OBSERVATION.fieldNames())
# Predictors that hold text.
CATEGORY_COLUMNS = (
    "startingAirport", "destinationAirport", "segmentsAirlineName", "segmentsCabinCode",
)

# The labelled stage's columns.
LABELLED_COLUMNS = (
    "legId", "searchDate", "flightDate", "route", "startingAirport", "destinationAirport",
    "daysBeforeDeparture", "totalFare", "baseFare", "seatsRemaining", "isNonStop",
    "isBasicEconomy", "isRefundable", "travelDuration", "totalTravelDistance",
    "segmentsAirlineName", "segmentsDepartureTimeRaw",
    "rollMean", "rollStd", "spikeZ", "isLabelable", "isSpike", "isSpikeEvent",
)

# Predictors by what makes them available at prediction time.
FEATURE_GROUPS: dict[str, tuple[str, ...]] = {
    "temporal": (
        "daysBeforeDeparture", "dayOfWeek", "isWeekend", "month", "weekOfYear",
        "observationIndex",
    ),
    "calendar": ("isHoliday", "daysToNearestHoliday", "isSummerSeason"),
    "itinerary": (
        "isNonStop", "nSegments", "isBasicEconomy", "isRefundable", "totalTravelDistance",
        "travelDurationMinutes", "departureHour", "isSingleCarrier",
    ),
    "lagged": (
        "fareLag1", "fareLag2", "fareLag3", "fareChangeLag1", "fareChangeLag2", "fareAccel",
        "zLag1", "seatsRemainingLag1", "seatsChangeLag1", "rollMean", "rollStd", "rollStdRatio",
    ),
    "categorical": ("route", "airline", "departureTimeOfDay"),
}
FEATURE_COLUMNS = tuple(name for names in FEATURE_GROUPS.values() for name in names)
# Columns that give the label away, that only name a row, and that are predicted.
LEAKY_COLUMNS = frozenset(
    {"totalFare", "baseFare", "spikeZ", "isSpike", "isSpikeEvent", "isLabelable"}
)
ID_COLUMNS = (
    "legId", "searchDate", "flightDate", "route", "startingAirport", "destinationAirport",
)
TARGET_COLUMNS = ("isSpike", "isSpikeEvent", "totalFare")
MODEL_COLUMNS = tuple(dict.fromkeys(ID_COLUMNS + FEATURE_COLUMNS + TARGET_COLUMNS))


class MissingColumns(KeyError):
    """An operator was given a frame without the columns it works on."""


def require_columns(df: DataFrame, names: Iterable[str], needed_by: str) -> None:
    """Raise before any job runs when ``df`` lacks one of ``names``."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise MissingColumns(f"{needed_by} needs column(s) {', '.join(absent)}")

"""Row-level expressions: calendar, itinerary text, bins, shares.

Operands are SQL text (a column name or any expression over the row).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from faretrace.functions.frames import ratio
from faretrace.params import DAYPART_EDGES, DAYPART_LABELS, HORIZON_EDGES, HORIZON_LABELS

SEGMENT_MARK = r"r'\|\|'"


def _dates(days: Iterable[date]) -> str:
    return ", ".join(f"DATE '{d}'" for d in sorted(days))


def days_between(later: str, earlier: str) -> Column:
    return F.expr(f"datediff({later}, {earlier})")


# ---- calendar ------------------------------------------------------------


def day_of_week(day: str) -> Column:
    """Monday is 0."""
    return F.expr(f"weekday({day})")


def is_weekend(day: str) -> Column:
    return F.expr(f"coalesce(weekday({day}) >= 5, false)")


def iso_week(day: str) -> Column:
    return F.expr(f"weekofyear({day})")


def is_holiday(day: str, holidays: Iterable[date]) -> Column:
    listed = _dates(holidays)
    return F.expr(f"coalesce({day} IN ({listed}), false)") if listed else F.lit(False)


def days_to_nearest_holiday(day: str, holidays: Iterable[date]) -> Column:
    """Signed days from the nearest holiday (positive = after); a tie takes the earlier one."""
    listed = _dates(holidays)
    if not listed:
        return F.lit(None).cast("int")
    signed = f"datediff({day}, h)"
    return F.expr(
        f"CASE WHEN {day} IS NOT NULL THEN array_min(transform(array({listed}), h -> "
        f"struct(abs({signed}) AS distance, h AS holiday, {signed} AS signed))).signed END")


def in_season(day: str, start: date, end: date) -> Column:
    """Inclusive at both ends; a missing date is out of season."""
    return F.expr(f"coalesce({day} BETWEEN DATE '{start}' AND DATE '{end}', false)")


def month_key(day: str) -> Column:
    return F.expr(f"date_format({day}, 'yyyy-MM')")


# ---- itinerary text ------------------------------------------------------


def duration_minutes(text: str) -> Column:
    """Minutes of an ISO-8601 duration; only the H and M parts count, a missing part is 0."""

    def part(unit: str) -> str:
        found = f"regexp_extract({text}, r'(\\d+){unit}', 1)"
        return f"coalesce(try_cast({found} AS DOUBLE), 0D)"

    return F.expr(f"{part('H')} * 60D + {part('M')}")


def segment_count(text: str) -> Column:
    return F.expr(f"coalesce(regexp_count({text}, {SEGMENT_MARK}), 0) + 1")


def first_segment(text: str) -> Column:
    return F.expr(f"split_part({text}, '||', 1)")


def single_valued(text: str) -> Column:
    """True when every segment names the same carrier (also when none is named)."""
    return F.expr(f"coalesce(size(array_distinct(split({text}, {SEGMENT_MARK}))) = 1, true)")


def local_hour(raw: str) -> str:
    """SQL of the hour on the departure airport's clock (characters 12-13, no zone conversion)."""
    return f"try_cast(substring({raw}, 12, 2) AS INT)"


# ---- right-closed bins ---------------------------------------------------


def right_closed(value: str, edges: Sequence[float], labels: Sequence[object]) -> Column:
    """Label of the bin (lo, hi] that holds ``value``; NULL outside all bins."""
    cases = " ".join(
        f"WHEN {value} > {lo} AND {value} <= {hi} THEN {label!r}"
        for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True))
    return F.expr(f"CASE {cases} END")


def daypart(hour: str) -> Column:
    return right_closed(hour, DAYPART_EDGES, DAYPART_LABELS)


def daypart_rank(hour: str) -> Column:
    return right_closed(hour, DAYPART_EDGES, range(len(DAYPART_LABELS)))


def horizon_bin(days: str) -> Column:
    return right_closed(days, HORIZON_EDGES, HORIZON_LABELS)


def horizon_rank(days: str) -> Column:
    return right_closed(days, HORIZON_EDGES, range(len(HORIZON_LABELS)))


# ---- shares --------------------------------------------------------------


def percent(part: str, whole: str, empty: float | None = None) -> Column:
    """100 * part / whole; ``empty`` where the whole is zero."""
    share = ratio(f"CAST({part} AS DOUBLE) * 100D", whole)
    return F.expr(share if empty is None else f"coalesce({share}, {float(empty)}D)")


def half_even(value: str, digits: int) -> Column:
    return F.expr(f"bround({value}, {digits})")

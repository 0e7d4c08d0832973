"""Trajectory expressions as Spark SQL.

Operands are SQL text (usually a column name); ``over`` is the inside of an OVER
clause, as ``Trajectory.over`` writes it. One parsed string per column keeps plan
building cheap, and all columns over the same clause share one exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _before(stat: str, value: str, over: str, window: int, min_periods: int) -> Column:
    frame = f"({over} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    if min_periods <= 1:  # a statistic of no values is NULL by itself
        return F.expr(f"{stat}({value}) OVER {frame}")
    return F.expr(f"CASE WHEN count({value}) OVER {frame} >= {min_periods} "
                  f"THEN {stat}({value}) OVER {frame} END")


def rolling_mean(value: str, over: str, window: int, min_periods: int) -> Column:
    """Mean of the previous ``window`` rows; NULL under ``min_periods`` non-null values."""
    return _before("avg", value, over, window, min_periods)


def rolling_std(value: str, over: str, window: int, min_periods: int) -> Column:
    """Sample standard deviation of the previous ``window`` rows."""
    return _before("stddev_samp", value, over, window, min_periods)


def past(value: str, over: str, rows: int = 1) -> str:
    """SQL of the value ``rows`` observations earlier."""
    return f"lag({value}, {rows}) OVER ({over})"


def change(value: str, over: str) -> Column:
    """First difference along the trajectory."""
    return F.expr(f"{value} - {past(value, over)}")


def gap_days(day: str, over: str) -> Column:
    """Whole days since the trajectory's previous observation."""
    return F.expr(f"datediff({day}, {past(day, over)})")


def run_start(state: str, over: str) -> Column:
    """True on the first row of every run of true states."""
    return F.expr(f"{state} AND NOT lag({state}, 1, false) OVER ({over})")


def ratio(numerator: str, denominator: str) -> str:
    """SQL of a double division that yields NULL on a zero denominator, also under ANSI."""
    return f"(({numerator}) / nullif(CAST({denominator} AS DOUBLE), 0D))"


def z_score(value: str, mean: str, std: str) -> str:
    """SQL of the deviation in units of ``std``; a jump off a flat window is infinite."""
    delta = f"({value} - {mean})"
    return (f"CASE WHEN {std} = 0 THEN CASE WHEN {delta} > 0 THEN double('Infinity') "
            f"WHEN {delta} < 0 THEN double('-Infinity') END ELSE {ratio(delta, std)} END")


def beyond(z: str, sigma: float, direction: str) -> str:
    """SQL of the inclusive threshold test on ``z``."""
    level = f"CAST({float(sigma)!r} AS DOUBLE)"
    tests = {
        "up": f"({z}) >= {level}",
        "down": f"({z}) <= -{level}",
        "both": f"abs({z}) >= {level}",
    }
    if direction not in tests:
        raise ValueError(f"direction must be one of {', '.join(tests)}, not {direction!r}")
    return tests[direction]

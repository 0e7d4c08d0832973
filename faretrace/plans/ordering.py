"""Total orders and prefix sums without one task that sees every row.

Rows are range partitioned, checkpointed (so every consumer sees the same placement),
and the per-partition totals - one row per partition - are broadcast back as offsets.
Only a caller who asks for one part gets a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrace.session import cut_lineage

#: a join side known to have at most this many short rows is broadcast
BROADCAST_ROWS = 100_000
_SERIAL, _PART, _FIRST, _BEFORE = "__serial", "__part", "__first", "__before"


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose row count is bounded by ``rows``; else leave the choice to AQE."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _name_and_sort(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def place_in_order(df: DataFrame, order: Sequence[str | Column], parts: int) -> DataFrame:
    """Range partition and sort by ``order``; adds a serial that is ascending in that order."""
    keys = _name_and_sort(order)
    placed = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SERIAL, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(F.col(_SERIAL), 33))
    )
    return cut_lineage(placed)


def number_rows(placed: DataFrame, group: Sequence[str], name: str,
                pieces_at_most: int) -> DataFrame:
    """0-based position within ``group`` of rows laid out by :func:`place_in_order`.

    Groups are contiguous in that order, so there is at most one piece per
    partition plus one per group: ``pieces_at_most`` is that sum.
    """
    pieces = (
        placed.groupBy(_PART, *group)
        .agg(F.min(_SERIAL).alias(_FIRST), F.count(F.lit(1)).alias("__rows"))
        .withColumn(
            _BEFORE,
            F.coalesce(
                F.sum("__rows").over(
                    Window.partitionBy(*group).orderBy(_PART)
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select(*[F.col(c).alias(f"__p_{c}") for c in (_PART, *group)], _FIRST, _BEFORE)
    )
    same_piece = F.lit(True)
    for c in (_PART, *group):
        same_piece = same_piece & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    numbered = placed.join(broadcast_if_small(pieces, pieces_at_most), same_piece)
    return numbered.withColumn(name, F.col(_SERIAL) - F.col(_FIRST) + F.col(_BEFORE)).drop(
        _SERIAL, _PART, _FIRST, _BEFORE, *[f"__p_{c}" for c in (_PART, *group)]
    )


def _parts(df: DataFrame, parts: int | None) -> int:
    """How many ranges to cut: the session's shuffle width unless the caller knows better."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts


def ordered_rank(df: DataFrame, order: Sequence[str | Column], name: str,
                 parts: int | None = None) -> DataFrame:
    """Exact 0-based position of every row in the total ``order`` (must be unique)."""
    parts = _parts(df, parts)
    if parts <= 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    return number_rows(place_in_order(df, order, parts), (), name, parts)


def running_totals(df: DataFrame, order: Sequence[str | Column], totals: dict[str, str],
                   parts: int | None = None) -> DataFrame:
    """Inclusive prefix sums along ``order``: ``totals`` maps new name to summed column."""
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    parts = _parts(df, parts)
    if parts <= 1:
        w = Window.orderBy(*order).rowsBetween(*up_to_here)
        return df.withColumns({new: F.sum(old).over(w) for new, old in totals.items()})
    placed = place_in_order(df, order, parts)
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(_PART)
        .agg(*[F.sum(old).alias(f"__t_{new}") for new, old in totals.items()])
        .select(
            F.col(_PART).alias("__p"),
            *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}")
              for new in totals],
        )
    )
    within = Window.partitionBy(_PART).orderBy(_SERIAL).rowsBetween(*up_to_here)
    return (
        placed.join(broadcast_if_small(offsets, parts), F.col(_PART) == F.col("__p"))
        .withColumns({new: F.sum(old).over(within) + F.col(f"__o_{new}")
                      for new, old in totals.items()})
        .drop(_SERIAL, _PART, "__p", *[f"__o_{new}" for new in totals])
    )

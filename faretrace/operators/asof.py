"""As-of join in both directions against a table of dated events, per market, and interval membership by date buckets.

Events and observations are laid out together in one distributed order of (market, day), so neither side is held whole
anywhere and a market with most of the rows spans many partitions. Within a partition windows carry the last and the
next event; what crosses a border comes from one row a (partition, market).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretrace.plans import ordering
from faretrace.session import cut_lineage

#: rows of a partition, so that what a task sorts does not grow with the tables
ROWS_A_PART = 200_000
_EVENT, _FROM, _PART, _SERIAL = "__event", "__is_event", "__part", "__serial"


def with_events(df: DataFrame, events: DataFrame, day: str, event_day: str, by: Sequence[str] = (),
                event_by: Sequence[str] | None = None, carry: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Each row of ``df`` with ``last_event`` (on or before its ``day``) and ``next_event`` (on or after) of its market.

    Both are structs of the event's ``day`` and the ``carry`` columns, NULL where there is none; of events of one day the one
    that is smallest by its carried columns counts. Rows without a day have no events; a NULL market is a market.
    Without ``parts`` both tables are counted, and their rows cut into parts of about ``ROWS_A_PART``.
    """
    event_by = by if event_by is None else event_by
    if parts is None:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(df.count() + events.count()) // ROWS_A_PART))
    market = [f"__m{i}" for i in range(len(by))]
    event = F.struct(F.to_date(event_day).alias("day"), *carry)
    listed = (events.where(F.col(event_day).isNotNull()).select(*(F.col(c).alias(m) for c, m in zip(event_by, market, strict=True)), event.alias(_EVENT))
              .groupBy(*market, F.col(f"{_EVENT}.day").alias("__day")).agg(F.min(_EVENT).alias(_EVENT)).withColumn(_FROM, F.lit(True)))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), *(F.col(c).alias(m) for c, m in zip(by, market, strict=True)),
                     F.to_date(day).alias("__day"), F.lit(False).alias(_FROM))
    # events of a day come before its rows; the hash spreads rows of one market and day over partitions
    both = rows.unionByName(listed, allowMissingColumns=True).withColumn("__tie", F.when(~F.col(_FROM), F.xxhash64("__row")))
    placed = ordering.place_in_order(both, [*market, "__day", F.desc(_FROM), "__tie"], parts)

    group = [_PART, *market]
    pieces = cut_lineage(placed.groupBy(*group).agg(F.min(_EVENT).alias("__first"), F.max(_EVENT).alias("__last")))
    across = Window.partitionBy(*(market or [F.lit(0)]))
    borders = pieces.select(
        *(F.col(c).alias(f"__b{c}") for c in group),
        F.last("__last", True).over(across.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.last("__first", True).over(across.orderBy(F.desc(_PART)).rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
    same = F.col(_PART) == F.col(f"__b{_PART}")
    for m in market:
        same = same & F.col(m).eqNullSafe(F.col(f"__b{m}"))
    # one row a partition, or one more where a market begins in it; a broadcast spares the rows a third exchange
    side = ordering.broadcast_if_small(borders, pieces.count())
    # frames that grow, once from each end: one that shrinks is summed anew for every row
    upto = (Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(*group)
    found = placed.repartition(parts, *group).withColumns({
        "__within": F.last(_EVENT, True).over(along.orderBy(_SERIAL).rowsBetween(*upto)),
        "__ahead": F.last(_EVENT, True).over(along.orderBy(F.desc(_SERIAL)).rowsBetween(*upto)),
    }).where(~F.col(_FROM)).join(side, same, "left")
    last, dated = F.coalesce("__within", "__before"), F.col("__day").isNotNull()
    onward = F.when(last["day"] == F.col("__day"), last).otherwise(F.coalesce("__ahead", "__after"))
    return found.select("__row.*", F.when(dated, last).alias("last_event"), F.when(dated, onward).alias("next_event"))


def days_to_nearest(day: str) -> str:
    """Signed days from the nearest of ``last_event`` and ``next_event``, the earlier one if both are as near; SQL text."""
    past, ahead = f"datediff(`{day}`, last_event.day)", f"datediff(`{day}`, next_event.day)"
    return f"CASE WHEN last_event IS NULL OR -{ahead} < {past} THEN {ahead} ELSE {past} END"


def in_intervals(df: DataFrame, intervals: DataFrame, day: str, width: int = 28) -> DataFrame:
    """Rows of ``df`` once for each of ``intervals`` (fold, side, start, end; both ends inclusive) that holds their ``day``, with
    ``fold`` and ``side``. Intervals are listed in the date buckets that they meet, so a row meets only those of its
    bucket, and rows move once however many folds there are."""
    listed = intervals.select(
        F.col("fold").alias("fold"), F.col("side").alias("side"), F.col("start").alias("__start"), F.col("end").alias("__end"),
        F.explode(F.expr(f"sequence(floor(unix_date(start) / {width}), floor(unix_date(`end`) / {width}))")).alias("__bucket"))
    keyed = df.withColumn("__at", F.expr(f"floor(unix_date(to_date(`{day}`)) / {width})"))
    return (keyed.join(listed, F.expr(f"__at = __bucket AND to_date(`{day}`) BETWEEN __start AND __end"))
            .drop("__at", "__bucket", "__start", "__end"))


def interval_counts(df: DataFrame, intervals: DataFrame, day: str, flag: str | None = None, width: int = 28) -> DataFrame:
    """(fold, side, rows, positives) of every interval. Rows are first counted a day, so that the join sees a calendar
    however many rows and overlapping intervals there are. Intervals without rows count 0."""
    positive = f"count_if(CAST(`{flag}` AS BOOLEAN))" if flag else "CAST(NULL AS BIGINT)"
    daily = df.groupBy(F.to_date(day).alias("__day")).agg(F.expr("count(1) AS n"), F.expr(f"{positive} AS p")).where("__day IS NOT NULL")
    counted = in_intervals(daily, intervals, "__day", width).groupBy("fold", "side").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    zero = F.lit(0) if flag else F.lit(None)
    return intervals.select("fold", "side").join(counted, ["fold", "side"], "left").select(
        "fold", "side", F.coalesce("n", F.lit(0)).cast("long").alias("rows"), F.coalesce("p", zero).cast("long").alias("positives"))

"""Windows over trajectories that stay whole and balanced when one item is huge.

A trajectory is the time-ordered rows of one ``group``. Ordinarily it is one
window partition: one exchange and one sort serve every frame, lag and run
detector. A trajectory longer than ``hot_rows`` would make one task the
bottleneck, so its rows are numbered in a distributed total order, cut into
blocks of ``hot_rows`` positions, and each block is given copies of the
``lookback`` rows before it (the halo). Windows then run per (group, block) and
the halo rows are dropped, which gives exactly the whole-trajectory result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faretrace.plans.ordering import broadcast_if_small, number_rows, place_in_order
from faretrace.schema import require_columns

BLOCK, HALO, POSITION = "__block", "__halo", "__position"
#: sampled rows expected from a trajectory exactly ``hot_rows`` long
SAMPLED_ROWS = 2_000


@dataclass(frozen=True)
class Trajectory:
    """Which rows form a series and how they are ordered.

    ``time`` plus ``tiebreak`` must be unique within ``group``; under the data
    contract (one row per item and search date) no tiebreak is needed.
    """

    group: str = "legId"
    time: str = "searchDate"
    tiebreak: tuple[str, ...] = ()
    #: longest trajectory one task may sort and scan
    hot_rows: int = 4_000_000
    blocked: bool = False

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tiebreak)

    def window(self) -> WindowSpec:
        keys = (self.group, BLOCK) if self.blocked else (self.group,)
        return Window.partitionBy(*keys).orderBy(*self.order)

    def over(self) -> str:
        """The same window as the inside of an SQL OVER clause."""
        keys = (self.group, BLOCK) if self.blocked else (self.group,)
        return (f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} "
                f"ORDER BY {', '.join(f'`{c}`' for c in self.order)}")

    def position(self) -> Column:
        """0-based index of the row in its whole trajectory."""
        ordinal = f"CAST(row_number() OVER ({self.over()}) AS BIGINT) - 1"
        return F.expr(f"coalesce({POSITION}, {ordinal})" if self.blocked else ordinal)


def hot_groups(df: DataFrame, traj: Trajectory) -> list[tuple[object, int]]:
    """Groups that may exceed ``hot_rows`` with an estimate of their size.

    Only picks the physical layout: results do not depend on it. Rows are
    sampled just densely enough to see every such group, and at most
    2 * total / hot_rows groups can qualify, so the answer is small by construction.
    """
    fraction = min(1.0, SAMPLED_ROWS / traj.hot_rows)
    keys = df.select(F.col(traj.group).alias("k"))
    if fraction < 1.0:
        keys = keys.sample(fraction=fraction, seed=0)
    floor = traj.hot_rows * fraction / (1 if fraction == 1.0 else 2)
    seen = keys.groupBy("k").count().where(F.col("count") > floor).collect()
    return [(row["k"], int(row["count"] / fraction)) for row in seen]


def _in_blocks(df: DataFrame, traj: Trajectory, hot: list[tuple[object, int]],
               lookback: int) -> DataFrame:
    """``df`` plus block, halo flag and position; only hot trajectories are cut."""
    spark, group = df.sparkSession, traj.group
    size = max(traj.hot_rows, lookback)
    key_type = df.schema[group].dataType.simpleString()
    hot_keys = broadcast_if_small(
        spark.createDataFrame([(k,) for k, _ in hot], f"__k {key_type}"), len(hot))
    matches = F.col(group).eqNullSafe(F.col("__k"))
    rest = df.join(hot_keys, matches, "left_anti").withColumns({
        BLOCK: F.lit(0).cast("long"),
        HALO: F.lit(False),
        POSITION: F.lit(None).cast("long"),
    })
    parts = -(-sum(n for _, n in hot) // traj.hot_rows) + 1
    placed = place_in_order(df.join(hot_keys, matches, "left_semi"), (group, *traj.order), parts)
    numbered = number_rows(placed, (group,), POSITION, parts + len(hot))
    home = F.floor(F.col(POSITION) / size)
    near_end = F.pmod(F.col(POSITION), F.lit(size)) >= size - lookback
    cut = (
        numbered.withColumn("__home", home)
        .withColumn(
            BLOCK,
            F.explode(F.when(near_end, F.array(F.col("__home"), F.col("__home") + 1))
                      .otherwise(F.array(F.col("__home")))),
        )
        .withColumn(HALO, F.col(BLOCK) != F.col("__home"))
        .drop("__home")
    )
    return rest.unionByName(cut)


def on_trajectories(df: DataFrame, traj: Trajectory,
                    body: Callable[[DataFrame, Trajectory], DataFrame],
                    lookback: int) -> DataFrame:
    """Run ``body`` with windows over ``traj``.

    ``lookback`` is how many earlier rows any output of ``body`` depends on
    through its windows, nested windows added up. ``body`` must keep all rows
    and must not look ahead. Rows without a key belong to no trajectory: columns that
    ``body`` adds are NULL there, booleans false. Probes for hot trajectories with
    one job over a sparse sample of the key column while the plan is built.
    """
    require_columns(df, (traj.group, *traj.order), "a trajectory window")
    if traj.blocked:
        return body(df, traj)
    hot = hot_groups(df, traj)
    if not hot:
        return _without_strays(body(df, traj), df, traj)
    done = body(_in_blocks(df, traj, hot, lookback), replace(traj, blocked=True))
    return _without_strays(done.where(~F.col(HALO)).drop(BLOCK, HALO, POSITION), df, traj)


def _without_strays(done: DataFrame, df: DataFrame, traj: Trajectory) -> DataFrame:
    before = set(df.columns)
    if not df.schema[traj.group].nullable:
        return done
    stray = F.col(traj.group).isNull()
    return done.withColumns({
        f.name: F.when(~stray, F.col(f.name)).otherwise(
            F.lit(False if f.dataType.simpleString() == "boolean" else None))
        for f in done.schema if f.name not in before})

"""Labels of a new scrape day without labelling the whole history again.

The state is each item's last ``window`` + 1 raw rows: what the baseline of its next row and the run detector look back on.
New rows are labelled behind their item's state. Where a row arrives late, it and all later rows of its item are labelled
anew behind the rows before it, read from the history of these items alone. The result equals the full run row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrace.operators.spikes import detect_spikes
from faretrace.params import DEFAULTS, Params
from faretrace.plans.trajectory import Trajectory

LABELS = ("rollMean", "rollStd", "isLabelable", "spikeZ", "isSpike", "isSpikeEvent")
_SINCE, _ITEM = "__since", "__item"


def _place(traj: Trajectory) -> Column:
    return F.struct(*traj.order)


def _last(rows: DataFrame, traj: Trajectory, n: int) -> DataFrame:
    latest = Window.partitionBy(traj.group).orderBy(*(F.desc(c) for c in traj.order))
    return rows.withColumn("__back", F.row_number().over(latest)).where(F.col("__back") <= n).drop("__back")


def tail_state(rows: DataFrame, traj: Trajectory = Trajectory(), params: Params = DEFAULTS) -> DataFrame:
    """The last ``window`` + 1 rows of every item, without labels; rows without an item have no state."""
    return _last(rows.drop(*LABELS).where(F.col(traj.group).isNotNull()), traj, params.window + 1)


def next_state(state: DataFrame, new_rows: DataFrame, traj: Trajectory = Trajectory(), params: Params = DEFAULTS) -> DataFrame:
    """The state after ``new_rows``; late rows included, as a state holds the last rows by their order."""
    return tail_state(state.unionByName(new_rows.drop(*LABELS)), traj, params)


def first_new(new_rows: DataFrame, traj: Trajectory = Trajectory()) -> DataFrame:
    """(item, since): from which row on each item of ``new_rows`` changes."""
    return (new_rows.where(F.col(traj.group).isNotNull()).groupBy(F.col(traj.group).alias(_ITEM))
            .agg(F.min(_place(traj)).alias(_SINCE)))


def label_increment(state: DataFrame, new_rows: DataFrame, history: DataFrame, traj: Trajectory = Trajectory(),
                    params: Params = DEFAULTS) -> DataFrame:
    """Labelled rows that the table gains or that replace its own: ``new_rows``, and the rows behind late ones.

    ``history`` (all earlier rows, labelled or not) is read for items with late rows only, by a join on the item.
    """
    new_rows, history = new_rows.drop(*LABELS), history.drop(*LABELS).select(*new_rows.columns)
    firsts = first_new(new_rows, traj)
    newest = state.groupBy(F.col(traj.group).alias("__known")).agg(F.max(_place(traj)).alias("__newest"))
    late = firsts.join(newest, F.expr(f"{_ITEM} = __known AND {_SINCE} < __newest")).select(_ITEM, _SINCE)
    prompt = firsts.join(late.select(F.col(_ITEM).alias("__late")), F.expr(f"{_ITEM} = __late"), "left_anti")

    on_item = F.col(traj.group) == F.col(_ITEM)
    behind = state.select(*new_rows.columns).join(prompt, on_item, "left_semi")
    touched = history.join(late, on_item)
    before = _last(touched.where(_place(traj) < F.col(_SINCE)), traj, params.window + 1)
    context = touched.where(_place(traj) >= F.col(_SINCE)).unionByName(before).drop(_ITEM, _SINCE)

    done = detect_spikes(behind.unionByName(context).unionByName(new_rows), traj, params)
    return (done.join(firsts, on_item, "left").where(F.col(traj.group).isNull() | (_place(traj) >= F.col(_SINCE)))
            .drop(_ITEM, _SINCE))


def merged(table: DataFrame, increment: DataFrame, new_rows: DataFrame, traj: Trajectory = Trajectory()) -> DataFrame:
    """The labelled table with an increment in place of the rows that it replaces."""
    kept = (table.join(first_new(new_rows, traj), F.col(traj.group) == F.col(_ITEM), "left")
            .where(F.col(_SINCE).isNull() | (_place(traj) < F.col(_SINCE))).drop(_ITEM, _SINCE))
    return kept.unionByName(increment.select(*table.columns))

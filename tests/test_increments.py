"""Labels day by day against the full run, and clustered stages that are read without an exchange."""

import random
from datetime import date, timedelta

import pytest

from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, fare_obs
from faretrace.operators import increments as inc
from faretrace.operators.spikes import detect_spikes
from faretrace.plans.trajectory import Trajectory
from faretrace.sources import clustered
from faretrace.sources.ingest import clean

SCHEMA = "legId string, searchDate date, totalFare double"
START = date(2024, 1, 1)


def made(seed):
    """(row, day of arrival): most rows arrive on their day, some late."""
    rng = random.Random(seed)
    rows = []
    for leg in ("a", "b", "c", "d", "e", None):
        for d in range(rng.randrange(20, 40)):
            if rng.random() < 0.85:
                fare = rng.choice([100.0, 101.0, 102.0, 150.0, 180.0]) if rng.random() > 0.05 else None
                rows.append(((leg, START + timedelta(d), fare), d if rng.random() < 0.9 else d + rng.randrange(1, 9)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_day_by_day_equals_the_full_run(spark, seed):
    arrivals = made(seed)
    full = detect_spikes(spark.createDataFrame([r for r, _ in arrivals], SCHEMA), Trajectory(), FIXTURE)
    want = sorted(map(tuple, full.collect()), key=str)
    steps = [0, 14, 15, 21, 22, 23, 60]
    history = [r for r, at in arrivals if at < steps[1]]
    table = detect_spikes(spark.createDataFrame(history, SCHEMA), Trajectory(), FIXTURE)
    state = inc.tail_state(table, Trajectory(), FIXTURE)
    for low, high in zip(steps[1:], steps[2:]):
        new = spark.createDataFrame([r for r, at in arrivals if low <= at < high], SCHEMA)
        added = inc.label_increment(state, new, table, Trajectory(), FIXTURE)
        state = inc.next_state(state, new, Trajectory(), FIXTURE)
        table = inc.merged(table, added, new)
        held = [tuple(r) for r in table.collect()]
        table = spark.createDataFrame(held, full.schema)
        state = spark.createDataFrame([tuple(r) for r in state.collect()], SCHEMA)
        assert state.groupBy("legId").count().where(f"count > {FIXTURE.window + 1}").count() == 0
    assert sorted(held, key=str) == want


def test_prompt_rows_do_not_read_the_history(spark):
    rows = [r for r, _ in made(3) if r[0] is not None]
    old, new = ([r for r in rows if (r[1] < START + timedelta(18)) == before] for before in (True, False))
    frame = spark.createDataFrame(old, SCHEMA)
    added = inc.label_increment(inc.tail_state(frame, Trajectory(), FIXTURE), spark.createDataFrame(new, SCHEMA), frame.where("false"),
                                Trajectory(), FIXTURE)
    full = detect_spikes(spark.createDataFrame(rows, SCHEMA), Trajectory(), FIXTURE).where(f"searchDate >= '{START + timedelta(18)}'")
    assert sorted(map(tuple, added.collect()), key=str) == sorted(map(tuple, full.collect()), key=str)


def test_clustered_stage_needs_no_exchange(spark, sf, tmp_path):
    obs = fare_obs(spark, sf).transform(clean)
    table = clustered.write_clustered(obs, "stage_clustered", str(tmp_path / "stage"), FARE_TRAJECTORY, 4)
    other = clustered.write_clustered(obs.select("legId", "searchTs", "obsId", "seatsRemaining"), "stage_other",
                                      str(tmp_path / "other"), FARE_TRAJECTORY, 4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    labelled = detect_spikes(table, FARE_TRAJECTORY, FIXTURE)
    assert "Exchange" not in plan(labelled) and "Window" in plan(labelled)
    joined = table.join(other.withColumnRenamed("seatsRemaining", "s"), "legId").groupBy("legId").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = clustered.open_clustered(spark, "stage_again", str(tmp_path / "stage"), FARE_TRAJECTORY, 4)
    assert "Exchange" not in plan(detect_spikes(again, FARE_TRAJECTORY, FIXTURE))
    want = detect_spikes(obs, FARE_TRAJECTORY, FIXTURE)
    assert again.count() == obs.count() and labelled.select(want.columns).exceptAll(want).count() == 0
    for name in ("stage_clustered", "stage_other", "stage_again"):
        spark.sql(f"DROP TABLE {name}")

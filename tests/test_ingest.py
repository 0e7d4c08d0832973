"""CSV and Parquet round trips, cleaning and the stage contracts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, fare_obs
from faretrace.operators.features import observations_to_features
from faretrace.operators.spikes import add_days_before_departure, detect_spikes
from faretrace.schema import LABELLED_COLUMNS, MODEL_COLUMNS, MODELLING_COLUMNS, MissingColumns
from faretrace.sources import ingest


@pytest.fixture(scope="module")
def release(spark, sf, tmp_path_factory):
    """The adapter rows as a wide CSV release with two extra text columns."""
    path = str(tmp_path_factory.mktemp("release") / "itineraries")
    wide = fare_obs(spark, sf).select(
        *MODELLING_COLUMNS, F.lit("Airbus||").alias("segmentsEquipmentDescription"),
        F.lit(None).cast("string").alias("segmentsDistance"))
    wide.write.csv(path, header=True)
    return path


def test_load_raw_types_and_pruning(spark, release):
    df = ingest.load_raw(spark, release)
    assert tuple(df.columns) == MODELLING_COLUMNS
    assert dict(df.dtypes)["flightDate"] == "date"
    assert dict(df.dtypes)["isNonStop"] == "boolean"
    two = ingest.load_raw(spark, release, ["legId", "totalFare"])
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<legId:string,totalFare:double>" in plan
    assert len(ingest.load_raw(spark, release, None).columns) == 19
    with pytest.raises(MissingColumns, match="nope"):
        ingest.load_raw(spark, release, ["nope"])


def test_csv_round_trip_keeps_rows(spark, sf, release):
    a = ingest.load_raw(spark, release)
    b = fare_obs(spark, sf).select(*MODELLING_COLUMNS)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_nan_becomes_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text("legId,totalFare\na,NaN\nb,1.5\nc,\n")
    got = ingest.load_raw(spark, str(tmp_path / "x.csv"), ["legId", "totalFare"]).orderBy("legId").collect()
    assert [r["totalFare"] for r in got] == [None, 1.5, None]


def test_missing_sources(spark, tmp_path):
    with pytest.raises(ingest.SourceMissing, match="no observation file"):
        ingest.load_raw(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ingest.SourceMissing, match="no stage table"):
        ingest.read_stage(spark, str(tmp_path / "absent.parquet"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_extract_subset(spark, sf, release, tmp_path, fmt):
    target = str(tmp_path / "subset")
    ingest.extract_subset(spark, release, target, ["JFK-LAX"], fmt)
    back = spark.read.parquet(target) if fmt == "parquet" else ingest.load_raw(spark, target, None)
    assert back.count() == fare_obs(spark, sf).where("startingAirport = 'JFK'").count()
    assert len(back.columns) == 19
    report = ingest.row_count_report(back, expected=back.count()).first()
    assert report["as_expected"]


def test_coach_filter_and_route(spark):
    df = spark.createDataFrame(
        [("coach", "A", "B"), ("coach||coach", None, "B"), ("coach||business", "A", "B"), (None, "A", "B")],
        "segmentsCabinCode string, startingAirport string, destinationAirport string")
    assert [r["route"] for r in ingest.clean(df).orderBy("route").collect()] == [None, "A-B"]
    report = ingest.coach_filter_report(df).first()
    assert (report["before"], report["after"], report["removed_pct"]) == (4, 2, 50.0)
    with pytest.raises(MissingColumns, match="segmentsCabinCode"):
        ingest.filter_coach_only(df.drop("segmentsCabinCode"))


def test_variants_leave_the_frame_alone(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, totalFare double")
    leaky = df.withColumn("totalFareCopy", F.col("totalFare"))
    assert leaky.drop("totalFareCopy").columns == df.columns
    assert "totalFareCopy" not in df.columns


def test_load_clean_and_stage_tables(spark, release, tmp_path):
    cleaned = ingest.load_clean(spark, release)
    assert cleaned.columns == [*MODELLING_COLUMNS, "route"]
    coach, labelled, model = (str(tmp_path / n) for n in ("coach", "labelled", "model"))
    ingest.write_coach_filtered(cleaned, coach)
    stage = ingest.read_stage(spark, coach)
    assert sorted(stage.columns) == sorted([*MODELLING_COLUMNS, "route"])
    assert stage.count() == cleaned.count()
    pruned = stage.where("route = 'JFK-LAX'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(route" in pruned

    kept = ingest.departing_by(stage, date(2024, 2, 6)).withColumn("obsId", F.xxhash64("*"))
    pushed = kept._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(flightDate,2024-02-06)" in pushed
    spiked = detect_spikes(add_days_before_departure(kept).withColumn("searchTs", F.col("searchDate")),
                           FARE_TRAJECTORY, FIXTURE)
    ingest.write_labelled(spiked, labelled)
    assert tuple(ingest.read_stage(spark, labelled).columns) == LABELLED_COLUMNS


def test_model_stage(spark, sf, tmp_path):
    frame = observations_to_features(fare_obs(spark, sf).transform(ingest.clean), FARE_TRAJECTORY, FIXTURE)
    path = str(tmp_path / "model")
    ingest.write_model_frame(frame, path, partitions=4)
    back = ingest.read_stage(spark, path)
    assert tuple(back.columns) == MODEL_COLUMNS
    assert back.count() == frame.where("isLabelable").count()
    assert back.where("zLag1 IS NULL").count() == 0


def test_preview_and_shape(spark):
    df = spark.range(20).withColumn("x", F.lit(1))
    assert ingest.preview(df, 3).count() == 3
    assert tuple(ingest.shape(df).first()) == (20, 2)


def test_unreadable_cells_are_counted(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    (tmp_path / "bad.csv").write_text("legId,totalFare,flightDate\na,12.5,2022-05-01\nb,oops,2022-13-01\nc,,2022-05-02\nd,x1,\n")
    got = ingest.unreadable_cells(spark, path, ["legId", "totalFare", "flightDate"]).collect()
    assert {tuple(r) for r in got} == {("totalFare", 2), ("flightDate", 1)}

"""Sources, sinks, guards and catalogues on the supplied tables: written and read back, or refused."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, fare_obs
from faretrace.operators import features as feats, increments, spikes, splits
from faretrace.plans.trajectory import on_trajectories
from faretrace.schema import (
    FEATURE_COLUMNS, FEATURE_GROUPS, LEAKY_COLUMNS, MODELLING_COLUMNS, MissingColumns,
)
from faretrace.session import cut_lineage, ensure_checkpoint_dir
from faretrace.sources import clustered, ingest
from registry.core import features, labelled, model_rows, observations, query, sql
from registry.split_queries import FARE_FOLDS, fare_folds


def shared_folder(spark, name):
    """A new folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def refused(error, fn):
    try:
        fn()
    except error:
        return True
    return False


def _release(spark, sf):
    """The observations as a CSV release with two more text columns."""
    path = shared_folder(spark, "release")
    fare_obs(spark, sf).select(
        *MODELLING_COLUMNS, F.lit("Airbus||").alias("segmentsEquipmentDescription"),
        F.lit(None).cast("string").alias("segmentsDistance")).write.csv(path, header=True)
    return path


READ_BACK = "legId, searchDate, flightDate, travelDuration, totalFare, seatsRemaining, totalTravelDistance, isNonStop, segmentsAirlineName"


@query("s3_csv_read_back", sql(f"SELECT {READ_BACK} FROM fare"), doubles="totalFare totalTravelDistance")
def _(spark, sf):
    return ingest.load_raw(spark, _release(spark, sf), READ_BACK.split(", "))


@query("s4_all_columns", sql("SELECT count(*) AS rows, CAST(19 AS BIGINT) AS columns FROM fare"))
def _(spark, sf):
    return ingest.shape(ingest.load_raw(spark, _release(spark, sf), None))


def _refusals(df, cases):
    """(case, refused, rows) of guards tried on a frame."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    table = df.sparkSession.createDataFrame([(name, bool(found)) for name, found in cases], "case string, refused boolean")
    return table.withColumn("rows", rows.scalar())


def _refusals_sql(cases, source):
    listed = ", ".join(f"('{c}', {str(r).lower()})" for c, r in cases)
    return sql(f"SELECT \"case\", refused, (SELECT count(*) FROM {source} ) AS rows FROM (VALUES {listed}) AS t(\"case\", refused)")


@query("s5_missing_source", _refusals_sql([("raw", True), ("stage", True), ("present", False)], "fare"))
def _(spark, sf):
    absent = shared_folder(spark, "absent")
    return _refusals(fare_obs(spark, sf), [
        ("raw", refused(ingest.SourceMissing, lambda: ingest.load_raw(spark, f"{absent}.csv"))),
        ("stage", refused(ingest.SourceMissing, lambda: ingest.read_stage(spark, absent))),
        ("present", refused(ingest.SourceMissing, lambda: ingest.read_stage(spark, f"{sf}/events.parquet")))])


@query("s7_coach_stage", sql("SELECT legId, searchDate, totalFare, seatsRemaining, route FROM coach"), doubles="totalFare")
def _(spark, sf):
    path = shared_folder(spark, "coach")
    ingest.write_coach_filtered(observations(spark, sf), path)
    return ingest.read_stage(spark, path, ["legId", "searchDate", "totalFare", "seatsRemaining", "route"])


@query("s9_labelled_stage", sql("SELECT legId, searchDate, totalFare, isLabelable, isSpike, isSpikeEvent FROM labelled"),
       doubles="totalFare")
def _(spark, sf):
    path = shared_folder(spark, "labelled")
    ingest.write_labelled(labelled(spark, sf), path)
    return ingest.read_stage(spark, path, ["legId", "searchDate", "totalFare", "isLabelable", "isSpike", "isSpikeEvent"])


@query("s10_model_stage", sql("SELECT legId, flightDate, observationIndex, fareLag1, zLag1, isSpikeEvent FROM model"),
       doubles="fareLag1 zLag1")
def _(spark, sf):
    path = shared_folder(spark, "model")
    ingest.write_model_frame(features(spark, sf), path)
    return ingest.read_stage(spark, path).selectExpr(
        "legId", "flightDate", "CAST(observationIndex AS BIGINT) AS observationIndex", "fareLag1", "zLag1", "isSpikeEvent")


@query("p10_required_columns", _refusals_sql(
    [("segmentsCabinCode", True), ("rollStd", True), ("flightDate", True), ("all there", False)], "fare"))
def _(spark, sf):
    obs = fare_obs(spark, sf)
    based = spikes.add_rolling_stats(observations(spark, sf), FARE_TRAJECTORY)
    return _refusals(obs, [
        ("segmentsCabinCode", refused(MissingColumns, lambda: ingest.filter_coach_only(obs.drop("segmentsCabinCode")))),
        ("rollStd", refused(MissingColumns, lambda: spikes.label_spikes(based.drop("rollStd"), FARE_TRAJECTORY))),
        ("flightDate", refused(MissingColumns, lambda: splits.rolling_origin_splits(obs.drop("flightDate"), 1, 7))),
        ("all there", refused(MissingColumns, lambda: ingest.filter_coach_only(obs)))])


@query("p11_column_variants", sql("""SELECT route, count(*) AS rows, sum(totalFare) AS with_copy, false AS kept_copy FROM coach GROUP BY route"""),
       doubles="with_copy")
def _(spark, sf):
    obs = observations(spark, sf)
    leaky = obs.withColumn("fareCopy", F.col("totalFare"))
    dropped = leaky.drop("fareCopy")
    return leaky.groupBy("route").agg(F.count(F.lit(1)).alias("rows"), F.sum("fareCopy").alias("with_copy"),
                                      F.lit("fareCopy" in dropped.columns).alias("kept_copy"))


@query("a31_feature_catalog", sql("\n UNION ALL ".join(
    f"SELECT '{g}' AS \"group\", CAST({len(names)} AS INTEGER) AS n, '{', '.join(names)}' AS features, "
    f"{' + '.join(f'count({c})' for c in names)} AS cells FROM feat" for g, names in FEATURE_GROUPS.items())))
def _(spark, sf):
    filled = _filled(spark, sf).join(feats.feature_groups(spark), "feature").groupBy("group").agg(F.sum("cells").alias("cells"))
    return feats.feature_catalog(spark).join(filled, "group")


def _filled(spark, sf):
    """(feature, cells): non-null cells of every predictor, from one aggregate."""
    counts = features(spark, sf).agg(*(F.count(c).alias(c) for c in FEATURE_COLUMNS))
    pairs = ", ".join(f"struct('{c}' AS feature, `{c}` AS cells)" for c in FEATURE_COLUMNS)
    return counts.selectExpr(f"inline(array({pairs}))")


@query("e5_feature_columns", sql("\n UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{g}' AS \"group\", count({c}) AS cells FROM feat" for g, names in FEATURE_GROUPS.items() for c in names)))
def _(spark, sf):
    return _filled(spark, sf).join(feats.feature_groups(spark), "feature")


@query("o1_trajectory_sort", sql("""SELECT legId, obsId, row_number() OVER (PARTITION BY legId ORDER BY searchTs, obsId) - 1 AS place
 FROM coach"""))
def _(spark, sf):
    shuffled = observations(spark, sf).repartition(F.col("obsId"))
    placed = on_trajectories(shuffled, FARE_TRAJECTORY, lambda d, t: d.withColumn("place", t.position()), 1)
    return placed.selectExpr("legId", "obsId", "CAST(place AS BIGINT) AS place")


@query("x3_leaky_columns", sql("\n UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS cells FROM feat" for c in sorted(LEAKY_COLUMNS))))
def _(spark, sf):
    frame = features(spark, sf)
    shared = sorted(set(frame.columns) & LEAKY_COLUMNS)
    pairs = ", ".join(f"struct('{c}' AS column_name, `{c}` AS cells)" for c in shared)
    return frame.agg(*(F.count(c).alias(c) for c in shared)).selectExpr(f"inline(array({pairs}))")


@query("e6_leak_guard", _refusals_sql([("predictors", False), *((c, True) for c in sorted(LEAKY_COLUMNS))], "feat"))
def _(spark, sf):
    def tried(*more):
        return refused(feats.LeakyFeatures, lambda: feats.assert_no_leaky_features([*FEATURE_COLUMNS, *more]))

    return _refusals(features(spark, sf), [("predictors", tried()), *((c, tried(c)) for c in sorted(LEAKY_COLUMNS))])


@query("v2_layout_errors", _refusals_sql([("no folds", True), ("short history", True), ("no rows", True), ("as published", False)], "model"))
def _(spark, sf):
    rows = model_rows(spark, sf)
    return _refusals(rows, [
        ("no folds", refused(ValueError, lambda: splits.rolling_origin_splits(rows, 0))),
        ("short history", refused(ValueError, lambda: splits.rolling_origin_splits(rows, 2, 7, min_train_days=400))),
        ("no rows", refused(ValueError, lambda: splits.rolling_origin_splits(rows.where("false"), 1, 7))),
        ("as published", refused(ValueError, lambda: fare_folds(rows)))])


@query("v8_fold_accessors", sql("""SELECT fold, count(*) FILTER (WHERE flightDate BETWEEN train_start AND train_end) AS n_train,
 count(*) FILTER (WHERE flightDate BETWEEN test_start AND test_end) AS n_test, 'fold ' || fold || ': train ' || train_start || '..' || train_end
 || ', test ' || test_start || '..' || test_end AS text
FROM model, folds GROUP BY fold, train_start, train_end, test_start, test_end""", FARE_FOLDS))
def _(spark, sf):
    rows = model_rows(spark, sf)
    folds = fare_folds(rows)
    return spark.createDataFrame([(f.index, f.n_train(rows), f.n_test(rows), str(f)) for f in folds],
                                 "fold int, n_train long, n_test long, text string")


LABELLED_ROWS = "legId, obsId, rollMean, rollStd, isLabelable, isSpike, isSpikeEvent"


@query("s9_clustered_labels", sql(f"SELECT {LABELLED_ROWS} FROM labelled"), doubles="rollMean rollStd")
def _(spark, sf):
    """Labels computed from an item-clustered stage, without an exchange."""
    table = clustered.write_clustered(observations(spark, sf), f"stage_{uuid.uuid4().hex}", shared_folder(spark, "clustered"),
                                      FARE_TRAJECTORY, 16)
    return spikes.detect_spikes(table, FARE_TRAJECTORY, FIXTURE).select(*LABELLED_ROWS.split(", "))


@query("l5_incremental_labels", sql(f"SELECT {LABELLED_ROWS} FROM labelled"), doubles="rollMean rollStd")
def _(spark, sf):
    """The history up to a day, then two more batches; one row in fifty comes a batch late."""
    obs = cut_lineage(observations(spark, sf).withColumn("batch", F.expr(
        "CASE WHEN searchDate < DATE'2024-01-20' THEN 0 WHEN searchDate < DATE'2024-01-27' THEN 1 ELSE 2 END "
        "+ CAST(obsId % 50 = 0 AND searchDate < DATE'2024-01-27' AS INT)")))
    first = obs.where("batch = 0").drop("batch")
    table = cut_lineage(spikes.detect_spikes(first, FARE_TRAJECTORY, FIXTURE))
    state = increments.tail_state(table, FARE_TRAJECTORY, FIXTURE)
    for batch in (1, 2):
        new = obs.where(F.col("batch") == batch).drop("batch")
        added = increments.label_increment(state, new, table, FARE_TRAJECTORY, FIXTURE)
        state = cut_lineage(increments.next_state(state, new, FARE_TRAJECTORY, FIXTURE))
        table = cut_lineage(increments.merged(table, added, new, FARE_TRAJECTORY))
    return table.select(*LABELLED_ROWS.split(", "))

"""Scores against brute force, and boosted trees behind their guards."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from faretrace.fixtures import FIXTURE
from faretrace.models import boosting, forecast, scoring
from faretrace.operators.features import LeakyFeatures
from faretrace.operators.splits import GroupLeakage, rolling_origin_splits
from faretrace.schema import FEATURE_COLUMNS
from registry.core import model_rows
from registry.split_queries import fare_folds


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(9)
    rows = [(rng.random() < 0.3, round(rng.random(), 2)) for _ in range(600)]
    return spark.createDataFrame(rows, "label boolean, score double").cache(), rows


@pytest.mark.parametrize("parts", [1, 11])
def test_roc_auc_with_ties(predictions, parts):
    df, rows = predictions
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert scoring.roc_auc(df, parts=parts).first()["roc_auc"] == pytest.approx(want)


@pytest.mark.parametrize("parts", [1, 5])
def test_roc_auc_of_groups(spark, parts):
    rng = random.Random(10)
    rows = [(rng.choice("abc"), rng.random() < 0.3, round(rng.random(), 1)) for _ in range(500)] + [("d", True, 0.5)]
    df = spark.createDataFrame(rows, "g string, label boolean, score double").cache()
    got = {r["g"]: r["roc_auc"] for r in scoring.roc_auc_by(df, ["g"], parts=parts).collect()}
    assert set(got) == set("abcd") and got["d"] is None
    for g in "abc":
        assert got[g] == pytest.approx(scoring.roc_auc(df.where(f"g = '{g}'")).first()["roc_auc"])


def test_roc_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(True, 0.1)], "label boolean, score double")
    assert scoring.roc_auc(df).first()["roc_auc"] is None


@pytest.mark.parametrize("parts", [1, 11])
def test_best_threshold(predictions, parts):
    df, rows = predictions

    def f1(t):
        tp = sum(y and s >= t for y, s in rows)
        fp = sum(not y and s >= t for y, s in rows)
        fn = sum(y and s < t for y, s in rows)
        return 2 * tp / (2 * tp + fp + fn)

    best = max({s for _, s in rows}, key=lambda t: (f1(t), t))
    got = scoring.best_threshold(df, parts=parts).first()
    assert (got["threshold"], got["f1"]) == (best, pytest.approx(f1(best)))


def test_threshold_scores_without_positives(spark):
    df = spark.createDataFrame([(False, 0.1), (True, 0.2)], "label boolean, score double")
    row = scoring.threshold_scores(df).first()
    assert (row["tp"], row["fn"], row["precision"], row["recall"], row["f1"]) == (0, 1, 0.0, 0.0, 0.0)


def test_class_weight(spark):
    df = spark.createDataFrame([(i % 5 == 0,) for i in range(20)], "isSpikeEvent boolean")
    assert scoring.class_weight(df).first()["scale_pos_weight"] == 4.0
    assert scoring.class_weight(df.where("NOT isSpikeEvent")).first()["scale_pos_weight"] == 16.0


def test_regression_errors_and_ranks(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, 2.0), (1, "a", 1.0, 4.0), (1, "b", 1.0, 1.5), (1, "b", 1.0, None)],
        "fold int, model string, y double, yhat double")
    scores = scoring.regression_errors(df, "y", "yhat", ["fold", "model"])
    rows = {r["model"]: r for r in scores.collect()}
    assert rows["a"]["rmse"] == pytest.approx(5 ** 0.5) and rows["a"]["mae"] == 2.0
    assert rows["b"]["rows"] == 1
    ranked = scoring.compare_models(scores, "rmse")
    assert {r["model"]: r["fold_rank"] for r in ranked.collect()} == {"a": 2, "b": 1}
    assert scoring.model_means(ranked, "rmse").where("model = 'b'").first()["folds_won"] == 1


@pytest.fixture(scope="module")
def study(spark, sf):
    rows = model_rows(spark, sf).cache()
    folds = rolling_origin_splits(rows, 1, 14, min_train_days=7)
    return rows, folds[0]


SMALL = replace(FIXTURE, max_depth=3, min_route_rows=50)


def test_leak_lifts_the_score(study):
    rows, fold = study
    got = {r["model"]: r for r in boosting.leakage_demo(rows, fold, SMALL, trees=3).collect()}
    assert got["with_total_fare"]["roc_auc"] > got["legitimate"]["roc_auc"] + 0.1


def test_fit_refuses_leaks(study):
    rows, fold = study
    design = boosting.design_matrix(rows, extra=["totalFare"])
    with pytest.raises(LeakyFeatures, match="totalFare"):
        boosting.fit_classifier(design, fold, [*FEATURE_COLUMNS, "totalFare"], SMALL, trees=1)
    spread = design.withColumn("legId", F.lit("same"))
    with pytest.raises(GroupLeakage):
        boosting.fit_classifier(spread, fold, params=SMALL, trees=1)


def test_importances(study):
    rows, fold = study
    fit = boosting.fit_classifier(boosting.design_matrix(rows), fold, params=SMALL, trees=2)
    table = boosting.importance_table(fit, rows).cache()
    assert table.count() == 32 and table.where("group IS NULL").count() == 0
    assert table.agg(F.sum("importance_pct")).first()[0] == pytest.approx(100.0)
    assert boosting.top_features(table).count() == 12
    assert boosting.importance_by_group(table).count() == 5


def test_route_importance_skips_thin_routes(study):
    rows, fold = study
    sizes = {r["route"]: r["count"] for r in
             rows.where(F.col("flightDate") < fold.test_start).groupBy("route").count().collect()}
    floor = max(sizes.values())
    got = boosting.route_importance(rows, fold, replace(SMALL, min_route_rows=floor), trees=1)
    assert len(got.columns) == 1 + sum(n >= floor for n in sizes.values())
    assert got.count() == 31


def test_autoregression_forecasts_only_test_dates(spark):
    from registry.core import observations
    obs = observations(spark, "/root/testdata/sf0.01")
    fold = fare_folds(obs)[-1]
    got = forecast.autoregression_forecast(obs, fold, FIXTURE).collect()
    assert got and all(fold.test_start <= r["flightDate"] <= fold.test_end for r in got)
    assert all(r["forecast"] is not None for r in got)

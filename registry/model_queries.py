"""Scores, forecasters and boosted trees on the supplied tables.

Fits use the published numbers of trees. Their SQL twins hold what does not depend on the trees: fold sizes and class
counts of the scored rows, and the ranges that scores and shares must lie in.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.fixtures import FIXTURE, PRICE_TRAJECTORY, price_obs
from faretrace.models import boosting, forecast, sarima, scoring
from faretrace.operators import spikes
from faretrace.schema import FEATURE_GROUPS
from faretrace.session import cut_lineage
from registry.core import model_rows, observations, query, sql
from registry.split_queries import FARE_FOLDS, fare_folds, folds_cte

#: a fixed scoring rule in (0, 1), so that scores have an SQL twin
SCORE_SQL = ("scores", """SELECT isSpikeEvent AS label, 0.5 - zLag1 / (2 * (1 + abs(zLag1))) AS score
 FROM model WHERE zLag1 IS NOT NULL""")


def scores(spark, sf):
    return model_rows(spark, sf).where("zLag1 IS NOT NULL").selectExpr(
        "isSpikeEvent AS label", "0.5D - zLag1 / (2 * (1 + abs(zLag1))) AS score")


@query("m1_class_weight", sql("""
SELECT neg AS negatives, pos AS positives, CAST(neg AS DOUBLE) / greatest(pos, 1) AS scale_pos_weight
FROM (SELECT count(*) FILTER (WHERE NOT isSpikeEvent) AS neg, count(*) FILTER (WHERE isSpikeEvent) AS pos
 FROM model, (SELECT * FROM folds WHERE fold = 1) AS f WHERE flightDate BETWEEN train_start AND train_end) AS c""",
    FARE_FOLDS), doubles="scale_pos_weight")
def _(spark, sf):
    rows = model_rows(spark, sf)
    return scoring.class_weight(fare_folds(rows)[0].train(rows))


@query("m3_threshold_scores", sql("""
SELECT tp, fp, fn, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
 2.0 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0) AS f1
FROM (SELECT count(*) FILTER (WHERE score >= 0.5 AND label) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT label) AS fp,
 count(*) FILTER (WHERE score < 0.5 AND label) AS fn FROM scores) AS c""", SCORE_SQL),
    doubles="precision recall f1")
def _(spark, sf):
    return scoring.threshold_scores(scores(spark, sf))


@query("m4_roc_auc", sql("""
SELECT (sum(r) FILTER (WHERE label) - p * (p + 1) / 2.0) / (p * n) AS roc_auc FROM (
 SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
  CAST(count(*) FILTER (WHERE label) OVER () AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE NOT label) OVER () AS DOUBLE) AS n
 FROM scores) AS t GROUP BY p, n""", SCORE_SQL), doubles="roc_auc")
def _(spark, sf):
    return scoring.roc_auc(scores(spark, sf))


@query("m4_roc_auc_orders", """
SELECT (sum(r) FILTER (WHERE label) - p * (p + 1) / 2.0) / (p * n) AS roc_auc FROM (
 SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
  CAST(count(*) FILTER (WHERE label) OVER () AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE NOT label) OVER () AS DOUBLE) AS n
 FROM (SELECT l_returnflag = 'R' AS label, l_quantity AS score FROM lineitem) AS s) AS t GROUP BY p, n""",
    doubles="roc_auc")
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return scoring.roc_auc(lines.select((F.col("l_returnflag") == "R").alias("label"),
                                        F.col("l_quantity").alias("score")))


@query("m9_best_threshold", sql("""
SELECT threshold, f1 FROM (SELECT score AS threshold, 2.0 * tp / (tp + fp + p) AS f1 FROM (
  SELECT score, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS p
  FROM (SELECT score, count(*) FILTER (WHERE label) AS pos, count(*) FILTER (WHERE NOT label) AS neg FROM scores GROUP BY score) AS g
  WINDOW w AS (ORDER BY score DESC)) AS s) AS t ORDER BY f1 DESC, threshold DESC LIMIT 1""", SCORE_SQL),
    doubles="threshold f1")
def _(spark, sf):
    return scoring.best_threshold(scores(spark, sf))


@query("m10_regression_errors", sql("""
SELECT count(*) AS rows, sqrt(avg((rollMean - totalFare) * (rollMean - totalFare))) AS rmse, avg(abs(rollMean - totalFare)) AS mae
FROM model WHERE rollMean IS NOT NULL"""), doubles="rmse mae")
def _(spark, sf):
    return scoring.regression_errors(model_rows(spark, sf), "totalFare", "rollMean")


@query("m10_regression_errors_price", sql("""
SELECT route, count(*) AS rows, sqrt(avg((m - totalFare) * (m - totalFare))) AS rmse, avg(abs(m - totalFare)) AS mae
FROM (SELECT *, CASE WHEN count(totalFare) OVER f >= 5 THEN avg(totalFare) OVER f END AS m FROM price
 WINDOW f AS (PARTITION BY legId ORDER BY shipTs, orderKey, lineNumber, suppKey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS t
WHERE m IS NOT NULL GROUP BY route"""), doubles="rmse mae")
def _(spark, sf):
    based = spikes.add_rolling_stats(price_obs(spark, sf), PRICE_TRAJECTORY)
    return scoring.regression_errors(based, "totalFare", "rollMean", ["route"])


BASELINES = ("baselines", """SELECT fold, model, count(*) AS n, sqrt(avg((x - totalFare) * (x - totalFare))) AS rmse, avg(abs(x - totalFare)) AS mae
 FROM (SELECT fold, totalFare, 'last_fare' AS model, fareLag1 AS x FROM tested
  UNION ALL SELECT fold, totalFare, 'rolling_mean', rollMean FROM tested
  UNION ALL SELECT fold, totalFare, 'drift', fareLag1 + fareChangeLag1 FROM tested) AS u WHERE x IS NOT NULL GROUP BY 1, 2""")
TESTED = ("tested", "SELECT m.*, fold FROM model AS m, folds WHERE flightDate BETWEEN test_start AND test_end")


@query("m11_model_comparison", sql("""
SELECT fold, model, rmse, CAST(rank() OVER (PARTITION BY fold ORDER BY rmse) AS INTEGER) AS fold_rank FROM baselines""",
    FARE_FOLDS, TESTED, BASELINES), doubles="rmse")
def _(spark, sf):
    rows = model_rows(spark, sf)
    return scoring.compare_models(forecast.baseline_scores(rows, fare_folds(rows)), "rmse")


@query("m11_model_means", sql("""
SELECT model, avg(rmse) AS mean_rmse, avg(r) AS mean_rank, count(*) FILTER (WHERE r = 1) AS folds_won
FROM (SELECT model, rmse, rank() OVER (PARTITION BY fold ORDER BY rmse) AS r FROM baselines) AS t GROUP BY model""",
    FARE_FOLDS, TESTED, BASELINES), doubles="mean_rmse mean_rank")
def _(spark, sf):
    rows = model_rows(spark, sf)
    ranked = scoring.compare_models(forecast.baseline_scores(rows, fare_folds(rows)), "rmse")
    return scoring.model_means(ranked, "rmse")


@query("m12_seasonal_naive", sql("""
SELECT route, flightDate, mean_fare, lag(mean_fare, 7) OVER (PARTITION BY route ORDER BY flightDate) AS forecast
FROM (SELECT flightDate, route, avg(totalFare) AS mean_fare FROM coach GROUP BY 1, 2) AS d"""),
    doubles="mean_fare forecast")
def _(spark, sf):
    return forecast.seasonal_naive(observations(spark, sf))


@query("m12_autoregression")
def _(spark, sf):
    obs = observations(spark, sf)
    parts = [forecast.autoregression_forecast(obs, fold, FIXTURE).select(F.lit(fold.index).alias("fold"), "*")
             for fold in fare_folds(obs)]
    return reduce(DataFrame.unionByName, parts)


@query("m12_sarima")
def _(spark, sf):
    obs = observations(spark, sf)
    return sarima.forecasts(obs, fare_folds(obs), params=FIXTURE)


OBS_FOLDS = folds_cte("obs_folds", "obs", "flightDate", FIXTURE.n_splits, FIXTURE.test_days)


# lags of 8 days and then of 7 leave the 16th training day of a route as its first complete one
@query("m12_sarima_days", sql("""
SELECT fold, d.route, flightDate, mean_fare, n > 7 AND (SELECT count(*) FROM days AS t WHERE t.route = d.route AND t.flightDate
  BETWEEN train_start AND train_end) >= 16 AS has_forecast
FROM days AS d, obs_folds WHERE flightDate BETWEEN test_start AND test_end""", OBS_FOLDS, ("days", """
SELECT *, row_number() OVER (PARTITION BY route ORDER BY flightDate) AS n
FROM (SELECT flightDate, route, avg(totalFare) AS mean_fare FROM coach GROUP BY 1, 2) AS a""")), doubles="mean_fare")
def _(spark, sf):
    obs = observations(spark, sf)
    found = sarima.forecasts(obs, fare_folds(obs), params=FIXTURE)
    return found.selectExpr("fold", "route", "flightDate", "mean_fare", "forecast IS NOT NULL AS has_forecast")


def fit_rows(spark, sf):
    """Model rows, windowed once: folds, codes, designs and scores read them again and again."""
    return cut_lineage(model_rows(spark, sf))


@query("m12_boosted_fare_regression")
def _(spark, sf):
    rows = fit_rows(spark, sf)
    return boosting.fare_regressor_scores(rows, fare_folds(rows), FIXTURE)


@query("m2_fit_and_score")
def _(spark, sf):
    rows = fit_rows(spark, sf)
    with boosting.kept(boosting.design_matrix(rows)) as design:
        scored, _ = boosting.fit_and_score(design, fare_folds(rows)[0], "boosted_trees",
                                           params=FIXTURE)
    return scored


@query("m5_leakage_demo")
def _(spark, sf):
    rows = fit_rows(spark, sf)
    return boosting.leakage_demo(rows, fare_folds(rows)[0], FIXTURE)


def _fitted_importance(spark, sf):
    rows = fit_rows(spark, sf)
    with boosting.kept(boosting.design_matrix(rows)) as design:
        fit = boosting.fit_classifier(design, fare_folds(rows)[0], params=FIXTURE)
    return boosting.importance_table(fit, rows)


@query("m6_top_features")
def _(spark, sf):
    return boosting.top_features(_fitted_importance(spark, sf))


@query("j6_importance_by_group")
def _(spark, sf):
    return boosting.importance_by_group(_fitted_importance(spark, sf))


@query("m7_route_importance")
def _(spark, sf):
    rows = fit_rows(spark, sf)
    return boosting.route_importance(rows, fare_folds(rows)[0], FIXTURE)


@query("m8_weighting_comparison")
def _(spark, sf):
    rows = fit_rows(spark, sf)
    return boosting.weighting_comparison(rows, fare_folds(rows)[0], FIXTURE)


@query("m11_walk_forward_classifiers")
def _(spark, sf):
    rows = fit_rows(spark, sf)
    table = boosting.walk_forward(rows, fare_folds(rows), FIXTURE)
    return scoring.compare_models(table, "roc_auc", higher_is_better=True)


# ---- what fitted studies show whatever their trees -----------------------

#: trees of the studies below: class counts, test rows and ranges do not depend on their number
COUNTED_TREES = 10

_SCORED = """SELECT fold, model, count(*) AS rows, count(*) FILTER (WHERE isSpikeEvent) AS positives, true AS in_range,
 count(*) FILTER (WHERE isSpikeEvent) > 0 AND count(*) FILTER (WHERE NOT isSpikeEvent) > 0 AS has_auc
FROM tested, (VALUES {0}) AS m(model) {1} GROUP BY fold, model"""


def _scored_sql(models, only=""):
    return sql(_SCORED.format(", ".join(f"('{m}')" for m in models), only), FARE_FOLDS, TESTED)


def _scored_counts(scored, rows, folds):
    """Counts behind the scores of fits, beside the test rows of their folds."""
    tested = " ".join(f"WHEN {f.in_test()} THEN {f.index}" for f in folds)
    sizes = rows.groupBy(F.expr(f"CASE {tested} END AS tested_fold")).agg(F.count(F.lit(1)).alias("rows"))
    if "fold" not in scored.columns:
        scored = scored.withColumn("fold", F.lit(folds[0].index))
    shares = " AND ".join(f"{c} BETWEEN 0 AND 1" for c in ("precision", "recall", "f1", "coalesce(roc_auc, 0D)"))
    return scored.join(sizes, F.col("fold") == F.col("tested_fold")).selectExpr(
        "fold", "model", "rows", "tp + fn AS positives", f"{shares} AND tp + fp <= rows AS in_range", "roc_auc IS NOT NULL AS has_auc")


@query("m2_scored_counts", _scored_sql(["boosted_trees"], "WHERE fold = 1"))
def _(spark, sf):
    rows = fit_rows(spark, sf)
    folds = fare_folds(rows)
    with boosting.kept(boosting.design_matrix(rows)) as design:
        scored, _ = boosting.fit_and_score(design, folds[0], "boosted_trees", params=FIXTURE, trees=COUNTED_TREES)
    return _scored_counts(scored, rows, folds)


@query("m5_scored_counts", _scored_sql(["legitimate", "with_total_fare"], "WHERE fold = 1"))
def _(spark, sf):
    rows = fit_rows(spark, sf)
    folds = fare_folds(rows)
    return _scored_counts(boosting.leakage_demo(rows, folds[0], FIXTURE, COUNTED_TREES), rows, folds)


@query("m8_scored_counts", _scored_sql(["unweighted", "class_weighted"], "WHERE fold = 1"))
def _(spark, sf):
    rows = fit_rows(spark, sf)
    folds = fare_folds(rows)
    return _scored_counts(boosting.weighting_comparison(rows, folds[0], FIXTURE, COUNTED_TREES), rows, folds)


@query("m11_scored_counts", _scored_sql(["unweighted", "class_weighted"]))
def _(spark, sf):
    rows = fit_rows(spark, sf)
    folds = fare_folds(rows)
    return _scored_counts(boosting.walk_forward(rows, folds, FIXTURE, COUNTED_TREES), rows, folds)


@query("m12_forecast_counts", sql("SELECT fold, 'boosted_trees' AS model, count(*) AS rows, true AS in_range FROM tested "
                                  "WHERE totalFare IS NOT NULL GROUP BY fold", FARE_FOLDS, TESTED))
def _(spark, sf):
    rows = fit_rows(spark, sf)
    scored = boosting.fare_regressor_scores(rows, fare_folds(rows), FIXTURE, COUNTED_TREES)
    return scored.selectExpr("fold", "model", "rows", "rmse >= mae AND mae >= 0 AS in_range")


_CATALOG = ", ".join(f"('{c}', '{g}')" for g, columns in FEATURE_GROUPS.items() for c in columns)


def _counted_importance(spark, sf):
    rows = fit_rows(spark, sf)
    with boosting.kept(boosting.design_matrix(rows)) as design:
        fit = boosting.fit_classifier(design, fare_folds(rows)[0], params=FIXTURE, trees=COUNTED_TREES)
    return boosting.importance_table(fit, rows)


@query("m6_importance_catalog", f"""SELECT feature, "group", true AS in_range, CAST(100 AS DOUBLE) AS total_pct
FROM (VALUES {_CATALOG}) AS t(feature, "group")""", doubles="total_pct")
def _(spark, sf):
    table = _counted_importance(spark, sf)
    return table.withColumn("total_pct", table.agg(F.sum("importance_pct")).scalar()).selectExpr(
        "feature", "`group`", "importance_pct BETWEEN 0 AND 100 AS in_range", "total_pct")


@query("j6_group_catalog", f"""SELECT "group", true AS in_range, CAST(100 AS DOUBLE) AS total_pct
FROM (SELECT DISTINCT "group" FROM (VALUES {_CATALOG}) AS t(feature, "group")) AS g""", doubles="total_pct")
def _(spark, sf):
    groups = boosting.importance_by_group(_counted_importance(spark, sf))
    return groups.withColumn("total_pct", groups.agg(F.sum("importance_pct")).scalar()).selectExpr(
        "`group`", "importance_pct BETWEEN 0 AND 100 AS in_range", "total_pct")


@query("m7_route_catalog", sql(f"""SELECT replace(route, '-', '_') AS route, count(DISTINCT feature) AS n_features, CAST(100 AS DOUBLE) AS total_pct
FROM (SELECT route FROM model, folds WHERE fold = 1 AND flightDate < test_start AND route IS NOT NULL GROUP BY route
 HAVING count(*) >= {FIXTURE.min_route_rows}) AS r, (VALUES {_CATALOG}) AS t(feature, "group") WHERE feature <> 'route' GROUP BY 1""",
    FARE_FOLDS), doubles="total_pct")
def _(spark, sf):
    rows = fit_rows(spark, sf)
    wide = boosting.route_importance(rows, fare_folds(rows)[0], FIXTURE, COUNTED_TREES)
    if len(wide.columns) == 1:  # no route has enough rows
        wide = wide.withColumn("none", F.lit(0.0)).limit(0)
    long = wide.unpivot(["feature"], wide.columns[1:], "route", "pct")
    return long.groupBy("route").agg(F.count("pct").alias("n_features"), F.sum("pct").alias("total_pct"))

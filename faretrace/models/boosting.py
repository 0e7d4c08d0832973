"""Boosted trees on the predictors, with the leakage guard in front of every fit.

All fits of a study are one batch (see ``histboost``): folds, routes, weightings and sets of predictors share the jobs of
each level. Missing numbers stay missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrace.models import scoring
from faretrace.models.histboost import Forest, Settings, Task, fit_many, predictions
from faretrace.operators.features import (
    assert_no_leaky_features, encode, feature_groups,
)
from faretrace.operators.splits import Fold, assert_no_group_leakage
from faretrace.params import DEFAULTS, Params
from faretrace.schema import FEATURE_COLUMNS
from faretrace.session import cut_lineage


SCORES = ("tp", "fp", "fn", "precision", "recall", "f1", "roc_auc")


@dataclass(frozen=True)
class Fit:
    """A fitted model with the fold it was trained on; the fold's test rows are its own."""

    forest: Forest
    fold: Fold
    depth: int

    def predict(self, design: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(label, ``keep``, score) of all rows of ``design``."""
        scored = predictions(design, [self.forest], ["true"], keep, self.depth)
        return scored.select(F.col("y").alias("label"), *keep, "score")

    def importance(self) -> list[tuple[str, float]]:
        return self.forest.importance()


def design_matrix(model_rows: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS,
                  extra: Sequence[str] = (), label: str = "isSpikeEvent",
                  date_col: str = "flightDate") -> DataFrame:
    """Encoded predictors with label, date and route kept beside them.

    Encode once; every fold, route and feature variant reads this frame.
    """
    kept = model_rows.withColumns({
        "label": F.col(label).cast("double"), "routeName": F.col("route"),
        "totalFareTarget": F.col("totalFare"),
    })
    wanted = [*columns, *extra]
    return encode(kept, wanted).select(
        "legId", date_col, "routeName", "label", "totalFareTarget", *wanted)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Hold a frame that several fits read. It is written once, in partitions that follow its size: a persisted frame keeps
    all shuffle partitions, and each of its many readers takes a task for every one of them."""
    yield cut_lineage(df)


def _table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as a frame, by way of Arrow: a list of tuples would start Python workers to be read."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    names, types = zip(*(column.rsplit(" ", 1) for column in schema.split(", ")))
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(x, kinds[t]) for x, t in zip(columns, types, strict=True)], names=list(names)))


def _settings(params: Params, trees: int | None) -> Settings:
    return Settings(trees or params.n_trees, params.max_depth, params.learning_rate)


def _classifier(name: str, fold: Fold, columns: Sequence[str], weighted: bool) -> Task:
    return Task(name, fold.in_train(), tuple(columns), positive_weight=None if weighted else 1.0)


def fit_classifiers(design: DataFrame, folds: Fold | Sequence[Fold], tasks: Sequence[Task], params: Params = DEFAULTS,
                    trees: int | None = None, allow_leaks: bool = False) -> list[Fit]:
    """Boosted trees for each (fold, task), in one batch.

    Both guards run first: no predictor may give the label away (unless the leak is
    the thing under study) and no trajectory may straddle a fold.
    """
    folds = [folds] * len(tasks) if isinstance(folds, Fold) else list(folds)
    for task in tasks:
        if not allow_leaks:
            assert_no_leaky_features(task.columns)
    assert_no_group_leakage(design, list(dict.fromkeys(folds)))
    settings = _settings(params, trees)
    forests = fit_many(design, tasks, settings)
    return [Fit(forest, fold, settings.depth) for forest, fold in zip(forests, folds, strict=True)]


def fit_classifier(design: DataFrame, fold: Fold, columns: Sequence[str] = FEATURE_COLUMNS,
                   params: Params = DEFAULTS, trees: int | None = None, weighted: bool = True,
                   allow_leaks: bool = False) -> Fit:
    """Class-weighted boosted trees on the fold's training rows, behind both guards."""
    task = _classifier("boosted_trees", fold, columns, weighted)
    return fit_classifiers(design, fold, [task], params, trees, allow_leaks)[0]


def score_classifiers(fits: Sequence[Fit], design: DataFrame) -> DataFrame:
    """(fold, model, tp, fp, fn, precision, recall, f1, roc_auc): each fit on its fold's test rows, all in one pass.

    Evaluated at once, so that the caller may release ``design`` afterwards.
    """
    scored = predictions(design, [f.forest for f in fits], [f.fold.in_test() for f in fits], depth=fits[0].depth)
    with kept(scored.select("fit", F.col("y").alias("label"), "score")) as predicted:
        at_half = {r["fit"]: r for r in scoring.threshold_scores(predicted, by=["fit"]).collect()}
        auc = {r["fit"]: r["roc_auc"] for r in scoring.roc_auc_by(predicted, ["fit"]).collect()}
    rows = [(f.fold.index, f.forest.task.name, *[at_half[i][c] for c in SCORES[:-1]], auc.get(i))
            for i, f in enumerate(fits) if i in at_half]
    return _table(
        design.sparkSession, rows, "fold int, model string, tp long, fp long, fn long, precision double, recall double, f1 double, roc_auc double")


def score_classifier(fit: Fit, design: DataFrame, fold: Fold, name: str) -> DataFrame:
    """One row (model, tp, fp, fn, precision, recall, f1, roc_auc) on the fold's test rows."""
    return score_classifiers([Fit(fit.forest, fold, fit.depth)], design).select(F.lit(name).alias("model"), *SCORES)


def fit_and_score(design: DataFrame, fold: Fold, name: str,
                  columns: Sequence[str] = FEATURE_COLUMNS, params: Params = DEFAULTS,
                  trees: int | None = None, weighted: bool = True,
                  allow_leaks: bool = False) -> tuple[DataFrame, Fit]:
    fit = fit_classifier(design, fold, columns, params, trees, weighted, allow_leaks)
    return score_classifier(fit, design, fold, name), fit


def leakage_demo(model_rows: DataFrame, fold: Fold, params: Params = DEFAULTS,
                 trees: int | None = None) -> DataFrame:
    """The same fit with and without the predicted fare among the predictors."""
    assert_no_leaky_features(FEATURE_COLUMNS)
    tasks = [_classifier("legitimate", fold, FEATURE_COLUMNS, True),
             _classifier("with_total_fare", fold, [*FEATURE_COLUMNS, "totalFare"], True)]
    with kept(design_matrix(model_rows, extra=["totalFare"])) as design:
        fits = fit_classifiers(design, fold, tasks, params, trees, allow_leaks=True)
        return score_classifiers(fits, design).drop("fold")


def weighting_comparison(model_rows: DataFrame, fold: Fold, params: Params = DEFAULTS,
                         trees: int | None = None) -> DataFrame:
    """Unweighted baseline beside the class-weighted fit."""
    tasks = [_classifier("unweighted", fold, FEATURE_COLUMNS, False),
             _classifier("class_weighted", fold, FEATURE_COLUMNS, True)]
    with kept(design_matrix(model_rows)) as design:
        return score_classifiers(fit_classifiers(design, fold, tasks, params, trees), design).drop("fold")


def importance_table(fit: Fit, model_rows: DataFrame) -> DataFrame:
    """(feature, group, importance_pct): one row per predictor."""
    spark = model_rows.sparkSession
    rows = _table(spark, fit.importance(), "feature string, importance double")
    groups = F.broadcast(feature_groups(spark))  # fixed at 32 rows
    return rows.join(groups, "feature", "left").select(
        "feature", "group", (F.col("importance") * 100).alias("importance_pct"))


def top_features(importance: DataFrame, k: int = 12) -> DataFrame:
    return importance.orderBy(F.desc("importance_pct"), "feature").limit(k)


def importance_by_group(importance: DataFrame) -> DataFrame:
    return importance.groupBy("group").agg(F.sum("importance_pct").alias("importance_pct"))


def before_test(model_rows: DataFrame, fold: Fold) -> DataFrame:
    """Rows that depart before the fold's test window."""
    return model_rows.where(F.to_date(fold.date_col) < F.lit(fold.test_start))


def route_sizes(rows: DataFrame, least: int, route: str = "route") -> DataFrame:
    """(route, rows) of the routes present with at least that many rows."""
    return (rows.where(F.col(route).isNotNull()).groupBy(F.col(route).alias("route"))
            .agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least))


def route_importance(model_rows: DataFrame, fold: Fold, params: Params = DEFAULTS,
                     trees: int | None = None) -> DataFrame:
    """(feature, one column per route): importances of separate fits per route present.

    A fit uses the route's rows departing before the fold's test window; routes
    with fewer than ``min_route_rows`` of them are left out. Route sizes come from
    one aggregate, and all routes are fitted in one batch.
    """
    columns = [c for c in FEATURE_COLUMNS if c != "route"]
    assert_no_leaky_features(columns)
    early = f"to_date(`{fold.date_col}`) < DATE '{fold.test_start}'"
    with kept(design_matrix(model_rows, columns)) as design:
        routes = sorted(r["route"] for r in
                        route_sizes(before_test(design, fold), params.min_route_rows, "routeName").collect())
        tasks = [Task(r, f"{early} AND routeName = {_quoted(r)}", tuple(columns), positive_weight=None) for r in routes]
        forests = fit_many(design, tasks, _settings(params, trees or params.route_trees))
    schema = ", ".join(["feature string", *[f"{r.replace('-', '_')} double" for r in routes]])
    shares = [dict(f.importance()) for f in forests]
    rows = [(c, *[100 * share[c] for share in shares]) for c in columns]
    return _table(model_rows.sparkSession, rows, schema)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fare_regressor_scores(model_rows: DataFrame, folds: Sequence[Fold],
                          params: Params = DEFAULTS, trees: int | None = None) -> DataFrame:
    """(fold, model, rows, rmse, mae) of boosted regression of the fare on every fold, all folds in one batch."""
    assert_no_leaky_features(FEATURE_COLUMNS)
    settings = _settings(params, trees)
    tasks = [Task("boosted_trees", f.in_train(), FEATURE_COLUMNS, "totalFareTarget", squared=True) for f in folds]
    with kept(design_matrix(model_rows)) as design:
        forests = fit_many(design, tasks, settings)
        scored = predictions(design, forests, [f.in_test() for f in folds], depth=settings.depth)
        got = {r["fit"]: r for r in scoring.regression_errors(scored, "y", "score", ["fit"]).collect()}
    rows = [(f.index, "boosted_trees", got[i]["rows"], got[i]["rmse"], got[i]["mae"]) for i, f in enumerate(folds) if i in got]
    return _table(
        model_rows.sparkSession, rows, "fold int, model string, rows long, rmse double, mae double")


def walk_forward(model_rows: DataFrame, folds: Sequence[Fold], params: Params = DEFAULTS,
                 trees: int | None = None) -> DataFrame:
    """(fold, model, tp, fp, fn, precision, recall, f1, roc_auc) of the weighted and unweighted classifiers on every fold, all
    in one batch."""
    pairs = [(fold, _classifier(name, fold, FEATURE_COLUMNS, weighted))
             for fold in folds for name, weighted in (("unweighted", False), ("class_weighted", True))]
    with kept(design_matrix(model_rows)) as design:
        fits = fit_classifiers(design, [fold for fold, _ in pairs], [task for _, task in pairs], params, trees)
        return score_classifiers(fits, design)

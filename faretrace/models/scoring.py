"""Scores of predictions held in a DataFrame: every one is an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretrace.functions.frames import ratio
from faretrace.plans.ordering import running_totals
from faretrace.session import cut_lineage


def class_weight(train: DataFrame, label: str = "isSpikeEvent") -> DataFrame:
    """One row: negatives, positives and the weight that balances the positives."""
    positive = f"coalesce(CAST(`{label}` AS BOOLEAN), false)"
    return train.agg(F.expr(f"count_if(NOT {positive}) AS negatives"),
                     F.expr(f"count_if({positive}) AS positives")).withColumn(
        "scale_pos_weight", F.expr("negatives / greatest(positives, 1)"))


def threshold_scores(predictions: DataFrame, label: str = "label", score: str = "score",
                     threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of the positive class; an empty denominator scores 0."""
    said, true = f"{score} >= {threshold}D", f"CAST(`{label}` AS BOOLEAN)"
    counted = predictions.groupBy(*by).agg(
        F.expr(f"count_if({said} AND {true}) AS tp"),
        F.expr(f"count_if({said} AND NOT {true}) AS fp"),
        F.expr(f"count_if(NOT ({said}) AND {true}) AS fn"))

    def share(part: str, whole: str, name: str) -> str:
        return f"coalesce({ratio(f'CAST({part} AS DOUBLE)', whole)}, 0D) AS {name}"

    return counted.selectExpr(
        *by, "tp", "fp", "fn", share("tp", "tp + fp", "precision"),
        share("tp", "tp + fn", "recall"), share("2 * tp", "2 * tp + fp + fn", "f1"))


def score_counts(predictions: DataFrame, label: str, score: str) -> DataFrame:
    """(s, pos, neg) per distinct score: ties collapse before anything is ordered."""
    true = f"CAST(`{label}` AS BOOLEAN)"
    return predictions.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.expr(f"count_if({true}) AS pos"), F.expr(f"count_if(NOT {true}) AS neg"))


#: distinct scores that one task may order; beyond it the order is distributed
ONE_TASK_SCORES = 100_000


def _fixed(counts: DataFrame, parts: int | None) -> tuple[DataFrame, int | None]:
    """Score counts, made once, and how many parts to order them in: their number is known once they are counted."""
    counts = cut_lineage(counts)
    if parts is None and counts.count() <= ONE_TASK_SCORES:
        parts = 1
    return counts, parts


def roc_auc(predictions: DataFrame, label: str = "label", score: str = "score",
            parts: int | None = None) -> DataFrame:
    """Exact ROC AUC with half credit on ties: one row ``roc_auc`` (NULL for one class)."""
    counts, parts = _fixed(score_counts(predictions, label, score), parts)
    ranked = running_totals(counts, ["s"], {"neg_upto": "neg"}, parts)
    totals = ranked.agg(F.expr("sum(pos * (neg_upto - neg / 2D)) AS won"),
                        F.expr("sum(CAST(pos AS DOUBLE)) AS p"), F.expr("sum(neg) AS n"))
    return totals.selectExpr(f"{ratio('won', 'p * n')} AS roc_auc")


def roc_auc_by(predictions: DataFrame, by: Sequence[str], label: str = "label", score: str = "score",
               parts: int | None = None) -> DataFrame:
    """(``by``, roc_auc) of every group from one order: a group's running counts begin at its least one."""
    true = f"CAST(`{label}` AS BOOLEAN)"
    counts = predictions.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(
        F.expr(f"count_if({true}) AS pos"), F.expr(f"count_if(NOT {true}) AS neg"))
    counts, parts = _fixed(counts, parts)
    ranked = running_totals(counts, [*by, "s"], {"neg_upto": "neg"}, parts)
    totals = ranked.groupBy(*by).agg(
        F.expr("sum(pos * (neg_upto - neg / 2D)) - min(neg_upto - neg) * sum(pos) AS won"),
        F.expr("sum(CAST(pos AS DOUBLE)) AS p"), F.expr("sum(neg) AS n"))
    return totals.selectExpr(*by, f"{ratio('won', 'p * n')} AS roc_auc")


def best_threshold(predictions: DataFrame, label: str = "label", score: str = "score",
                   parts: int | None = None) -> DataFrame:
    """Threshold (score >= t is positive) with the highest F1; ties take the higher one."""
    # read twice; fixed once, so that what makes the scores runs once
    counts, parts = _fixed(score_counts(predictions, label, score), parts)
    counts = counts.withColumn("rank_key", -F.col("s"))
    total = counts.agg(F.sum("pos").alias("p")).scalar()
    swept = running_totals(counts, ["rank_key"], {"tp": "pos", "fp": "neg"}, parts)
    f1 = f"coalesce({ratio('2D * tp', 'tp + fp + p')}, 0D)"
    return swept.withColumn("p", total).agg(
        F.expr(f"max(struct({f1} AS f1, s AS threshold)) AS best")
    ).select("best.threshold", "best.f1")


def regression_errors(predictions: DataFrame, truth: str, forecast: str,
                      by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and the number of compared rows; rows without a forecast are not compared."""
    error = F.col(forecast) - F.col(truth)
    return predictions.where(error.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"))


def compare_models(scores: DataFrame, metric: str, higher_is_better: bool = False) -> DataFrame:
    """Rank models within every fold; ``scores`` has one row per (fold, model)."""
    best_first = F.desc(metric) if higher_is_better else F.asc(metric)
    ranked = scores.withColumn(
        "fold_rank", F.rank().over(Window.partitionBy("fold").orderBy(best_first)))
    return ranked.select("fold", "model", metric, "fold_rank")


def model_means(ranked: DataFrame, metric: str) -> DataFrame:
    """Mean score, mean rank and number of won folds per model."""
    return ranked.groupBy("model").agg(
        F.avg(metric).alias(f"mean_{metric}"), F.avg("fold_rank").alias("mean_rank"),
        F.expr("count_if(fold_rank = 1) AS folds_won"))

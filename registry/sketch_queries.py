"""Answers from merged daily sketches beside the exact ones: counts must be equal, estimates within their stated errors."""

from pyspark.sql import functions as F

from faretrace.operators import sketches, splits
from faretrace.operators.asof import in_intervals
from registry.core import observations, query, sql
from registry.split_queries import LEAKAGE, ORDER_FOLDS, ORDER_DAY, _orders

FRACTIONS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

MONTHS = """months AS (SELECT DISTINCT date_trunc('month', flightDate) AS m FROM obs),
 spans AS (SELECT CAST(m AS DATE) AS fold, 'month' AS side, CAST(m AS DATE) AS s, last_day(CAST(m AS DATE)) AS e FROM months
 UNION ALL SELECT CAST(m AS DATE), 'until', (SELECT CAST(min(m) AS DATE) FROM months), last_day(CAST(m AS DATE)) FROM months)"""


def _spans(obs):
    """Each month, and everything up to its end."""
    months = obs.where("flightDate IS NOT NULL").select(F.trunc("flightDate", "month").alias("fold")).distinct()
    first = months.agg(F.min("fold")).first()[0]
    return months.selectExpr("fold", "'month' AS side", "fold AS start", "last_day(fold) AS `end`").union(
        months.select("fold", F.lit("until"), F.lit(first).cast("date"), F.expr("last_day(fold)")))


@query("a10_sketched_quantiles", sql(f"""SELECT fold AS month, side AS span, route, count(totalFare) AS n,
 TRUE AS q25_within, TRUE AS q50_within, TRUE AS q75_within
FROM (WITH {MONTHS} SELECT spans.fold, spans.side, obs.route, obs.totalFare FROM obs JOIN spans ON flightDate BETWEEN s AND e) AS t
WHERE totalFare IS NOT NULL GROUP BY fold, side, route"""))
def _(spark, sf):
    obs = observations(spark, sf).select("route", "flightDate", "totalFare")
    spans = _spans(obs)
    got = sketches.quantiles_between(sketches.daily_quantiles(obs, "totalFare", ["route"]), spans, FRACTIONS, ["route"])
    fares = in_intervals(obs, spans, "flightDate").where("totalFare IS NOT NULL")
    ranks = fares.join(got, ["fold", "side", "route"]).groupBy("fold", "side", "route", "n").agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.expr(f"count_if(totalFare < {q}) AS {q}_under") for q in FRACTIONS),
        *(F.expr(f"count_if(totalFare <= {q}) AS {q}_upto") for q in FRACTIONS))
    # twice the error that 99 of 100 keep to
    off = 2 * sketches.rank_error()
    return ranks.where("n = rows").select(F.col("fold").alias("month"), F.col("side").alias("span"), "route", "n", *(
        F.expr(f"{q}_under <= ({f} + {off}) * n AND {q}_upto >= ({f} - {off}) * n").alias(f"{q}_within") for q, f in FRACTIONS.items()))


@query("v5_sketched_leakage", f"""SELECT fold, test_groups, leaking_groups, TRUE AS test_within, TRUE AS leaking_within
FROM ({sql(LEAKAGE, ORDER_FOLDS, ("keyed", f"SELECT o_custkey AS g, {ORDER_DAY} AS d FROM orders"))}) AS q""")
def _(spark, sf):
    orders = _orders(spark, sf)
    folds = splits.rolling_origin_splits(orders, date_col="day")
    # sketches far smaller than the key sets, so that estimates are estimates
    daily = sketches.daily_keys(orders, "o_custkey", "day", 7)
    near = sketches.leakage_estimates(daily, sketches.fold_intervals(orders, folds), 7).selectExpr(
        "fold", "test_groups AS test_near", "leaking_groups AS leaking_near", "error_groups")
    return splits.group_leakage(orders, folds, "o_custkey").join(near, "fold").select(
        "fold", "test_groups", "leaking_groups", F.expr("abs(test_groups - test_near) <= error_groups").alias("test_within"),
        F.expr("abs(leaking_groups - leaking_near) <= error_groups").alias("leaking_within"))

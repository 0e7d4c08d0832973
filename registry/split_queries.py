"""Validation folds, leakage checks and fold tables on the supplied tables."""

from pyspark.sql import functions as F

from faretrace.fixtures import FIXTURE, table
from faretrace.operators import splits
from registry.core import model_rows, query, sql


def folds_cte(name: str, source: str, day: str, n: int, test_days: int, gap: int = 0,
              train_days: int | None = None) -> tuple[str, str]:
    """Walk-forward fold dates straight from the definition (without empty test windows)."""
    slide = f"greatest(lo, te - {train_days - 1})" if train_days else "lo"
    return name, f"""SELECT CAST(row_number() OVER (ORDER BY ts) AS INTEGER) AS fold, train_start, te AS train_end, ts AS test_start, test_end
 FROM (SELECT {slide} AS train_start, te, ts, least(ts + {test_days - 1}, hi) AS test_end, lo, hi FROM (
  SELECT ts, ts - {1 + gap} AS te, lo, hi FROM (
   SELECT CAST(hi + 1 - {n * test_days} + CAST(k AS INTEGER) * {test_days} AS DATE) AS ts, lo, hi
   FROM (SELECT min({day}) AS lo, max({day}) AS hi FROM {source} ) AS ends, range({n}) AS r(k)) AS a) AS b
  WHERE EXISTS (SELECT 1 FROM {source} WHERE {day} BETWEEN ts AND ts + {test_days - 1})) AS c"""


FARE_FOLDS = folds_cte("folds", "model", "flightDate", 3, 7)
SEARCH_FOLDS = folds_cte("folds", "model", "searchDate", 2, 7)
ORDER_DAY = "CAST(o_orderdate AS DATE)"
ORDER_FOLDS = folds_cte("folds", "orders", ORDER_DAY, 5, 14)
FOLD_COLUMNS = "fold, train_start, train_end, test_start, test_end"


def fare_folds(rows):
    return splits.rolling_origin_splits(
        rows, FIXTURE.n_splits, FIXTURE.test_days, min_train_days=FIXTURE.min_train_days)


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))


@query("v1_rolling_origin", sql(f"SELECT {FOLD_COLUMNS} FROM folds", FARE_FOLDS))
def _(spark, sf):
    return splits.folds_frame(spark, fare_folds(model_rows(spark, sf)))


@query("v1_rolling_origin_orders", sql(f"SELECT {FOLD_COLUMNS} FROM folds", ORDER_FOLDS))
def _(spark, sf):
    return splits.folds_frame(spark, splits.rolling_origin_splits(_orders(spark, sf), date_col="day"))


@query("v3_sliding_with_gap", sql(f"SELECT {FOLD_COLUMNS} FROM folds", folds_cte(
    "folds", "orders", ORDER_DAY, 4, 21, gap=3, train_days=90)))
def _(spark, sf):
    return splits.folds_frame(spark, splits.rolling_origin_splits(
        _orders(spark, sf), 4, 21, "day", gap_days=3, train_days=90))


@query("v4_chronological", """
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
numbered AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n,
 min(d) OVER () AS lo, max(d) OVER () AS hi FROM days)
SELECT CAST(1 AS INTEGER) AS fold, lo AS train_start, CAST(d - 3 AS DATE) AS train_end, d AS test_start, hi AS test_end
FROM numbered WHERE i = CAST(floor(n * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE))) AS BIGINT)""")
def _(spark, sf):
    return splits.folds_frame(spark, splits.chronological_split(
        _orders(spark, sf), 0.2, "day", gap_days=2))


@query("j2_fold_assignment", sql("""
SELECT f.fold, 'train' AS side, legId, obsId FROM model JOIN folds AS f ON flightDate BETWEEN train_start AND train_end
UNION ALL SELECT f.fold, 'test', legId, obsId FROM model JOIN folds AS f ON flightDate BETWEEN test_start AND test_end""",
    FARE_FOLDS))
def _(spark, sf):
    rows = model_rows(spark, sf)
    return splits.assign_folds(rows, fare_folds(rows)).select("fold", "side", "legId", "obsId")


LEAKAGE = """
SELECT f.fold, count(*) FILTER (WHERE te > 0) AS test_groups, count(*) FILTER (WHERE te > 0 AND tr > 0) AS leaking_groups,
 coalesce(100.0 * CAST(count(*) FILTER (WHERE te > 0 AND tr > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE te > 0), 0), 0) AS leaking_pct
FROM (SELECT fold, g, count(*) FILTER (WHERE d BETWEEN train_start AND train_end) AS tr,
  count(*) FILTER (WHERE d BETWEEN test_start AND test_end) AS te FROM keyed, folds GROUP BY fold, g) AS f GROUP BY f.fold"""


@query("v5_group_leakage", sql(LEAKAGE, FARE_FOLDS, (
    "keyed", "SELECT legId AS g, flightDate AS d FROM model")), doubles="leaking_pct")
def _(spark, sf):
    rows = model_rows(spark, sf)
    return splits.group_leakage(rows, fare_folds(rows))


@query("v6_leakage_on_search_date", sql(LEAKAGE, SEARCH_FOLDS, (
    "keyed", "SELECT legId AS g, searchDate AS d FROM model")), doubles="leaking_pct")
def _(spark, sf):
    rows = model_rows(spark, sf)
    wrong = splits.rolling_origin_splits(rows, 2, 7, "searchDate", min_train_days=7)
    return splits.group_leakage(rows, wrong)


@query("v6_leakage_orders", sql(LEAKAGE, ORDER_FOLDS, (
    "keyed", f"SELECT o_custkey AS g, {ORDER_DAY} AS d FROM orders")), doubles="leaking_pct")
def _(spark, sf):
    orders = _orders(spark, sf)
    return splits.group_leakage(orders, splits.rolling_origin_splits(orders, date_col="day"),
                                "o_custkey")


@query("x1_shared_groups", sql(f"""
SELECT DISTINCT o_custkey FROM orders, (SELECT * FROM folds WHERE fold = 1) AS f WHERE {ORDER_DAY} BETWEEN train_start AND train_end
INTERSECT SELECT DISTINCT o_custkey FROM orders, (SELECT * FROM folds WHERE fold = 1) AS f WHERE {ORDER_DAY} BETWEEN test_start AND test_end""",
    ORDER_FOLDS))
def _(spark, sf):
    orders = _orders(spark, sf)
    first = splits.rolling_origin_splits(orders, date_col="day")[0]
    return splits.shared_groups(orders, first, "o_custkey")


@query("x2_distinct_dates", f"SELECT DISTINCT {ORDER_DAY} AS day FROM orders")
def _(spark, sf):
    return splits.distinct_dates(_orders(spark, sf), "day")


DESCRIBE = """
SELECT {cols}, count(*) FILTER (WHERE d BETWEEN train_start AND train_end) AS train_rows,
 count(*) FILTER (WHERE d BETWEEN test_start AND test_end) AS test_rows,
 count(DISTINCT g) FILTER (WHERE d BETWEEN train_start AND train_end) AS train_flights,
 count(DISTINCT g) FILTER (WHERE d BETWEEN test_start AND test_end) AS test_flights{extra}
FROM keyed, folds GROUP BY {cols}"""
POSITIVES = """,
 count(*) FILTER (WHERE y AND d BETWEEN test_start AND test_end) AS test_positives,
 round_even(100.0 * CAST(count(*) FILTER (WHERE y AND d BETWEEN test_start AND test_end) AS DOUBLE)
  / count(*) FILTER (WHERE d BETWEEN test_start AND test_end), 2) AS test_pos_rate_pct"""


@query("v7_describe_folds", sql(DESCRIBE.format(cols=FOLD_COLUMNS, extra=POSITIVES), FARE_FOLDS, (
    "keyed", "SELECT legId AS g, flightDate AS d, isSpikeEvent AS y FROM model")),
    doubles="test_pos_rate_pct")
def _(spark, sf):
    rows = model_rows(spark, sf)
    return splits.describe_folds(rows, fare_folds(rows))


@query("v7_describe_folds_orders", sql(DESCRIBE.format(cols=FOLD_COLUMNS, extra=""), ORDER_FOLDS, (
    "keyed", f"SELECT o_custkey AS g, {ORDER_DAY} AS d FROM orders")))
def _(spark, sf):
    orders = _orders(spark, sf)
    return splits.describe_folds(orders, splits.rolling_origin_splits(orders, date_col="day"),
                                 label_col=None, group_col="o_custkey")


@query("p5_order_cutoff_count", f"SELECT count(*) AS rows FROM orders WHERE {ORDER_DAY} <= DATE '1997-06-30'")
def _(spark, sf):
    from datetime import date
    from faretrace.sources.ingest import departing_by
    return departing_by(_orders(spark, sf), date(1997, 6, 30), "day").agg(
        F.count(F.lit(1)).alias("rows"))



"""Exact interpolated quantiles that never gather one group's values in one task.

Values are first collapsed to (group, value, count) rows with map-side
combining. While the distinct values per group are few, Spark's ``percentile``
with a frequency column finishes the job. Otherwise each wanted rank is
narrowed by histogram passes over the collapsed rows until its bracket is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrace.plans.ordering import broadcast_if_small
from faretrace.session import cut_lineage

#: distinct values of one group that one task may hold
DISTINCT_LIMIT = 1_000_000
BUCKETS = 4_096
GROUP, QUANTILE = "__group", "__quantile"


def collapsed(df: DataFrame, value: Column, by: Sequence[str] = (),
              extra: dict[str, Column] | None = None) -> DataFrame:
    """(group columns, v, n, extra sums) with one row per distinct value and group, NULL values too.

    Groups are named ``GROUP`` + position, so no caller's column can clash with an
    internal one. The table is fixed by a checkpoint: all that is read off it shares
    one scan and one shuffle of ``df``. Runs a job.
    """
    extra = extra or {}
    keyed = df.select(*[F.col(c).alias(f"{GROUP}{i}") for i, c in enumerate(by)],
                      value.cast("double").alias("v"),
                      *[c.alias(name) for name, c in extra.items()])
    keys = [f"{GROUP}{i}" for i in range(len(by))]
    return cut_lineage(keyed.groupBy(*keys, "v").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in extra]))


def exact_quantiles(df: DataFrame, value: str | Column, fractions: dict[str, float],
                    by: Sequence[str] = (), limit: int = DISTINCT_LIMIT) -> DataFrame:
    """One row per group: the ``by`` columns and one double per named fraction.

    Linear interpolation between the two neighbouring order statistics. Runs jobs
    while the plan is built: one collapses the values, one counts the widest group.
    """
    value = F.col(value) if isinstance(value, str) else value
    return quantiles_of(collapsed(df, value, by), fractions, by, limit)


def quantiles_of(table: DataFrame, fractions: dict[str, float], by: Sequence[str] = (),
                 limit: int = DISTINCT_LIMIT) -> DataFrame:
    """The same from a ``collapsed`` table; the route follows its counted rows."""
    keys = [f"{GROUP}{i}" for i in range(len(by))]
    counts = table.where("v IS NOT NULL").select(*keys, "v", "n")
    widest = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if widest > limit:
        found = _narrowed(counts, fractions, keys, limit)
    else:
        wanted = F.array(*[F.lit(float(f)) for f in fractions.values()])
        found = counts.groupBy(*keys).agg(F.percentile("v", wanted, F.col("n")).alias("q")).select(
            *keys, *[F.get("q", F.lit(i)).alias(f"{QUANTILE}{i}") for i in range(len(fractions))])
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)],
                        *[F.col(f"{QUANTILE}{i}").alias(name) for i, name in enumerate(fractions)])


def _targets(counts: DataFrame, fractions: dict[str, float], by: list[str]) -> DataFrame:
    """Two 0-based ranks per group and fraction, each with its starting bracket."""
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.count(F.lit(1)).alias("inside"),
    )
    ranks = []
    for name, fraction in fractions.items():
        at = (F.col("total") - 1) * F.lit(float(fraction))
        for side, rank in (("lower", F.floor(at)), ("upper", F.ceil(at))):
            ranks.append(F.struct(
                F.lit(name).alias("name"), F.lit(side).alias("side"),
                rank.alias("rank"), (at - F.floor(at)).alias("weight"),
            ))
    return totals.select(
        *by, "lo", "hi", "inside", F.lit(0).cast("long").alias("below"),
        F.inline(F.array(*ranks)),
    )


def _narrowed(counts: DataFrame, fractions: dict[str, float], by: list[str],
              limit: int) -> DataFrame:
    key = [*by, "name", "side"]
    bracket = cut_lineage(_targets(counts, fractions, by))
    rows, widest = _state(bracket)
    while widest > limit:
        bracket = cut_lineage(_one_pass(counts, bracket, by, key, rows))
        before, (rows, widest) = widest, _state(bracket)
        if widest >= before:  # doubles cannot be told apart any further
            break
    last = Window.partitionBy(*key).orderBy("v")
    hits = (
        _inside(counts, bracket, by, rows)
        .withColumn("upto", F.sum("n").over(last) + F.col("below"))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    )
    blend = F.sum(F.when(F.col("side") == "lower", F.col("v") * (1 - F.col("weight")))
                  .otherwise(F.col("v") * F.col("weight")))
    one_each = hits.groupBy(*by, "name").agg(blend.alias("q"))
    return one_each.groupBy(*by).agg(*[
        F.max(F.when(F.col("name") == name, F.col("q"))).alias(f"{QUANTILE}{i}")
        for i, name in enumerate(fractions)
    ])


def _state(bracket: DataFrame) -> tuple[int, int]:
    row = bracket.agg(F.count(F.lit(1)), F.max("inside")).first()
    return row[0], row[1] or 0


def _inside(counts: DataFrame, bracket: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Collapsed values that lie in a rank's bracket.

    The bracket table has two rows per fraction and group; it is broadcast while
    its counted size is small, so a huge group is never shuffled to one task.
    """
    c, b = counts.alias("c"), broadcast_if_small(bracket, rows).alias("b")
    on = (F.col("c.v") >= F.col("b.lo")) & (F.col("c.v") <= F.col("b.hi"))
    for name in by:
        on = on & F.col(f"c.{name}").eqNullSafe(F.col(f"b.{name}"))
    return c.join(b, on).select("b.*", "c.v", "c.n")


def _one_pass(counts: DataFrame, bracket: DataFrame, by: list[str], key: list[str],
              rows: int) -> DataFrame:
    """Replace every bracket by the histogram cell that holds its rank."""
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    cell = F.least(
        F.coalesce(F.floor((F.col("v") - F.col("lo")) / width * BUCKETS), F.lit(0)),
        F.lit(BUCKETS - 1),
    )
    cells = (
        _inside(counts, bracket, by, rows).withColumn("cell", cell)
        .groupBy(*key, "rank", "weight", "below", "cell")
        .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
             F.count(F.lit(1)).alias("inside"))
    )
    w = Window.partitionBy(*key).orderBy("cell")  # at most BUCKETS rows per partition
    return (
        cells.withColumn("upto", F.sum("n").over(w) + F.col("below"))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select(*by, "lo", "hi", "inside", (F.col("upto") - F.col("n")).alias("below"),
                "name", "side", "rank", "weight")
    )

"""Reading observations: file scan, cleaning, population filters, stage tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faretrace.functions.scalars import percent
from faretrace.params import COACH_ONLY_CODES, EXPECTED_SUBSET_ROWS, ROUTES
from faretrace.schema import (
    CATEGORY_COLUMNS, LABELLED_COLUMNS, MODEL_COLUMNS, MODELLING_COLUMNS, OBSERVATION, require_columns,
)


class SourceMissing(FileNotFoundError):
    """The input path does not exist."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles hold NULL, never NaN: averages skip NULL but are poisoned by NaN."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def _open(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.options(header=True, enforceSchema=False)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.csv(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise SourceMissing(f"no observation file at {path}; pass the CSV release or "
                                "the extracted route subset") from err
        raise


def file_schema(header: Sequence[str]) -> T.StructType:
    """Types by column name: known columns as contracted, all others text."""
    known = {f.name: f.dataType for f in OBSERVATION}
    return T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])


def load_raw(spark: SparkSession, path: str,
             columns: Sequence[str] | None = MODELLING_COLUMNS) -> DataFrame:
    """CSV scan with a fixed schema; ``columns=None`` keeps every column of the file.

    Only the header line is read ahead of the scan, and column pruning reaches
    the CSV parser through the select.
    """
    header = _open(spark, path, None).columns
    df = _open(spark, path, file_schema(header))
    if columns is not None:
        require_columns(df, columns, "load_raw")
        df = df.select(*columns)
    return nan_to_null(df)


def unreadable_cells(spark: SparkSession, path: str,
                     columns: Sequence[str] = MODELLING_COLUMNS) -> DataFrame:
    """(column_name, cells): cells with text that the column's type cannot hold; ``load_raw`` makes them NULL.

    One scan that reads the columns as text and tries the types; columns without such cells are left out.
    """
    header = _open(spark, path, None).columns
    text = _open(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in header]))
    require_columns(text, columns, "unreadable_cells")
    types = {f.name: f.dataType.simpleString() for f in file_schema(columns)}
    fields = ", ".join(
        f"struct('{c}' AS column_name, count_if(`{c}` IS NOT NULL AND try_cast(`{c}` AS {types[c]}) IS NULL) AS cells)"
        for c in columns)
    return text.agg(F.expr(f"array({fields}) AS audit")).selectExpr("inline(audit)").where("cells > 0")


def on_routes(df: DataFrame, routes: Iterable[str] = ROUTES) -> DataFrame:
    """Rows whose directed airport pair is one of ``routes``."""
    pairs = [route.replace("-", "") for route in routes]
    return df.where(F.concat("startingAirport", "destinationAirport").isin(pairs))


def extract_subset(spark: SparkSession, source: str, target: str,
                   routes: Iterable[str] = ROUTES, fmt: str = "parquet") -> None:
    """Cut the full release down to ``routes``; all columns kept, nothing collected.

    Few rows survive each scan task, so they are rebalanced into full-size files.
    """
    kept = on_routes(load_raw(spark, source, columns=None), routes).hint("rebalance")
    kept.write.mode("overwrite").options(header=True).format(fmt).save(target)


def row_count_report(df: DataFrame, expected: int = EXPECTED_SUBSET_ROWS) -> DataFrame:
    """One row: rows read back, rows expected, and whether they agree."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(expected).cast("long").alias("expected"),
        (F.col("rows") == expected).alias("as_expected"),
    )


def is_coach(codes: Iterable[str] = COACH_ONLY_CODES) -> str:
    """SQL condition: every leg flown in coach; an unknown cabin is not coach."""
    listed = ", ".join(f"'{c}'" for c in codes)
    return f"coalesce(segmentsCabinCode IN ({listed}), false)"


def filter_coach_only(df: DataFrame, codes: Iterable[str] = COACH_ONLY_CODES) -> DataFrame:
    require_columns(df, ["segmentsCabinCode"], "filter_coach_only")
    return df.where(F.col("segmentsCabinCode").isin(list(codes)))


def coach_filter_report(df: DataFrame, codes: Iterable[str] = COACH_ONLY_CODES) -> DataFrame:
    """Rows before and after the coach filter from one scan."""
    kept = df.agg(F.expr("count(1) AS before"), F.expr(f"count_if({is_coach(codes)}) AS after"))
    return kept.select("before", "after", F.expr("before - after AS removed"),
                       percent("before - after", "before").alias("removed_pct"))


def add_route(df: DataFrame) -> DataFrame:
    """Directed ``start-destination``; NULL when either end is missing."""
    return df.withColumn(
        "route", F.concat("startingAirport", F.lit("-"), "destinationAirport"))


def load_clean(spark: SparkSession, path: str,
               columns: Sequence[str] | None = MODELLING_COLUMNS) -> DataFrame:
    return clean(load_raw(spark, path, columns))


def clean(df: DataFrame) -> DataFrame:
    """Standard population: coach only, with ``route``."""
    return df.transform(filter_coach_only).transform(add_route)


def departing_by(df: DataFrame, last: date, date_col: str = "flightDate") -> DataFrame:
    """Drop right-censored departures; a plain range filter, so it reaches Parquet."""
    return df.where(F.col(date_col) <= F.lit(last))


def category_domain(df: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """(column_name, value, rows): the distinct non-null values of each text column."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns
    ])))
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows")))


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).cast("long").alias("columns"))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


# ---- stage tables --------------------------------------------------------


def write_coach_filtered(df: DataFrame, path: str) -> None:
    """Cleaned stage: the modelling columns plus ``route``, one folder per route.

    The rebalance hint gathers a route's rows into full-size files; AQE splits a
    route that is larger than one, so a dominant route is not one task.
    """
    (df.select(*MODELLING_COLUMNS, "route").hint("rebalance", "route")
     .write.mode("overwrite").partitionBy("route").parquet(path))


def write_labelled(df: DataFrame, path: str) -> None:
    """Labelled stage; keeps the trajectory clustering of the window that made it."""
    df.select(*LABELLED_COLUMNS).write.mode("overwrite").parquet(path)


def write_model_frame(df: DataFrame, path: str, date_col: str = "flightDate",
                      partitions: int | None = None) -> None:
    """Model stage: labelable rows, range-clustered so that fold filters skip row groups.

    Ranges are cut on (date, item, search date), so a busy date or item still splits.
    """
    keep = df.where("isLabelable").select(*MODEL_COLUMNS)
    keys = [F.col(c) for c in dict.fromkeys((date_col, "legId", "searchDate"))]
    ranged = keep.repartitionByRange(partitions, *keys) if partitions \
        else keep.repartitionByRange(*keys)
    ranged.sortWithinPartitions(date_col).write.mode("overwrite").parquet(path)


def read_stage(spark: SparkSession, path: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise SourceMissing(f"no stage table at {path}; run the earlier stage first") from err
        raise
    return df if columns is None else df.select(*columns)

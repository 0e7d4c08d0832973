"""Stage tables clustered by item: bucketed and sorted, so that windows and joins on the item read them in place.

A table is a folder with one file a bucket. A window over items needs no exchange, and two tables with equally many
buckets join on the item bucket by bucket. An item that is far larger than a task may hold makes its bucket a large one;
windows over such an item are cut in blocks as for any other table, at the price of the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faretrace.plans.trajectory import Trajectory

BUCKETS = 200


def write_clustered(df: DataFrame, table: str, path: str, traj: Trajectory = Trajectory(), buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` as ``table`` into ``path``, one sorted file a bucket: one exchange, the one that every later reader is
    spared. A table of that name is replaced in the catalogue."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (df.repartition(buckets, F.col(traj.group)).sortWithinPartitions(traj.group, *traj.order)
     .write.format("parquet").option("path", path).bucketBy(buckets, traj.group).sortBy(traj.group, *traj.order)
     .mode("overwrite").saveAsTable(table))
    return spark.table(table)


def open_clustered(spark: SparkSession, table: str, path: str, traj: Trajectory = Trajectory(), buckets: int = BUCKETS) -> DataFrame:
    """Register a folder that ``write_clustered`` wrote, in a session whose catalogue does not have it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    keys = ", ".join(f"`{c}`" for c in (traj.group, *traj.order))
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{traj.group}`) SORTED BY ({keys}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)

"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "faretrace", cores: int | str = "*",
                  partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may invent one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="faretrace-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes row placement and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_release(df: DataFrame) -> DataFrame:
    """As ``cut_lineage`` of a frame that is not used again: its shuffle files go before this returns. Spark removes them some
    time after the driver collects its garbage, and a driver that holds little has none for a long time."""
    out = cut_lineage(df)
    sc = out.sparkSession.sparkContext
    plan, cleaner = df._jdf.queryExecution().executedPlan(), sc._jsc.sc().cleaner()
    if cleaner.isDefined() and plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        for shuffle in list(plan.context().shuffleIds().keySet()):
            cleaner.get().doCleanupShuffle(shuffle, True)
    sc._gateway.detach(df._jdf)
    sc._jvm.System.gc()
    return out


def release(*frames: DataFrame) -> None:
    """Delete the checkpoints that these frames read, which nobody reads any more, without waiting for the driver's garbage."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRDD":
                sc._jvm.org.apache.spark.rdd.ReliableRDDCheckpointData.cleanCheckpoint(sc._jsc.sc(), leaf.rdd().id())


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started; a cluster that does not share its folder
    gets it by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    given = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, given)))


def tasks_at_once(spark: SparkSession) -> int:
    """How many tasks of a barrier stage can run side by side; 0 where executors come and go, which rules such stages out."""
    sc = spark.sparkContext
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    scala = sc._jsc.sc()
    return scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())


def storage(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return (fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder))


@contextmanager
def shared_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """An empty folder below the checkpoint folder, which all tasks reach; gone at the end."""
    ensure_checkpoint_dir(spark)
    folder = posixpath.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")
    system, path = storage(folder)
    system.create_dir(path)
    try:
        yield folder
    finally:
        system.delete_dir(path)

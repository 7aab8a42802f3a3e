"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

# Settings that suit large runs. Cluster size, memory and shuffle partitions belong to the deployment.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lets a join on (file, chunk id) reuse a partitioning by file
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture for every column expression: plans with many columns are built several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
    # the ids of a page of results reach the row groups
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    "spark.sql.session.timeZone": "UTC",
}


# Bytes of an Arrow batch that goes to a Python task.
ARROW_BYTES = "8m"


def build_session(app: str = "seekspan", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`.

    Only a local session without that setting gets a machine-local folder: on a cluster such a folder is lost with its
    machine, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared scratch area and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches for Python tasks are bounded by bytes, not only by rows, so what a task holds does not grow with its rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def ship_packages(spark: SparkSession, *packages: ModuleType) -> None:
    """Make packages importable on the executors, once per Spark context and package."""
    context = spark.sparkContext
    for package in packages:
        archive = f"{package.__name__}.zip"
        if any(name.endswith(f"/{archive}") for name in context.listFiles):
            continue
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), archive)
        root = os.path.dirname(package.__file__)
        with zipfile.ZipFile(target, "w") as bundle:
            for base, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(base, name)
                        bundle.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(target)

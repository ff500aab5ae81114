"""Session settings and the shared folder that jobs use to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from a laptop to a large cluster.  Partition counts and
# memory belong to the cluster and are left to spark-submit.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # State of the streaming dedupe outgrows the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Call sites per expression double the time to build the wide records.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def start_session(app: str = "ludomill", master: str | None = None, **settings: str) -> SparkSession:
    """Build a session; keyword settings use ``__`` for the dots in Spark's names."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, set up on first use.

    ``spark.checkpoint.dir`` wins.  Only a local master may fall back to a
    folder of its own: on a cluster (``local-cluster`` too) a machine-local folder is lost with the
    machine, so an unset value is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="ludomill-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffle files at its end: nothing reads them again once the rows are written."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from the written rows.

    Used where later steps must all see the very same rows (partition numbers,
    for one, may differ if a range exchange is sampled twice) and where a
    recomputation after losing executors must not change them.  A table rather
    than a checkpoint, so that later steps read only the columns they need.
    """
    path = fresh_folder(df.sparkSession, "settled")
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(spark: SparkSession) -> None:
    """Delete what :func:`settle` has written for this application; for the end of a job, when its results are saved."""
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(current)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder) if files.exists(folder) else []:
        if status.getPath().getName().startswith("settled-"):
            files.delete(status.getPath(), True)

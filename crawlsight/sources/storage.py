"""Tables and checkpoints in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session in one process (a test) may go without and gets a temporary one."""
    if not spark.conf.get(_KEY, None):
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        spark.conf.set(_KEY, "file://" + tempfile.mkdtemp(prefix="crawlsight-"))
    return spark.conf.get(_KEY).rstrip("/")


def checkpointed(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """The materialised frame, without its lineage."""
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return frame.checkpoint(eager=True)


def materialised(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later reads take only the columns that they need.

    The table goes when the application ends.
    """
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that the session reads; none if there is no such folder."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path

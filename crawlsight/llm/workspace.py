"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it back, so a lost executor costs
a task and never a table. The folder is the session's ``spark.checkpoint.dir``;
only a session in one process (a test) may go without that setting and gets a
temporary folder of its own. A cluster without it is refused: executors would write
to their own disks and find nothing there when they read.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Shuffle files go when the execution that made them ends; nothing reads them after its table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder's path, without a trailing slash."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="crawlsight-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution removes its shuffle files as soon as it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Workspace:
    """Tables of one operator call, in one folder of their own.

    ``write`` materialises a frame; ``drop`` removes a table that is read no
    more. What is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def write(self, frame: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        with _cleaning(self.spark):
            frame.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def write_split(self, frame: DataFrame, name: str, by: str) -> DataFrame:
        """As ``write``, in one folder per value of a column, so that a part can be dropped by itself."""
        path = f"{self.root}/{name}"
        with _cleaning(self.spark):
            frame.write.mode("overwrite").option("compression", "none").partitionBy(by).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

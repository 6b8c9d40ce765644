"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a
local-mode session without that setting (tests, a laptop) gets a temporary
folder of its own; on a cluster a missing setting is an error, because a
machine-local folder would be invisible to the other executors.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.ship import ship


def shared_root(spark: SparkSession) -> str:
    """The folder for scratch tables, from the session's ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Whether Spark deletes an execution's shuffle files as it ends, not only when its plan is collected as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one query, under a folder of its own inside the shared root, which goes with the application."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        folder, files = self._hadoop(self.path)
        files.deleteOnExit(folder)

    def _hadoop(self, path: str) -> tuple:
        """A path and its file system, as Hadoop has them."""
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(context._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str = "t", parts: list[str] | None = None) -> DataFrame:
        """Writes ``df`` and returns the table read back; the old lineage is gone.

        ``parts`` names columns whose values become folders, so that a filter on them reads no others.
        """
        self._count += 1
        path = f"{self.path}/{self._count:03d}-{name}"
        with brief_shuffles(self.spark):
            df.write.partitionBy(*parts or []).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def drop(self, df: DataFrame, *parts: str) -> None:
        """Deletes a table of this query that nothing reads any more, or only its folders ``parts`` (``column=value``)."""
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.path.rsplit("/", 1)[1] in parent and (not parts or parent.rsplit("/", 1)[1] in parts):
                path, files = self._hadoop(parent)
                files.delete(path, True)

    def clear(self) -> None:
        """Deletes all tables of this query, once nothing reads them any more."""
        folder, files = self._hadoop(self.path)
        files.delete(folder, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs, which it does when their plans are collected as garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

"""Durable intermediate tables: lineage is cut by writing Parquet to the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster; only where it is unset (tests, a laptop)
a temporary folder of this machine is made and registered as the checkpoint folder. A cluster without a shared folder
is an error: its executors would each write to their own disk.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(current)
    return current


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """What runs inside has its shuffle files deleted as soon as it ends, not when the driver collects garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


class Scratch:
    """A folder of written tables. ``save`` cuts lineage, ``drop`` frees the disk of one table."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete written tables that nothing will read again."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(conf).delete(path, True)

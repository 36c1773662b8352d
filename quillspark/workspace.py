"""Where intermediate tables and files go: one folder that the driver and every executor can reach.

The cluster names that folder in ``spark.checkpoint.dir``.  Only a local session, where driver and
executors are one process, may fall back on a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; creates a private one only for a local master without a setting."""
    global _own_root
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def _qualified(spark: SparkSession, root: str) -> str:
    """With the scheme: a path without one lies in the cluster's default file system, which may not be local."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(conf).makeQualified(path).toString()
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


class Workspace:
    """A fresh folder under the shared root for the tables and files of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = shared_root(spark)
        root = _qualified(spark, root)
        self.uri = f"{root}/quillspark/{label}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: cuts the lineage and survives lost executors."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _at_exit(self) -> None:
        """Results are lazy and read the folder until the program ends; a session that is gone cannot tidy."""
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                self.drop()

    def drop(self, name: str = "") -> None:
        """Delete a table (or the whole folder) that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.uri)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

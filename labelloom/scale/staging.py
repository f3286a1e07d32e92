"""Intermediate tables written to the shared folder of the cluster.

A staged table cuts lineage (a lost executor costs a re-read, not a recompute of the scan above it)
and gives Catalyst exact file sizes, so later joins are planned on facts rather than estimates.
"""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: below ``spark.checkpoint.dir``, else the context's checkpoint folder; every executor must reach it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{configured.rstrip('/')}/labelloom-{spark.sparkContext.applicationId}"


def ensure_shared_dir(spark: SparkSession) -> None:
    """Set a shared folder where none is set and driver and executors are one process, as in tests; else leave it."""
    unset = not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    if unset and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="labelloom-"))


def stage(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it, read as ``schema`` if given."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete everything this application staged, once its results have been consumed."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        _delete(spark, shared_dir(spark))


class StagingScope:
    """Staged tables of one run, below one folder, so that a run can drop what it no longer reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid4().hex}"

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.folder}/{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, f"{self.folder}/{label}")

    def release(self, *labels: str) -> None:
        """Delete tables, and ask the driver's JVM to let go of what finished jobs left, so that Spark removes their shuffle files."""
        for label in labels:
            self.drop(label)
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        _delete(self.spark, self.folder)

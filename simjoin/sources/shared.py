"""The folder that a driver and its executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a plain local session without one gets a temporary folder."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="simjoin-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

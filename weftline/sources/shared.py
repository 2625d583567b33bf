"""Folders that all executors share, for tables cut from their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names it; else, with a local master alone, a temporary folder that is set for the session and goes with it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, folder, True)
        named = f"file://{folder}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, read from a checkpoint; spark.cleaner.referenceTracking.cleanCheckpoints has Spark remove it when the table is dropped."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/weftline-{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of new_path's that is read no more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

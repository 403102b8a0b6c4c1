"""Folders and tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and sc.getCheckpointDir() is None and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="folioscope-"))
    return root or sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that later plans are small and lost executors lose nothing."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)

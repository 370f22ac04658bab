"""Where a session may write what must outlive an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new folder of this machine in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder: partitions keep their numbers when they are read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()

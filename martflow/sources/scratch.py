"""Materialised intermediate frames, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used by sessions with a local master alone, and only where they name no folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Without it only a local master may go on: a cluster's executors share no /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: every reading of it sees the same rows in the same places."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()

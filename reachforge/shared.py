"""The folder that all executors share, and cuts of lineage by reliable checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is made only where Spark runs on this machine alone and none is set."""
    ctx, found = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if ctx.getCheckpointDir() is None:
        if found is None and not ctx.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        ctx.setCheckpointDir(found or tempfile.mkdtemp(prefix="reachforge-"))
    return found or ctx.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder once, and read from there by whatever follows, so that its rows and their partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

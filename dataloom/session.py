"""Checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only in local mode without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return shared or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: computed once, without their lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()

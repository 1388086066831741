"""Cutting lineage so that a lost executor costs a re-read, never the whole loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary
    one; on a cluster, whose executors would not see it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnlake-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint of df (never a local one)."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)

"""Materialising small results once, in a way that survives lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The checkpoint folder: ``folder``, or what ``spark.checkpoint.dir`` names; all executors must share it."""
    context = spark.sparkContext
    wanted = folder or spark.conf.get("spark.checkpoint.dir", None)
    if wanted and context.getCheckpointDir() is None:
        context.setCheckpointDir(wanted)
    if context.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


def settled(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` computed now and read back from the checkpoint folder from here on."""
    ensure_checkpoint_dir(df.sparkSession, folder)
    return df.checkpoint(eager=True)

"""Where iterated queries cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where it is unset, a local session gets one of its own;
    on a cluster that is an error, since executors couldn't read what others write to a folder of theirs."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

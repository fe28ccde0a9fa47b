"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quantara-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder."""
    context, base = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return df.checkpoint(eager=True)

"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder for checkpoints, ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    without it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="jobweave-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder for checkpoints."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)

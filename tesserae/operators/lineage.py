"""Tables written once where a plan would compute them again for each use, and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a temporary folder takes its place, but only if all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='rounds-')}")
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; lineage ends there."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Cutting a plan's lineage where it would grow from step to step, and steps that compute once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: spark.checkpoint.dir or one that was set, else a temporary one in local mode.

    A cluster must name one that all its machines share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None or spark.conf.get("spark.checkpoint.dir", ""):
        return
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """The table with its lineage cut, in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def bound(rows: DataFrame, keys: list[str], *columns) -> DataFrame:
    """The keys and columns, computed here once: an explode of one row keeps the optimizer from writing the expressions
    into all that use them, which would outgrow a generated method."""
    return rows.select(*keys, F.explode(F.array(F.struct(*columns))).alias("bound")).select(*keys, "bound.*")

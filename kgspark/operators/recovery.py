"""Reliable checkpoints in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that every task may hold.
FEW = 500_000


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, for stores and the state of streams."""
    _prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df computed once and stored by checkpoint() in spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; a cluster must name one."""
    _prepare(df.sparkSession)
    return df.checkpoint()


def broadcast_few(df: DataFrame) -> DataFrame:
    """df, for the small side of a join: broadcast if it has at most FEW rows by count. Stored first, so it is counted once."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= FEW else df


def _prepare(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="kgspark-"))

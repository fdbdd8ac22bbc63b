"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session on this machine alone may leave it unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4()}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in that folder, which survives lost executors."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``durable``, but as a Parquet table, for wide rows: it is smaller there."""
    path = fresh(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

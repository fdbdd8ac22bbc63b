"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder; back-pressure is the number of files a trigger takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, event_type, n, total by windows of event time; rows later than ``late`` are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), "n")


def idempotent(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once, as far back as the watermark reaches."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def last_outcomes(events: DataFrame, n: int = 3) -> DataFrame:
    """user_id, tool, outcome whenever the last n attempts of a tool all succeeded or all failed. State: n flags a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        for batch in batches:
            last += batch.sort_values(["ts", "event_id"])["ok"].tolist()
        last = last[-n:]
        state.update((last,))
        outcome = "runbook" if all(last) else "anti_runbook" if not any(last) else None
        if len(last) == n and outcome:
            yield pd.DataFrame({"user_id": [key[0]], "tool": [key[1]], "outcome": [outcome]})

    attempts = events.select("user_id", F.col("event_type").alias("tool"), "ts", "event_id", (F.col("value") >= 20).alias("ok"))
    return attempts.groupBy("user_id", "tool").applyInPandasWithState(step, "user_id long, tool string, outcome string", "last array<boolean>", "update", "NoTimeout")


def sync(listing: DataFrame, manifest_path: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """Poll loop: each micro-batch of a listing is compared with the manifest kept at ``manifest_path``, a folder for each batch."""
    from textlode.sources.snapshots import upsert

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy(key).agg(F.max(version).alias(version))
        spark = rows.sparkSession
        old = spark.read.parquet(f"{manifest_path}/{number - 1}") if number else latest.limit(0)
        upsert(old, latest, key).write.mode("overwrite").parquet(f"{manifest_path}/{number}")

    return listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()

"""Polling sources as snapshots: what changed between a manifest and a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(manifest: DataFrame, listing: DataFrame, key: str, version: str) -> DataFrame:
    """key and change (added, removed, modified, same), by one full outer join."""
    old, new = manifest.select(key, F.col(version).alias("_old")), listing.select(key, F.col(version).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified").otherwise("same")
    return old.join(new, key, "full").select(key, kind.alias("change"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those of the same key."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)

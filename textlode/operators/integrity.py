"""Integrity checks: each gives the items that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, by: str, order: str) -> DataFrame:
    """Groups in which a number does not follow the one before it, from 0 on; a row for each gap."""
    before = F.lag(order).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_before", before).filter(F.coalesce(F.col("_before") + 1, F.lit(0)) != F.col(order)).select(F.col(by).alias("item"))


def without(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows that no row of ``other`` names."""
    return df.join(other.select(F.col(other_key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti").select(F.col(key).alias("item"))


def duplicates(df: DataFrame, by: list[str], item: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(item).alias("item"))


def report(found: dict[str, DataFrame]) -> DataFrame:
    """rule, item of everything found."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), F.col("item").cast("string").alias("item")) for rule, df in found.items()])

"""Walks over parent-child edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.operators.packing import durable


def descend(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, node, depth, path of all below the roots, breadth first; a node is not entered again below itself.

    One equi-join a level, until a level is empty or at ``depth``; each level is
    checkpointed, as the next one and the result both read it. The path orders
    nodes depth first, by text ids as they are and by others as numbers.
    """
    text = dict(edges.dtypes)["child"] == "string"
    name = lambda c: c if text else F.lpad(c.cast("string"), 19, "0")
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"), name(F.col("id")).alias("path"))
    found, below = [level], edges.select("parent", "child")
    for _ in range(depth):
        fresh = ~F.contains("path", name(F.col("child")))
        deeper = level.join(below, F.col("node") == F.col("parent")).filter(fresh)
        level = durable(deeper.select(
            "root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), name(F.col("child"))).alias("path")
        ))
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found)

"""Shapes of JSON columns: paths, types and numbers, as sketches that add up.

A sketch is a row a path: how often it occurs, with which types, in how many rows, its longest list, its
least and greatest text, and a HyperLogLog sketch of its values. Rows are combined where they are read, so what moves
is a row a path and task, whatever the table's size; sketches of parts merge to the whole's, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values up to which texts are compared; HyperLogLog sees them whole.
SHOWN = 100
#: What a sketch's columns add up by.
SUMS = {"n": F.sum, "objects": F.sum, "arrays": F.sum, "texts": F.sum, "numbers": F.sum, "flags": F.sum, "nulls": F.sum, "longest": F.max, "least": F.min, "greatest": F.max}


def sketch(rows: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """path and its numbers for a column of JSON texts, down to ``depth`` levels; ``[]`` stands for all items of a list.

    The path of the whole is ``$``. Null texts are no values; texts that are no JSON count under the path ``!``.
    """
    spark = rows.sparkSession
    parsed = rows.select(F.try_parse_json(F.col(column)).alias("v"), F.col(column).isNotNull().alias("given"))
    level = parsed.select(F.when(F.col("v").isNull() & F.col("given"), "!").otherwise("$").alias("path"), "v").filter("v IS NOT NULL OR path = '!'")
    every = level
    for _ in range(depth):
        inside = level.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        level = spark.sql("SELECT concat(w.path, CASE WHEN e.key IS NULL THEN '[]' ELSE concat('.', e.key) END) AS path, e.value AS v FROM {w} AS w, LATERAL variant_explode(w.v) AS e", w=inside)
        every = every.unionByName(level)
    kind = F.schema_of_variant("v")
    text = F.variant_get("v", "$", "string")
    plain = ~F.coalesce(kind, F.lit("")).rlike("^(OBJECT|ARRAY|VOID)") & (F.col("path") != "!")
    count = lambda c: F.count(F.when(c, 1))
    items = F.when(kind.startswith("ARRAY"), F.size(F.variant_get("v", "$", "array<variant>")))
    return every.groupBy("path").agg(
        F.count("*").alias("n"), count(kind.startswith("OBJECT")).alias("objects"), count(kind.startswith("ARRAY")).alias("arrays"), count(kind == "STRING").alias("texts"),
        count(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")).alias("numbers"), count(kind == "BOOLEAN").alias("flags"), count(kind == "VOID").alias("nulls"), F.max(items).alias("longest"),
        F.min(F.when(plain, F.substring(text, 1, SHOWN))).alias("least"), F.max(F.when(plain, F.substring(text, 1, SHOWN))).alias("greatest"), F.hll_sketch_agg(F.when(plain, text)).alias("values"),
    )


def merged(sketches: DataFrame) -> DataFrame:
    """The sketch of all rows from the sketches of parts."""
    return sketches.groupBy("path").agg(*(how(c).alias(c) for c, how in SUMS.items()), F.hll_union_agg("values").alias("values"))


def described(sketches: DataFrame) -> DataFrame:
    """path, n, types, longest, different, least, greatest of a sketch."""
    names = F.array(*(F.when(F.col(c) > 0, t) for c, t in (("arrays", "array"), ("flags", "boolean"), ("nulls", "null"), ("numbers", "number"), ("objects", "object"), ("texts", "text"))))
    return sketches.select("path", "n", F.array_join(F.array_compact(names), "|").alias("types"), "longest", F.hll_sketch_estimate("values").alias("different"), "least", "greatest")

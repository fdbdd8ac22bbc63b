"""Mixing sources to target weights, with DataFrame functions only.

Capped water-filling: each source gets its weight's share of the wanted total;
a source that would exceed ``max_epochs`` passes over its rows is clamped there
and the excess goes to the others by weight, until none is above. The result is
min(cap, level * weight) for one common level, which one ordered pass over the
table of sources finds. Rows are then taken in whole passes plus a seeded
fraction: sources keep rows in an order of md5(seed, id), and the fraction takes
the front of that order, up to the row whose middle passes the target. So the
words taken differ from the target by half of one row at most.

Sizes are summed map-side, so a source with a third of all rows moves one row a
task. The order inside a source is dealt to hash ranges, as many as the counted rows
ask for; a table of source x bucket sums carries the running total from one to
the next, and no task holds a whole source.

Null or blank text has size 0 and is taken with 0 words; a null source is a
source of its own, last in order; repeated rows count each; sources of size 0
have target 0; an empty table gives an empty result. Rows with a null id share
one place in the order. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.llm.common import WORD, durable, unused

WEIGHTS = (5.0, 2.0, 1.0)


def fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size, weight), a row for each source.

    The window has no partition: the table has one row a source.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("cap", cap.cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(rest))
        .withColumn("level", (F.col("wanted") - F.col("clamped")) / F.col("open_weight"))
    )
    # the sources are in the order in which they clamp: the level is that of the first that stays open
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target")


def position(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def planned(
    docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple = WEIGHTS, seed: str = "mix:",
    range_rows: int = 100_000,
) -> DataFrame:
    """doc_id, source, size, place, source_size, target, whole, part of every row of (doc_id, text, source).

    ``whole`` passes and, where ``part`` holds, one more are taken.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = position(F.col("doc_id"), seed)
    sized = durable(docs.select("doc_id", "source", size.alias("size"), place.alias("place")))
    digits, rows = 2, sized.count()
    while rows > range_rows * 16**digits:  # if all rows were of one source
        digits += 1
    bucketed = sized.withColumn("bucket", F.substring("place", 1, digits))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ranked = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.pmod(number, F.lit(len(weights))) + 1
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    targets = fill(ranked, share, max_epochs).withColumnRenamed("source", "of_source")
    carried = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(carried), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("of_source")))
        .select(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), "start", "source_size", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = bucketed.withColumn("running", running)
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket"))
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    middle = F.col("start") + F.col("running") - F.col("size") / 2
    part = (middle <= F.col("target") - F.col("whole") * F.col("source_size")) & (F.col("size") > 0)
    part = part & (F.col("whole") < F.lit(max_epochs))
    return (
        placed.join(starts, same)
        .withColumn("whole", whole.cast("long"))
        .select("doc_id", "source", "size", "place", "source_size", "target", "whole", part.alias("part"))
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of (doc_id, text, source).

    Settings: ``share`` of all sizes that is wanted, ``max_epochs``, ``weights``
    (repeated over the sources in code point order), ``seed``, and
    ``range_rows``, the rows of a range of the order's hash, on average at most.
    """
    copies = F.col("whole") + F.col("part").cast("long")
    plan = planned(docs, **settings).withColumn("copies", copies)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: Sources up to which their table is broadcast; a row of it has about 100 bytes.
BROADCAST_SOURCES = 50_000


def take(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    What the fraction takes is the front of a source's order, so one row a source
    (its passes and where its front ends) says it all, and texts are not shuffled.
    Rows that share place, id and size with the last one taken are taken too.
    """
    place = F.struct("place", F.col("doc_id").alias("id"), "size")
    source, passes, front, copy = (unused(n, docs) for n in ("of_source", "passes", "front", "copy"))
    sources = planned(docs, **settings).groupBy(F.col("source").alias(source)).agg(
        F.max("whole").alias(passes), F.max(F.when(F.col("part"), place)).alias(front)
    )
    sources = durable(sources)
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = F.struct(position(F.col("doc_id"), settings.get("seed", "mix:")).alias("place"), F.col("doc_id").alias("id"), size.alias("size"))
    copies = F.col(passes) + F.coalesce(own <= F.col(front), F.lit(False)).cast("long")
    joined = docs.join(sources, F.col("source").eqNullSafe(F.col(source)))
    repeated = F.explode(F.when(size == 0, F.array().cast("array<long>")).otherwise(F.array_repeat(F.lit(1).cast("long"), copies.cast("int"))))
    return joined.withColumn(copy, repeated).drop(source, passes, front, copy)

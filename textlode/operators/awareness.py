"""What a conversation should be made aware of: names that sources tell apart, old references, connections.

A mention is a row (id, entity, source, created_at, terms): ``terms`` are the known
terms that the source holds. Of each entity only what a limit can reach is joined:
counts are combined before they move, and ranks are limited before and after.
Null entities or sources are no mentions. Tables without rows give none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.sources.shared import stored

#: Pairs that one task adds up, and the parts of that by which sources are dealt: a pair takes some 100 bytes there.
PAIRS, CUTS = 4_000_000, 16


def mismatches(mentions: DataFrame, limit: int, since: Column) -> DataFrame:
    """The newest ``limit`` pairs of mentions of each entity in different sources: entity, place, earlier and later ones' columns.

    The later mention (by id) orders the pairs by its time, then ids; only mentions after ``since`` count.
    A pair's later mention must have an earlier one in another source: that is known from the
    first mention, and the first outside its source. Of such mentions the first ``limit`` and of each
    its nearest ``limit`` partners hold all pairs that are wanted.
    """
    m = mentions.filter(F.col("entity").isNotNull() & F.col("source").isNotNull() & (F.col("created_at") > since))
    first = m.groupBy(F.col("entity").alias("of")).agg(F.min(F.struct("id", "source")).alias("first"))
    other = m.join(first, F.col("entity") == F.col("of")).filter(F.col("source") != F.col("first.source")).groupBy("of", "first").agg(F.min("id").alias("second"))
    has = F.when(F.col("source") == F.col("first.source"), F.col("id") > F.col("second")).otherwise(F.col("id") > F.col("first.id"))
    later = m.join(other, F.col("entity") == F.col("of")).filter(has)
    newest = Window.partitionBy("entity").orderBy(F.desc("created_at"), F.desc("id"))
    later = later.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= limit)
    later = later.select(F.col("entity").alias("of"), "n", *(F.col(c).alias(f"{c}_b") for c in ("id", "source", "created_at", "terms")))
    pairs = later.join(m, (F.col("of") == F.col("entity")) & (F.col("id") < F.col("id_b")) & (F.col("source") != F.col("source_b")))
    near = Window.partitionBy("of", "n").orderBy(F.desc("id"))
    pairs = pairs.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= limit)
    place = Window.partitionBy("entity").orderBy("n", "k")
    pairs = pairs.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)
    earlier = [F.col(c).alias(f"{c}_a") for c in ("id", "source", "terms")]
    return pairs.select("entity", "place", *earlier, "id_b", "source_b", "created_at_b", "terms_b")


def connections(mentions: DataFrame) -> DataFrame:
    """a, b (a < b), sources, first_source: entities that share sources. Pairs are made once for all sources of the same entities.

    A task adds up about ``PAIRS`` pairs, however many there are: more pairs go to more tasks. Entities are numbers until then.
    """
    seen = stored(mentions.filter("entity IS NOT NULL AND source IS NOT NULL").select("entity", "source"))
    # numbers in the order of the names, as those of sources below in that of the first ones: counts and least numbers are added up in place, least strings would be sorted
    names = stored(seen.select("entity").distinct().repartitionByRange("entity").sortWithinPartitions("entity").withColumn("id", F.monotonically_increasing_id()))
    held = seen.join(names, "entity").groupBy("source").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    held = held.filter(F.size("ids") > 1).groupBy("ids").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))
    held = stored(held.repartitionByRange("first_source").sortWithinPartitions("first_source").withColumn("number", F.monotonically_increasing_id()))
    held_pairs = held.withColumn("pairs", F.expr("CAST(size(ids) AS LONG) * (size(ids) - 1) DIV 2"))
    tasks = math.ceil((held_pairs.agg(F.sum("pairs")).first()[0] or 1) / PAIRS)
    # a source of many pairs is cut, so that no task gets much more than another
    most = max(1, PAIRS // CUTS)
    whole = held_pairs.filter(F.col("pairs") <= most).withColumn("first", F.lit(0).cast("long"))
    large = held_pairs.filter(F.col("pairs") > most).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pairs") - 1, F.lit(most).cast("long"))))
    dealt = whole.unionByName(large).repartition(tasks, "number", "first")
    # pair p of a source is that of its ids i < j with p = j * (j - 1) / 2 + i; ids are in order
    each = dealt.select("n", "number", "ids", F.explode(F.sequence("first", F.least(F.col("first") + most, "pairs") - 1)).alias("p"))
    each = each.withColumn("j", F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("int"))
    each = each.withColumn("i", (F.col("p") - F.expr("CAST(j AS LONG) * (j - 1) DIV 2")).cast("int"))
    pairs = each.select("n", "number", F.get("ids", "i").alias("a"), F.get("ids", "j").alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.sum("n").alias("sources"), F.min("number").alias("number")).join(held.select("number", "first_source"), "number")
    name = lambda c: names.select(F.col("id").alias(c), F.col("entity").alias(f"name_{c}"))
    return shared.join(name("a"), "a").join(name("b"), "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "sources", "first_source")


def entities(mentions: DataFrame) -> DataFrame:
    """entity, mentions, last_seen."""
    return mentions.filter("entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("mentions"), F.max("created_at").alias("last_seen"))


def proactive(named: DataFrame, pairs: DataFrame, known: DataFrame, least: int, most: int = 3) -> DataFrame:
    """key, entity, mentions, place: what most often shares a source with what a text names; where nothing does, the most mentioned of all.

    ``named`` has key and entity, or a null entity for texts that name nothing.
    """
    both = pairs.select("a", "b", "sources").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sources"))
    often = known.filter(F.col("mentions") >= least)
    near = named.join(both, F.col("entity") == F.col("a")).groupBy("key", F.col("b").alias("near")).agg(F.sum("sources").alias("shared"))
    near = near.join(often, F.col("near") == F.col("entity")).select("key", "entity", "mentions", "shared")
    order = Window.partitionBy("key").orderBy(F.desc("shared"), F.desc("mentions"), "entity")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("key", "entity", "mentions", "place")
    top = often.orderBy(F.desc("mentions"), "entity").limit(most)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mentions"), "entity")))  # ``most`` rows
    alone = named.select("key").distinct().join(near.select("key").distinct(), "key", "left_anti")
    return near.unionByName(alone.crossJoin(F.broadcast(top.select("entity", "mentions", "place"))).select("key", "entity", "mentions", "place"))


def notes(
    named: DataFrame, mentions: DataFrame, now: Column, header: str = "[Awareness]\n", most_notes: int = 3, most_tokens: int = 100, stale_days: int = 30,
    least_mentions: int = 2, fresh_days: int = 90,
) -> DataFrame:
    """key, notes, kinds, tokens: up to ``most_notes`` lines a key within its tokens (4 characters each, the header's included).

    ``named``: key and the entities that its text names (null for none). Keys that name entities with
    ``least_mentions`` get mismatches, stale references and connections, in this order; others
    get background lines. A line that does not fit is passed over for the next. Keys without lines give no row.
    """
    known, pairs = entities(mentions), stored(connections(mentions))  # read three times: no more rows than pairs of entities
    told = named.join(known.withColumnRenamed("entity", "of"), F.col("entity") == F.col("of"), "left").drop("of").withColumn("enough", F.coalesce(F.col("mentions") >= least_mentions, F.lit(False)))
    matched = told.filter("enough").select("key", "entity", "mentions", "last_seen")
    others = named.join(matched.select("key").distinct(), "key", "left_anti")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))

    background = proactive(others, pairs, known, least_mentions)
    line = F.concat(F.lit("Background: "), quoted("entity"), F.lit(" ("), "mentions", F.lit(" mentions) — high-activity entity"))
    lines = background.select("key", F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), F.lit("proactive").alias("kind"), line.alias("line"))

    apart = mismatches(mentions, most_notes, now - F.make_dt_interval(F.lit(fresh_days)))
    order = Window.partitionBy("key").orderBy(F.desc("created_at_b"), F.desc("id_b"), F.desc("id_a"), "entity")
    apart = matched.select("key", "entity").join(apart, "entity").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_notes)
    only = lambda x, y: F.array_except(f"terms_{x}", f"terms_{y}")
    said = lambda x, y: F.concat(f"source_{x}", F.lit(" mentions ["), F.array_join(only(x, y), ", "), F.lit("]"))
    line = F.concat(F.lit("Possible mismatch: "), quoted("entity"), F.lit(" — "), said("a", "b"), F.lit(" but "), said("b", "a"))
    apart = apart.filter((F.size(only("a", "b")) > 0) | (F.size(only("b", "a")) > 0))
    lines = lines.unionByName(apart.select("key", F.lit(1).alias("part"), F.col("n").cast("long").alias("place"), F.lit("mismatch").alias("kind"), line.alias("line")))

    days = F.datediff(now, F.col("last_seen"))
    order = Window.partitionBy("key").orderBy(F.desc("days"), "entity")
    stale = matched.withColumn("days", days).filter(F.col("days") >= stale_days).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_notes)
    line = F.concat(F.lit("Stale reference: "), quoted("entity"), F.lit(" last seen "), "days", F.lit(" days ago ("), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"), F.lit(")"))
    lines = lines.unionByName(stale.select("key", F.lit(2).alias("part"), F.col("n").cast("long").alias("place"), F.lit("staleness").alias("kind"), line.alias("line")))

    a, b = matched.select("key", F.col("entity").alias("a")), matched.select("key", F.col("entity").alias("b"))
    order = Window.partitionBy("key").orderBy(F.desc("sources"), "a", "b")
    # the names of a text meet first: they are few, while an entity shares sources with most others
    named_pairs = stored(a.join(b, "key").filter("a < b").distinct())
    near = named_pairs.join(pairs, ["a", "b"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_notes)
    line = F.concat(F.lit("Connection: "), quoted("a"), F.lit(" and "), quoted("b"), F.lit(" co-occur in "), "first_source")
    lines = lines.unionByName(near.select("key", F.lit(3).alias("part"), F.col("n").cast("long").alias("place"), F.lit("connection").alias("kind"), line.alias("line")))

    # at most four times most_notes lines a key
    each = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "place", "kind", "line"))).alias("lines"))
    budget = T.estimate_tokens(F.lit(header), 4.0)
    start = F.struct((F.lit(most_tokens) - budget).alias("left"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<string>").alias("lines"))

    def take(state: Column, x: Column) -> Column:
        cost = T.estimate_tokens(x["line"], 4.0)
        fits = (F.size(state["lines"]) < most_notes) & (cost <= state["left"])
        taken = F.struct((state["left"] - cost).alias("left"), F.array_append(state["kinds"], x["kind"]).alias("kinds"), F.array_append(state["lines"], x["line"]).alias("lines"))
        return F.when(fits, taken).otherwise(state)

    done = each.select("key", F.aggregate("lines", start, take).alias("s")).filter(F.size("s.lines") > 0)
    text = F.concat(F.lit(header), F.array_join("s.lines", "\n"))
    return done.select("key", text.alias("notes"), F.array_join("s.kinds", ",").alias("kinds"), (F.lit(most_tokens) - F.col("s.left")).alias("tokens"))

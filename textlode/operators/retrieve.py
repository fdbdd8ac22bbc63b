"""Retrieval from question to passages: entity boost, two searches, fusion, neighbours, ranking, confidence.

Batches of queries run through each step as joins; a query keeps at most
``candidates`` rows after each search, so what follows folds bounded lists inside
rows. Empty and null queries are rejected, queries without candidates answer nothing;
both have a row in ``summary`` and none in ``passages``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import search, terms
from textlode.sources.shared import durable


@dataclass(frozen=True)
class Settings:
    top: int = 10
    multiplier: int = 2
    gate: float = 1.05  # vectors farther than this are no candidates
    constant: int = 60
    vector_weight: float = 1.0
    word_weight: float = 1.0
    longest: int = 100  # of a list that is fused
    least_mentions: int = 2
    boost_mentions: int = 5
    boost_terms: int = 3
    skip_distance: float = 0.8
    skip_ratio: float = 2.0
    least_score: float = 0.0  # of a reranked passage

    @property
    def candidates(self) -> int:
        return self.top * self.multiplier


def boosted(queries: DataFrame, entities: DataFrame, mentions: DataFrame, s: Settings) -> DataFrame:
    """query_id, boosted: queries of one or two words with up to three terms that stand beside the entity they name.

    ``entities``: entity, type, mentions; ``mentions``: id, entity, terms. A query names the entity of its whole key
    (``type:name``), else of its name, else the most mentioned one whose name holds it. The first
    ``boost_mentions`` mentions give the terms, in order. Queries without entity or terms are not returned.
    """
    low = F.lower(F.trim("query"))
    short = queries.filter((F.trim("query") != "") & (F.size(F.split(F.trim("query"), r"\s+")) <= 2)).select("query_id", F.trim("query").alias("query"), low.alias("low"))
    known = entities.filter(F.col("mentions") >= s.least_mentions).select("entity", F.concat_ws(":", "type", "entity").alias("whole"), "mentions")
    staged = lambda df, stage: df.select("query_id", F.struct(F.lit(stage).alias("stage"), (-F.col("mentions")).alias("often"), "entity").alias("found"))
    exact = short.join(known, F.col("low") == F.col("whole"))
    named = short.join(known, F.col("low") == F.lower("entity"))
    held = terms.find(known.select("entity"), short.select(F.col("low").alias("term")).distinct(), "entity", "entity", any_sign=True).select(F.col("entity").alias("holder"), "term")
    inside = short.join(held, F.col("low") == F.col("term")).join(known, F.col("holder") == F.col("entity"))
    best = staged(exact, 1).unionByName(staged(named, 2)).unionByName(staged(inside, 3)).groupBy("query_id").agg(F.min("found").alias("found"))
    first = F.row_number().over(Window.partitionBy("entity").orderBy("id"))
    # no more entities than queries: others' mentions do not move
    named_ones = search.small(best.select(F.col("found.entity").alias("entity")).distinct(), queries.count())
    said = mentions.filter(F.size("terms") > 0).join(named_ones, "entity", "left_semi").withColumn("n", first).filter(F.col("n") <= s.boost_mentions)
    said = said.groupBy(F.col("entity").alias("of")).agg(F.array_sort(F.collect_list(F.struct("n", "terms"))).alias("said"))
    beside = short.join(best, "query_id").join(said, F.col("found.entity") == F.col("of"))
    others = F.filter(F.array_distinct(F.flatten(F.transform("said", lambda x: x["terms"]))), lambda t: F.lower(t) != F.col("low"))
    beside = beside.withColumn("more", F.slice(others, 1, s.boost_terms)).filter(F.size("more") > 0)
    return beside.select("query_id", F.concat("query", F.lit(" "), F.array_join("more", " ")).alias("boosted"))


def without_absorbed(hits: Column) -> Column:
    """Of ranked hits (document, position, ...) those that stay: one whose neighbour stands before it in the list is in that one's passage already."""

    def take(kept: Column, hit: Column) -> Column:
        near = F.exists(kept, lambda k: k["document"].eqNullSafe(hit["document"]) & (F.abs(k["position"] - hit["position"]) <= 1))
        return F.when(near, kept).otherwise(F.array_append(kept, hit))

    return F.aggregate(hits, F.slice(hits, 1, 0), take)


def confidence(n: Column, scores: Column, best_distance: Column, synthetic: Column) -> Column:
    """Of ``n`` passages: by the nearest vector and, where scores are real, by how far the first stands out; 0 for none."""
    near = F.when(best_distance < 0.5, 0.8).when(best_distance < 0.8, 0.5).when(best_distance < 1.0, 0.3).when(best_distance.isNotNull(), 0.1)
    alone = F.when(n >= 5, 0.6).when(n >= 3, 0.5).otherwise(0.35)
    ordered = F.sort_array(scores, asc=False)
    spread = F.get(ordered, F.lit(0)) - F.get(ordered, n - 1)
    ratio = F.when(spread > 0, (F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))) / spread).otherwise(0.0)
    share = 0.3 + 0.4 * ratio + F.when(spread > 0.01, 0.1).otherwise(0.0) + F.when(spread > 0.05, 0.1).otherwise(0.0) + F.when(n >= 3, 0.1).otherwise(0.0)
    real = F.least(F.lit(1.0), 0.5 * F.coalesce(near, F.lit(0.5)) + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    return F.when(n == 0, 0.0).when(synthetic, F.coalesce(near, alone)).when(n == 1, F.coalesce(near, F.lit(0.5))).otherwise(real)


@dataclass(frozen=True)
class Answers:
    #: query_id, strategy, candidates, returned, confidence, vector_hits, gated, word_hits, best_distance
    summary: DataFrame
    #: query_id, place, item, document, position, collection, parts, passage, score
    passages: DataFrame


def answer(
    queries: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, scores: DataFrame | None = None, s: Settings | None = None, titles: bool = False, vectors: DataFrame | None = None,
) -> Answers:
    """Passages for queries (query_id, query, vector, collection; a null collection is all) from chunks (item, document, position, collection, text, embedding); ``vectors`` (item, embedding) may stand apart.

    Words must all be held; vectors within the gate are near. Both lists are fused by rank, or the
    vectors stand alone where no text holds the words. The best candidates take in their neighbours before and
    after (not with ``titles``), and hits that one of them has taken in drop out. ``scores`` (query_id, item, score) are a
    model's: unless the nearest vector stands clear of the next, or none is near, passages are ordered by them, without those
    that have no finite score of ``least_score``; a query without any score keeps its order. Scores are then 1 - i / n.
    """
    s = s or Settings()
    # an empty query has no place in any list
    asked = durable(queries.select("query_id", F.coalesce(F.trim("query"), F.lit("")).alias("query"), "vector", "collection"))
    heard = asked.filter("query <> ''")
    more = durable(boosted(heard, entities, mentions, s))
    spoken = heard.join(more, "query_id", "left").select("query_id", F.coalesce("boosted", "query").alias("query"), "collection")
    places = chunks.select("item", F.col("collection").alias("at"))
    within = F.col("collection").isNull() | (F.col("collection") == F.col("at"))

    worded = search.bm25(chunks, search.query_terms(spoken), spoken.count(), "item", "text").withColumnRenamed("doc_id", "item")
    worded = worded.join(places, "item").join(spoken.select("query_id", "collection"), "query_id").filter(within)
    words = durable(search.top(worded, [F.desc(F.round("score", 9)), F.col("item")], s.candidates).select("query_id", "item", "rank"))

    named, everywhere = heard.filter("collection IS NOT NULL AND vector IS NOT NULL"), heard.filter("collection IS NULL AND vector IS NOT NULL")
    held = chunks.select("item", "embedding", "collection") if vectors is None else vectors.select("item", "embedding").join(chunks.select("item", "collection"), "item")
    corpus = held.withColumnRenamed("item", "vec_id")
    near = search.nearest(corpus, named, s.candidates, "collection").unionByName(search.nearest(corpus, everywhere, s.candidates))
    near = durable(near.select("query_id", F.col("vec_id").alias("item"), "distance"))
    good = near.filter(F.col("distance") < s.gate)
    vectors = search.top(good, [F.round("distance", 9), F.col("item")], s.candidates)
    fused = search.fuse(
        {"vectors": vectors.filter(F.col("rank") <= s.longest).select("query_id", "item", "rank"), "words": words.filter(F.col("rank") <= s.longest)},
        {"vectors": s.vector_weight, "words": s.word_weight}, s.constant,
    )
    # where no text holds the words, ranks of the vectors alone give the same order as their distances
    ranked = durable(search.top(fused, [F.desc(F.round("score", 12)), F.col("item")], s.candidates).select("query_id", "item", F.col("rank").alias("at")))

    # what follows is as wide as the queries are many, and texts stay where they are
    n_queries = asked.count()
    hit = chunks.select("item", "document", "position", "collection").join(search.small(ranked, n_queries), "item")
    hits = hit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "item", "document", "position", "collection"))).alias("hits"))
    kept = F.col("hits") if titles else without_absorbed(F.col("hits"))
    hits = durable(hits.withColumn("hits", kept).select("query_id", F.size("hits").alias("n"), F.posexplode("hits").alias("i", "h")).select("query_id", "n", "i", "h.*"))
    if titles:
        found = chunks.select("item", F.col("text").alias("passage")).join(search.small(hits, n_queries), "item").withColumn("parts", F.lit(1))
    else:
        wanted = hits.withColumn("beside", F.explode(F.array(F.col("position") - 1, F.col("position"), F.col("position") + 1)))
        texts = chunks.select(F.col("document").alias("of"), F.col("position").alias("there"), "text")
        parts = texts.join(search.small(wanted, n_queries), (F.col("document") == F.col("of")) & (F.col("beside") == F.col("there")))
        group = ["query_id", "n", "i", "at", "item", "document", "position", "collection"]
        parts = parts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("there", "text"))).alias("p"))
        found = parts.select(*group, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("passage"), F.size("p").alias("parts"))

    first, second = search.top(good, [F.col("distance"), F.col("item")], 2), F.col("rank") == 2
    lead = first.groupBy("query_id").agg(F.max(F.when(~second, F.col("distance"))).alias("best_distance"), F.max(F.when(second, F.col("distance"))).alias("next"))
    clear = F.col("next").isNotNull() & (F.col("best_distance") <= s.skip_distance) & ((F.col("best_distance") == 0) | (F.col("next") / F.col("best_distance") > s.skip_ratio))
    lead = lead.withColumn("clear", clear)
    counts = near.groupBy("query_id").agg(F.count("*").alias("vector_hits"), F.count(F.when(F.col("distance") >= s.gate, 1)).alias("gated"))
    worded_counts = words.groupBy("query_id").agg(F.count("*").alias("word_hits"))
    candidates = ranked.groupBy("query_id").agg(F.count("*").alias("candidates"))
    state = asked.select("query_id", "query").join(lead, "query_id", "left").join(counts, "query_id", "left").join(worded_counts, "query_id", "left").join(candidates, "query_id", "left")
    state = state.join(more.select("query_id", F.lit(True).alias("boost")), "query_id", "left")

    synthetic = 1 - F.col("i") / F.col("n")
    found = found.join(lead.select("query_id", "best_distance", "clear"), "query_id", "left")
    if scores is None:
        found = found.withColumn("score", synthetic).withColumn("real", F.lit(False)).withColumn("tried", F.lit(False))
    else:
        given = scores.select("query_id", "item", F.col("score").alias("given"))
        tried = (F.col("n") > 1) & ~F.coalesce("clear", F.lit(False)) & F.col("best_distance").isNotNull()
        found = found.join(given, ["query_id", "item"], "left").withColumn("tried", tried)
        scored = F.max(F.col("given").isNotNull()).over(Window.partitionBy("query_id"))  # at most ``candidates`` rows a query
        found = found.withColumn("real", F.col("tried") & scored)
        finite = F.col("given").isNotNull() & ~F.isnan("given") & (F.abs("given") < float("inf")) & (F.col("given") >= s.least_score)
        found = found.filter(~F.col("real") | finite).withColumn("score", F.when(F.col("real"), F.col("given")).when(F.col("tried"), 1.0).otherwise(synthetic))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "i"))
    found = durable(found.withColumn("place", place).filter(F.col("place") <= s.top))
    told = found.groupBy("query_id").agg(F.count("*").alias("returned"), F.collect_list("score").alias("scores"), F.bool_or("real").alias("real"), F.bool_or("tried").alias("tried"))
    state = state.join(told, "query_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = F.coalesce("returned", F.lit(0)).cast("int")
    strategy = F.concat(
        F.lit("dense"), F.when(yes("boost"), "+entity_boost").otherwise(""), F.when(F.coalesce("word_hits", F.lit(0)) > 0, "+hybrid").otherwise(""),
        F.when(F.lit(titles) & (n > 0), "+titles").when(yes("real"), "+rerank").when(yes("tried"), "+rerank-fallback").when(F.lit(scores is not None) & yes("clear") & (n > 1), "+skip-rerank").otherwise(""),
    )
    sure = F.when(F.lit(titles) & (n > 0), 0.5).otherwise(confidence(n, F.col("scores"), F.col("best_distance"), ~yes("real")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = state.select(
        "query_id", F.when(F.col("query") == "", "rejected:empty").otherwise(strategy).alias("strategy"), zero("candidates"), zero("returned"), sure.alias("confidence"),
        zero("vector_hits"), zero("gated"), zero("word_hits"), "best_distance",
    )
    return Answers(summary, found.select("query_id", "place", "item", "document", "position", "collection", "parts", "passage", "score"))

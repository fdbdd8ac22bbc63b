"""Retrieval from question to passages, over documents as chunks of larger ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import awareness, packing, retrieve
from textlode.plans.aware import ENTITIES_SQL, MENTION_ROWS_SQL, mention_rows
from textlode.plans.registry import query
from textlode.plans.retrieval import bm25_rows_sql
from textlode.sources.tables import table

SETTINGS = retrieve.Settings(top=5)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbouring documents are the chunks of one."""
    d = table(spark, sf_dir, "documents")
    document = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 4).cast("string"))
    return d.select(F.col("doc_id").alias("item"), document.alias("document"), (F.col("doc_id") % 4).cast("int").alias("position"), F.col("source").alias("collection"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of each benchmark item: two neighbours of its words, one word, or nothing; a third of them asks one collection."""
    w = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda x: x != "")
    n = F.col("item_id")
    said = F.when(n % 4 == 0, F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)))).when(n % 4 == 1, F.get(w, F.lit(1))).when(n % 4 == 2, F.array_join(F.slice(w, 1, 3), " ")).otherwise("")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    b = table(spark, sf_dir, "benchmark").join(v, "item_id", "left")
    return b.select(n.alias("query_id"), said.alias("query"), F.when(n % 5 != 0, F.col("vector")).alias("vector"), F.when(n % 3 == 0, "src0").alias("collection"))


def answers(spark: SparkSession, sf_dir: str) -> retrieve.Answers:
    m = mention_rows(spark, sf_dir, once=True)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    entities = awareness.entities(m).select("entity", F.lit("term").alias("type"), "mentions")
    return retrieve.answer(asked(spark, sf_dir), chunks(spark, sf_dir), entities, m.select("id", "entity", "terms"), s=SETTINGS, vectors=vectors)


ANSWERS_SQL = f"""WITH {MENTION_ROWS_SQL}, {ENTITIES_SQL},
chunks AS (SELECT doc_id AS item, 'd' || (doc_id // 4) AS document, (doc_id % 4)::INTEGER AS position, source AS collection, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
asked AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN w[2] WHEN 2 THEN array_to_string(w[1:3], ' ') ELSE '' END AS query,
  CASE WHEN item_id % 5 <> 0 THEN embedding END AS vector, CASE WHEN item_id % 3 = 0 THEN 'src0' END AS collection
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM benchmark) LEFT JOIN embeddings ON vec_id = item_id),
heard AS (SELECT * FROM asked WHERE query <> ''),
often AS (SELECT * FROM seen WHERE mentions >= 2),
staged AS (SELECT query_id, query, entity, CASE WHEN query = entity THEN 2 ELSE 3 END AS stage, mentions FROM heard JOIN often ON contains(lower(entity), query) WHERE len(string_split(query, ' ')) <= 2),
named AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY stage, mentions DESC, entity) = 1),
said AS (SELECT entity, flatten(list(terms ORDER BY id)) AS terms FROM (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY entity ORDER BY id) <= 5) GROUP BY entity),
beside AS (SELECT query_id, query, list_filter(terms, lambda t, i: lower(t) <> query AND list_position(terms, t) = i)[1:3] AS more FROM named JOIN said USING (entity)),
questions AS (SELECT h.query_id, translate(CASE WHEN len(more) > 0 THEN h.query || ' ' || array_to_string(more, ' ') ELSE h.query END, '{T.MARKED}', '{T.PLAIN}') AS query, coalesce(len(more) > 0, false) AS boost, collection FROM heard h LEFT JOIN beside b ON b.query_id = h.query_id),
{bm25_rows_sql('chunks', 'item')},
wordy AS (SELECT s.query_id, s.doc_id AS item, row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, s.doc_id) AS rank FROM summed s JOIN questions q ON q.query_id = s.query_id
  JOIN chunks c ON c.item = s.doc_id AND (q.collection IS NULL OR q.collection = c.collection) WHERE hits = n_terms QUALIFY rank <= 10),
near AS (SELECT query_id, item, list_distance(vector::DOUBLE[], embedding::DOUBLE[]) AS distance FROM heard h JOIN chunks c ON vector IS NOT NULL AND embedding IS NOT NULL AND (h.collection IS NULL OR h.collection = c.collection)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(vector::DOUBLE[], embedding::DOUBLE[]), 9), item) <= 10),
good AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), item) AS rank FROM near WHERE distance < 1.05),
fused AS (SELECT query_id, item, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, item, rank FROM good UNION ALL SELECT query_id, item, rank FROM wordy) GROUP BY ALL),
ranked AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item) AS spot FROM fused QUALIFY spot <= 10),
lists AS (SELECT query_id, list_reduce(list({{'item': c.item, 'document': c.document, 'position': c.position, 'collection': c.collection}} ORDER BY spot), lambda kept, x:
    CASE WHEN len(list_filter(kept, lambda k: k.document = x.document AND abs(k.position - x.position) <= 1)) > 0 THEN kept ELSE kept || [x] END,
  []::STRUCT(item BIGINT, document VARCHAR, position INTEGER, collection VARCHAR)[]) AS kept FROM ranked r JOIN chunks c USING (item) GROUP BY query_id),
hits AS (SELECT query_id, len(kept) AS n, unnest(range(len(kept))) AS i, unnest(kept, recursive := true) FROM lists),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS place, 1 - i / n AS score FROM hits QUALIFY place <= 5)"""


@query(f"""{ANSWERS_SQL} SELECT p.query_id, p.place, p.item, p.document, p.position, p.collection, count(*)::INTEGER AS parts, string_agg(c.text, chr(10) || chr(10) ORDER BY c.position) AS passage, p.score
FROM placed p JOIN chunks c ON c.document = p.document AND abs(c.position - p.position) <= 1 GROUP BY ALL""")
def answer_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages for each question, from entity boost to neighbours."""
    return answers(spark, sf_dir).passages


@query(f"""{ANSWERS_SQL}, lead AS (SELECT query_id, min(distance) AS best_distance FROM good GROUP BY 1), counts AS (SELECT query_id, count(*) AS vector_hits, count(*) FILTER (distance >= 1.05) AS gated FROM near GROUP BY 1),
worded AS (SELECT query_id, count(*) AS word_hits FROM wordy GROUP BY 1), told AS (SELECT query_id, count(*) AS returned FROM placed GROUP BY 1), met AS (SELECT query_id, count(*) AS candidates FROM ranked GROUP BY 1)
SELECT a.query_id, CASE WHEN a.query = '' THEN 'rejected:empty' ELSE 'dense' || CASE WHEN boost THEN '+entity_boost' ELSE '' END || CASE WHEN word_hits > 0 THEN '+hybrid' ELSE '' END END AS strategy,
  coalesce(candidates, 0) AS candidates, coalesce(returned, 0) AS returned, coalesce(vector_hits, 0) AS vector_hits, coalesce(gated, 0) AS gated, coalesce(word_hits, 0) AS word_hits, round(best_distance, 6) AS best_distance,
  CASE WHEN returned IS NULL THEN 0.0 WHEN best_distance < 0.5 THEN 0.8 WHEN best_distance < 0.8 THEN 0.5 WHEN best_distance < 1.0 THEN 0.3 WHEN best_distance IS NOT NULL THEN 0.1
    WHEN returned >= 5 THEN 0.6 WHEN returned >= 3 THEN 0.5 ELSE 0.35 END::DOUBLE AS confidence
FROM asked a LEFT JOIN questions q ON q.query_id = a.query_id LEFT JOIN lead l ON l.query_id = a.query_id LEFT JOIN counts c ON c.query_id = a.query_id LEFT JOIN worded w ON w.query_id = a.query_id
LEFT JOIN told t ON t.query_id = a.query_id LEFT JOIN met m ON m.query_id = a.query_id""")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each question was answered, and how sure that is."""
    return answers(spark, sf_dir).summary.withColumn("best_distance", F.round("best_distance", 6))


@query()
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages packed into a budget of tokens, by source: tests/test_packing.py has the fold."""
    found = answers(spark, sf_dir).passages
    ranked = found.select("query_id", F.col("document").alias("source"), "item", F.col("place").alias("rank"), T.estimate_tokens(F.col("passage")).alias("tokens"))
    return packing.pack_context(ranked, 3000)

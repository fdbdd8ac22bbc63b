"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import search
from textlode.plans.registry import query
from textlode.sources.tables import table

QUESTIONS = ["the and", "licensed version", "under apache license", "and that with", "der und"]
OR_QUESTIONS = ["the zzzz", "the and", "qqqq"]

#: The vectors, and a near copy of every 25th and a somewhat near one of every 40th, so that duplicates and clear winners occur.
VECTORS_SQL = """(SELECT vec_id, label, embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000000, label, list_concat([embedding[1] + 0.05::FLOAT], embedding[2:])::FLOAT[] FROM embeddings WHERE vec_id % 25 = 0
  UNION ALL SELECT vec_id + 2000000000, label, list_concat([embedding[1] + 0.5::FLOAT], embedding[2:])::FLOAT[] FROM embeddings WHERE vec_id % 40 = 0)"""


def vectors_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda by: F.concat(F.array((F.element_at("embedding", 1) + F.lit(by).cast("float")).cast("float")), F.slice("embedding", 2, 100_000))
    row = lambda plus, vector: F.struct((F.col("vec_id") + plus).alias("vec_id"), vector.alias("embedding"))
    copies = F.array(
        row(F.lit(0), F.col("embedding")), F.when(F.col("vec_id") % 25 == 0, row(F.lit(1_000_000_000), moved(0.05))), F.when(F.col("vec_id") % 40 == 0, row(F.lit(2_000_000_000), moved(0.5)))
    )
    every = table(spark, sf_dir, "embeddings").select("label", F.explode(F.array_compact(copies)).alias("v"))
    return every.select("v.vec_id", "label", "v.embedding")


#: The vectors that are asked: every twentieth row, and for fused queries also those of the questions.
ASKED = "vec_id % 20 = 0"
FUSED = f"({ASKED} OR vec_id < {len(QUESTIONS)})"

TOKENS_SQL = "list_filter(regexp_split_to_array(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def bm25_sql(questions: list[str], source: str, key: str) -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, q in enumerate(questions))
    return f"""
questions AS (SELECT * FROM (VALUES {rows}) AS q(query_id, query)),
{bm25_rows_sql(source, key)}"""


def bm25_rows_sql(source: str, key: str) -> str:
    """From ``questions`` (query_id, query) on."""
    return f"""terms AS (SELECT query_id::BIGINT AS query_id, unnest(list_distinct(string_split(query, ' '))) AS term, len(list_distinct(string_split(query, ' '))) AS n_terms FROM questions),
split AS (SELECT {key} AS doc_id, {TOKENS_SQL} AS words FROM {source}),
totals AS (SELECT count(*) AS n_docs, avg(len(words)) AS mean_length FROM split),
counted AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM split) GROUP BY ALL),
frequencies AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
weighed AS (SELECT t.*, CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf
  FROM terms t JOIN frequencies USING (term), totals),
summed AS (SELECT query_id, doc_id, n_terms, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * length / mean_length))) AS score, count(*) AS hits
  FROM counted JOIN weighed USING (term), totals GROUP BY ALL)"""


BM25_ROWS = "bm25 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM summed WHERE hits = n_terms)"
def knn_sql(asked: str) -> str:
    return f"""knn AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), c.vec_id) AS rank
  FROM embeddings c, embeddings q WHERE {asked.replace("vec_id", "q.vec_id")})"""


KNN_ROWS = knn_sql(ASKED)


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    found = search.bm25(table(spark, sf_dir, "documents"), search.query_table(spark, QUESTIONS), len(QUESTIONS))
    return search.top(found, [F.desc(F.round("score", 9)), F.col("doc_id")], k)


def _knn(spark: SparkSession, sf_dir: str, k: int, same: bool = False, asked: str = ASKED) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return search.nearest(vectors, queries, k, "label" if same else None)


@query(f"WITH {bm25_sql(QUESTIONS, 'documents', 'doc_id')}, {BM25_ROWS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {bm25_sql(OR_QUESTIONS, "(SELECT conv_id || ':' || turn AS msg_id, text FROM conversations)", "msg_id")},
strict AS (SELECT DISTINCT query_id FROM summed WHERE hits = n_terms)
SELECT query_id, doc_id, round(score, 6) AS score, hits = n_terms AS strict FROM summed
WHERE hits = n_terms OR query_id NOT IN (SELECT query_id FROM strict)"""
)
def bm25_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("msg_id"), "text")
    found = search.bm25(docs, search.query_table(spark, OR_QUESTIONS), len(OR_QUESTIONS), "msg_id", every=None)
    any_strict = F.max("strict").over(Window.partitionBy("query_id"))
    return found.withColumn("any", any_strict).filter("strict OR NOT any").select("query_id", "doc_id", F.round("score", 6).alias("score"), "strict")


@query(f"WITH {KNN_ROWS} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM knn WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT q.vec_id AS query_id, c.vec_id, round(list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), c.vec_id) AS rank
  FROM embeddings c JOIN embeddings q ON c.label = q.label WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5"""
)
def knn_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 5, same=True).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {KNN_ROWS} SELECT query_id, vec_id, round(distance, 6) AS distance FROM knn WHERE rank <= 20 AND distance < 1.05")
def similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 20).filter("distance < 1.05").select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def fused_sql(w1: float, w2: float) -> str:
    return f"""WITH {bm25_sql(QUESTIONS, 'documents', 'doc_id')}, {BM25_ROWS}, {knn_sql(FUSED)},
parts AS (SELECT query_id, doc_id AS item, {w1}::DOUBLE / (60 + rank) AS part FROM bm25 WHERE rank <= 100
  UNION ALL SELECT query_id, vec_id, {w2}::DOUBLE / (60 + rank) FROM knn WHERE rank <= 100),
fused AS (SELECT query_id, item, sum(part) AS score FROM parts GROUP BY ALL)"""


def _fused(spark: SparkSession, sf_dir: str, w1: float, w2: float) -> DataFrame:
    words = _bm25(spark, sf_dir, 100).withColumnRenamed("doc_id", "item")
    vectors = _knn(spark, sf_dir, 100, asked=FUSED).withColumnRenamed("vec_id", "item")
    return search.fuse({"words": words, "vectors": vectors}, {"words": w1, "vectors": w2})


@query(fused_sql(1.0, 1.0) + " SELECT query_id, item, round(score, 9) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 1.0, 1.0).withColumn("score", F.round("score", 9))


@query(fused_sql(0.3, 0.7) + " SELECT query_id, item, round(score, 9) AS score FROM fused")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 0.3, 0.7).withColumn("score", F.round("score", 9))


@query(
    fused_sql(1.0, 1.0)
    + """, best AS (SELECT query_id, item, score, source, count(*) OVER (PARTITION BY query_id, source) AS chunks,
  row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, item) AS r FROM fused JOIN documents d ON d.doc_id = item),
lines AS (SELECT *, ceil(length(source || ' (' || chunks || ')') / 3.8::DOUBLE)::BIGINT AS cost FROM best WHERE r = 1),
packed AS (SELECT *, sum(cost) OVER w AS running, row_number() OVER w AS place FROM lines WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT query_id, place, source, chunks, item, round(score, 9) AS score FROM packed WHERE running <= 50 OR place = 1"""
)
def retrieve_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused retrieval, the best hit of each source, and titles within 50 tokens."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source")
    found = _fused(spark, sf_dir, 1.0, 1.0).join(source, "item").withColumn("score", F.round("score", 9))
    counted = found.withColumn("chunks", F.count("*").over(Window.partitionBy("query_id", "source")))
    best = search.best_per_source(counted)
    line = F.concat(F.col("source"), F.lit(" ("), F.col("chunks").cast("string"), F.lit(")"))
    priced = best.withColumn("cost", T.estimate_tokens(line))
    packed = search.within_budget(priced, ["query_id"], [F.desc("score"), F.col("item")], "cost", 50, 1)
    return packed.select("query_id", F.col("place").cast("long").alias("place"), "source", "chunks", "item", "score")


@query(
    f"""WITH knn AS (SELECT q.vec_id AS query_id, list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), c.vec_id) AS rank
  FROM {VECTORS_SQL} c, embeddings q WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, max(distance) FILTER (rank = 2) / nullif(max(distance) FILTER (rank = 1), 0) > 2
  OR max(distance) FILTER (rank = 1) = 0 AS clear, coalesce((max(distance) FILTER (rank = 1)) <= 0.8
  AND (max(distance) FILTER (rank = 1) = 0 OR max(distance) FILTER (rank = 2) / max(distance) FILTER (rank = 1) > 2), false) AS skip
  FROM knn WHERE rank <= 2 GROUP BY query_id"""
)
def rerank_skip_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the nearest other vector near, and clearly nearer than the next? The vector itself is in the corpus and does not count."""
    corpus = vectors_with_copies(spark, sf_dir)
    queries = table(spark, sf_dir, "embeddings").filter(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    others = search.nearest(corpus, queries, 3).filter("vec_id <> query_id").drop("rank")
    two = search.top(others, [F.round("distance", 9), F.col("vec_id")], 2).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("b")
    )
    clear = (F.try_divide("b", F.nullif(F.col("a"), F.lit(0.0))) > 2) | (F.col("a") == 0)
    return two.select("query_id", clear.alias("clear"), F.coalesce((F.col("a") <= 0.8) & clear, F.lit(False)).alias("skip"))


@query(
    f"""WITH {KNN_ROWS}, top AS (SELECT * FROM knn WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10)
SELECT query_id, vec_id, CASE WHEN hi = lo THEN '●●●' WHEN (hi - distance) / (hi - lo) >= 0.75 THEN '●●●' WHEN (hi - distance) / (hi - lo) >= 0.5 THEN '●●○'
  WHEN (hi - distance) / (hi - lo) >= 0.25 THEN '●○○' ELSE '○○○' END AS label,
  CASE WHEN lo < 0.5 THEN 0.8 WHEN lo < 0.8 THEN 0.5 WHEN lo < 1.0 THEN 0.3 ELSE 0.1 END::DOUBLE AS confidence
FROM (SELECT *, min(distance) OVER (PARTITION BY query_id) AS lo, max(distance) OVER (PARTITION BY query_id) AS hi FROM top)"""
)
def relevance_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the ten nearest other vectors, by their place between the nearest and the farthest of them."""
    w = Window.partitionBy("query_id")
    others = search.top(_knn(spark, sf_dir, 11).filter("vec_id <> query_id").withColumnRenamed("rank", "own"), [F.col("own")], 10)
    rows = others.withColumn("lo", F.min("distance").over(w)).withColumn("hi", F.max("distance").over(w))
    share = F.try_divide(F.col("hi") - F.col("distance"), F.col("hi") - F.col("lo"))
    return rows.select("query_id", "vec_id", T.relevance_label(share).alias("label"), T.distance_confidence(F.col("lo")).alias("confidence"))


@query(
    """WITH near AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 1 AND contains(lower(text), 'a'))
SELECT n.conv_id, n.turn, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn) AS passage, count(*) AS parts
FROM near n JOIN conversations c ON c.conv_id = n.conv_id AND c.turn BETWEEN n.turn - 1 AND n.turn + 1 GROUP BY ALL"""
)
def neighbor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the turn before and after: three offsets and an equi-join instead of a range join."""
    c = table(spark, sf_dir, "conversations")
    hits = c.filter((F.col("turn") % 3 == 1) & F.contains(F.lower("text"), F.lit("a"))).select("conv_id", F.col("turn").alias("hit"))
    wanted = hits.withColumn("turn", F.explode(F.array(F.col("hit") - 1, F.col("hit"), F.col("hit") + 1)))
    parts = wanted.join(c.select("conv_id", "turn", "text"), ["conv_id", "turn"]).groupBy("conv_id", "hit").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("parts")
    )
    passage = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return parts.select("conv_id", F.col("hit").alias("turn"), passage.alias("passage"), F.size("parts").cast("long").alias("parts"))


@query(
    f"""WITH v AS (SELECT * FROM {VECTORS_SQL}), fresh AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT a, b FROM fresh WHERE s >= 0.95"""
)
def neardup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-equal vectors of one collection, block against block: only pairs that are close leave a block."""
    from textlode.operators.packing import close_pairs

    return close_pairs(vectors_with_copies(spark, sf_dir), "label", 0.95)

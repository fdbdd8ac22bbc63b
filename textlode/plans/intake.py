"""Ingest of files in two batches: what becomes of each, counters, stored documents, references, what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators import ingest
from textlode.plans.registry import query
from textlode.sources.tables import table

#: Every seventh document is a note that links to others; some files are of a kind that no parser reads.
PATH_SQL = "'docs/' || lang || '/d' || doc_id || CASE WHEN doc_id % 7 = 3 THEN '.md' WHEN doc_id % 41 = 8 THEN '.pdf' ELSE '.txt' END"
TEXT_SQL = "CASE WHEN doc_id % 7 = 3 THEN text || chr(10) || '[[D' || doc_id // 2 || ']] [[nowhere]] #linked' ELSE text END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    end = F.when(n % 7 == 3, ".md").when(n % 41 == 8, ".pdf").otherwise(".txt")
    path = F.concat(F.lit("docs/"), "lang", F.lit("/d"), n.cast("string"), end)
    tail = F.concat(F.lit("\n[[D"), F.floor(n / 2).cast("string"), F.lit("]] [[nowhere]] #linked"))
    text = F.when(n % 7 == 3, F.concat("text", tail)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), text.alias("text"), n.alias("mtime"), F.length(text).cast("long").alias("size"))


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first batch has two thirds of the files; the second all, some with new times, some with new words."""
    every = files(spark, sf_dir)
    n = F.col("doc_id")
    second = every.withColumn("text", F.when(n % 10 == 1, F.concat("text", F.lit(" and more"))).otherwise(F.col("text"))).withColumn("mtime", F.when(n % 2 == 1, F.col("mtime") + 5).otherwise(F.col("mtime")))
    return every.filter("doc_id % 3 <> 0").drop("doc_id"), second.drop("doc_id")


def second_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ingest.Store]:
    first, second = batches(spark, sf_dir)
    store = ingest.ingested(first, ingest.empty(spark))[2]
    return ingest.ingested(second, store, tags=("batch",))


OUTCOME_SQL = f"""base AS (SELECT doc_id, lang, {PATH_SQL} AS path, {TEXT_SQL} AS text FROM documents),
one AS (SELECT * FROM base WHERE doc_id % 3 <> 0), stored_one AS (SELECT * FROM one WHERE trim(text) <> '' AND NOT ends_with(path, '.pdf') QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path) = 1),
kept_one AS (SELECT s.* FROM stored_one s WHERE s.path = (SELECT min(path) FROM one o WHERE o.text = s.text)),
two AS (SELECT b.doc_id, b.lang, b.path, CASE WHEN b.doc_id % 10 = 1 THEN b.text || ' and more' ELSE b.text END AS text, k.path IS NOT NULL AS known, k.text AS old FROM base b LEFT JOIN kept_one k ON k.path = b.path),
marked AS (SELECT *, CASE WHEN known AND (doc_id % 2 = 0 OR text = old) THEN 'duplicate' WHEN known THEN 'update' WHEN text IN (SELECT text FROM kept_one) THEN 'duplicate' ELSE 'add' END AS action FROM two),
done AS (SELECT *, CASE WHEN action = 'add' AND path <> min(CASE WHEN action = 'add' THEN path END) OVER (PARTITION BY text) THEN 'duplicate' WHEN action IN ('add', 'update') AND ends_with(path, '.pdf') THEN 'failed' WHEN action IN ('add', 'update') AND trim(text) = '' THEN 'empty' ELSE action END AS final FROM marked)"""


@query(f"WITH {OUTCOME_SQL} SELECT path, final AS action FROM done")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each file of the second batch."""
    return second_batch(spark, sf_dir)[0].select("path", "action")


@query(f"WITH {OUTCOME_SQL} SELECT count(*) FILTER (final = 'add') AS added, count(*) FILTER (final = 'update') AS updated, count(*) FILTER (final = 'duplicate') AS duplicates FROM done")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_batch(spark, sf_dir)[1].select("added", "updated", "duplicates")


STORE_SQL = f"""{OUTCOME_SQL}, held AS (SELECT path, text, lang, doc_id, ['batch'] AS more FROM done WHERE final IN ('add', 'update') UNION ALL SELECT path, text, lang, doc_id, [] FROM kept_one WHERE path NOT IN (SELECT path FROM done WHERE final = 'update'))"""


@query(f"""WITH {STORE_SQL} SELECT path, sha256(text) AS content_hash, CASE WHEN ends_with(path, '.md') THEN 'markdown' ELSE 'plaintext' END AS kind,
  array_to_string(list_concat(CASE WHEN ends_with(path, '.md') THEN ['linked'] ELSE [] END, more, [right(path, length(path) - strpos(path, '.'))], [lang]), ',') AS tags FROM held""")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the store after both batches."""
    return second_batch(spark, sf_dir)[2].documents.select("path", "content_hash", "kind", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {STORE_SQL}, named AS (SELECT path, 'd' || doc_id AS name FROM held) SELECT h.path AS source, n.path AS target FROM held h JOIN named n ON n.name = 'd' || (h.doc_id // 2) WHERE h.doc_id % 7 = 3 AND n.path <> h.path""")
def ingested_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' links lead to which."""
    store = second_batch(spark, sf_dir)[2]
    paths = store.documents.select("document_id", "path")
    named = ingest.references(store).join(paths.select(F.col("document_id").alias("source"), F.col("path").alias("from")), "source")
    return named.join(paths.select(F.col("document_id").alias("target"), F.col("path").alias("to")), "target").select(F.col("from").alias("source"), F.col("to").alias("target"))

"""Further queries: safety, links, extraction, packing, upserts, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import compaction, packing
from textlode.plans.registry import query
from textlode.plans.relational import MENTIONS_SQL, mentions
from textlode.plans.retrieval import QUESTIONS, _bm25, vectors_with_copies
from textlode.sources.tables import CLAIMS_SQL, MESSAGES_SQL, claims, messages, table

PRIVATE = (
    "^(localhost$|0\\.|127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\."
    "|\\[(::1?\\]|::ffff:|fe[89ab]|f[cd]))"
)
#: Hosts that stand in for some pages' own, so that each rule is met.
HOSTS = ("http://127.0.0.1/a", "https://[::1]:80/a", "http://0.0.0.0/", "http://100.64.9.9/", "ftp://example.org/a", "https://[fd00::2]/", "http://172.20.0.1:8080/", "https://LocalHost/")
FORBIDDEN = ("token", "password", "license", "secret")
PHRASES = ("share the token", "the Pass\u200bword is", "LICENSE key", "no se\u200dcret here", "nothing")
SUBJECTS = ("red", "red bolt", "bolt", "old", "old anvil", "gear")


@query(rf"""WITH u AS (SELECT page_id, CASE WHEN page_id % 10 < {len(HOSTS)} THEN ([{', '.join(f"'{h}'" for h in HOSTS)}])[1 + page_id % 10] ELSE url END AS url FROM pages)
SELECT page_id, host, NOT regexp_matches(host, '{PRIVATE}') AND scheme IN ('http', 'https') AS safe
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(\[[0-9a-fA-F:.]+\]|[^/:?#]+)', 1)) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM u)""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % 10).cast("int"))
    p = table(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 10 < len(HOSTS), other).otherwise(F.col("url")))
    host, scheme = F.lower(F.regexp_extract("url", "^[a-z]+://(\\[[0-9a-fA-F:.]+\\]|[^/:?#]+)", 1)), F.regexp_extract("url", "^([a-z]+)://", 1)
    return p.select("page_id", host.alias("host"), (~host.rlike(PRIVATE) & scheme.isin("http", "https")).alias("safe"))


@query("""WITH links AS (SELECT c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE 'missing' END) AS link
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
names AS (SELECT lower(n_name) AS name, min(n_nationkey) AS target FROM nation GROUP BY 1),
aliases AS (SELECT lower(r_name) AS name, min(n_nationkey) AS target FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
SELECT c_custkey, link, coalesce(n.target, a.target) AS target FROM links l LEFT JOIN names n ON n.name = l.link LEFT JOIN aliases a ON a.name = l.link""")
def vault_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to notes: by name first, then by alias, whatever the case."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    named = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    link = F.lower(F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).when(F.col("c_custkey") % 3 == 1, F.col("r_name")).otherwise("missing"))
    links = c.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", link.alias("link"))
    by = lambda col, out: named.groupBy(F.lower(col).alias("link")).agg(F.min("n_nationkey").alias(out))
    return links.join(by("n_name", "note"), "link", "left").join(by("r_name", "alias"), "link", "left").select("c_custkey", "link", F.coalesce("note", "alias").alias("target"))


@query(f"""WITH said AS (SELECT conv_id, turn, text || ' ' || ([{', '.join(f"'{p}'" for p in PHRASES)}])[1 + (conv_id * 3 + turn) % {len(PHRASES)}] AS text FROM conversations)
SELECT conv_id, turn, term FROM said, (VALUES {', '.join(f"('{t}')" for t in FORBIDDEN)}) AS f(term)
WHERE contains(regexp_replace(lower(text), '[​‌‍﻿]', '', 'g'), term)""")
def invariant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, each with a phrase after it, that hold a forbidden term even with invisible characters inside: the fixed terms are tested in a row, so nothing is joined."""
    phrase = F.get(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") * 3 + F.col("turn")) % len(PHRASES)).cast("int"))
    low = F.regexp_replace(F.lower(F.concat_ws(" ", "text", phrase)), "[​‌‍﻿]", "")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", low.alias("low"))
    held = F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda t: F.contains("low", t))
    return c.select("conv_id", "turn", F.explode(held).alias("term"))


@query("SELECT p_partkey, arg_max(s, length(s) * 1000 + ascii(s)) AS subject FROM part, (VALUES " + ", ".join(f"('{t}')" for t in SUBJECTS) + ") AS k(s) WHERE contains(p_name, s) GROUP BY p_partkey")
def known_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest known subject that a name contains."""
    held = F.filter(F.array(*map(F.lit, SUBJECTS)), lambda s: F.contains("p_name", s))
    best = F.array_max(F.transform(held, lambda s: F.struct(F.length(s).alias("n"), F.ascii(s).alias("a"), s.alias("s"))))
    return table(spark, sf_dir, "part").select("p_partkey", best["s"].alias("subject")).filter("subject IS NOT NULL")


@query("""SELECT conv_id, turn, lag(turn) OVER w IS NOT NULL AS has_more FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY (CASE WHEN turn < 6 THEN turn END) DESC NULLS LAST) <= 3 AND turn < 6""")
def conversation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns before a cursor, and whether there are more before each."""
    by = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").filter("turn < 6")
    more = c.withColumn("has_more", F.lag("turn").over(by.orderBy("turn")).isNotNull())
    return more.withColumn("n", F.row_number().over(by.orderBy(F.desc("turn")))).filter("n <= 3").select("conv_id", "turn", "has_more")


@query("""SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' / ') AS context FROM conversations QUALIFY turn > 0""")
def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    c = table(spark, sf_dir, "conversations").withColumn("context", F.array_join(F.collect_list("text").over(w), " / "))
    return c.filter("turn > 0").select("conv_id", "turn", "context")


@query(f"""WITH {CLAIMS_SQL}, o AS (SELECT canonical_key, max(confidence) AS c FROM claims WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY 1),
n AS (SELECT canonical_key, max(confidence) AS c FROM claims WHERE created_at >= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT canonical_key, round(CASE WHEN o.c IS NULL THEN n.c WHEN n.c IS NULL THEN o.c ELSE 0.7::DOUBLE * n.c + 0.3::DOUBLE * o.c END, 6) AS confidence FROM o FULL JOIN n USING (canonical_key)""")
def upsert_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones by key: confidences blend."""
    side = lambda op, name: claims(spark, sf_dir).filter(f"created_at {op} TIMESTAMP_NTZ '2024-01-20 00:00:00'").groupBy("canonical_key").agg(F.max("confidence").alias(name))
    both = side("<", "o").join(side(">=", "n"), "canonical_key", "full")
    return both.select("canonical_key", F.round(F.coalesce(0.7 * F.col("n") + 0.3 * F.col("o"), "n", "o"), 6).alias("confidence"))


@query(f"""WITH {MENTIONS_SQL}, kept AS (SELECT * FROM mentions WHERE source NOT IN ('src0', 'src1'))
SELECT term, count(*) AS mentions FROM kept GROUP BY term""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are left, with their mentions, once two sources are gone: an anti join with the deleted sources."""
    gone = spark.createDataFrame([("src0",), ("src1",)], "source string")
    return mentions(spark, sf_dir).join(F.broadcast(gone), "source", "left_anti").groupBy("term").agg(F.count("*").alias("mentions"))


@query("""SELECT user_id, ts::DATE AS day, min(event_id) AS holder FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY ALL""")
def lease_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first to ask for a resource on a day holds it."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return e.agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("holder"))


@query("""WITH near AS (SELECT a.vec_id, min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b
  ON a.label = b.label AND b.vec_id < a.vec_id GROUP BY 1) SELECT vec_id, d <= sqrt(2 * 0.05::DOUBLE) AS duplicate FROM near""")
def existing_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a vector near an earlier one of its collection? The nearest decides, so blocks send one distance a vector."""
    v = table(spark, sf_dir, "embeddings")
    nearest = packing.nearest_before(v, None, "label").groupBy("vec_id").agg(F.min("distance").alias("d"))
    return nearest.select("vec_id", (F.col("d") <= (2 * 0.05) ** 0.5).alias("duplicate"))


@query()
def distinct_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.greedy_distinct(vectors_with_copies(spark, sf_dir), "label", 0.95)


@query(f"""WITH {MESSAGES_SQL}, t AS (SELECT conv_id, sum(tokens) AS n FROM messages GROUP BY 1)
SELECT conv_id, greatest(192, least(1200, floor(n * 0.35::DOUBLE)))::BIGINT AS normal, greatest(96, least(640, floor(n * 0.2::DOUBLE)))::BIGINT AS aggressive FROM t""")
def target_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = messages(spark, sf_dir).groupBy("conv_id").agg(F.sum("tokens").alias("n"))
    return t.select("conv_id", compaction.target_tokens(F.col("n")).alias("normal"), compaction.target_tokens(F.col("n"), True).alias("aggressive"))


@query()
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select("conv_id", F.col("turn").alias("ordinal"), F.lit("message").alias("kind"), "text", "tokens")
    return compaction.compact(m, tail=3, size=3, budget=100)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = _bm25(spark, sf_dir, 8).join(docs, "doc_id").join(F.broadcast(asked), "query_id")
    return found.withColumn("tokens", T.estimate_tokens(F.col("text"))).withColumnRenamed("doc_id", "item")


@query()
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_context(_ranked(spark, sf_dir), 2000)


@query()
def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.brief(_ranked(spark, sf_dir), 200)


@query("""WITH calls AS (SELECT user_id, json_extract_string(props, '$.k') AS k, min(event_id) AS call FROM events WHERE event_type = 'click' GROUP BY ALL),
results AS (SELECT user_id, json_extract_string(props, '$.k') AS k, min(event_id) AS result FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT c.user_id, c.k, c.call, r.result, CASE WHEN r.result IS NULL THEN 'synthetic error' ELSE 'paired' END AS state FROM calls c LEFT JOIN results r USING (user_id, k)""")
def tool_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with its first result, or a made-up error; results without a call and second results go."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    first = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("user_id", "k").agg(F.min("event_id").alias(name))
    both = first("click", "call").join(first("purchase", "result"), ["user_id", "k"], "left")
    return both.withColumn("state", F.when(F.col("result").isNull(), "synthetic error").otherwise("paired"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts::DATE + 1 WHEN 1 THEN ts::DATE + 3 WHEN 2 THEN ts::DATE + 7 WHEN 3 THEN last_day(ts::DATE) ELSE NULL END AS due FROM events""")
def temporal_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlode.functions.time import resolve_hint

    hint = F.element_at(F.array(*map(F.lit, ("due tomorrow", "in 3 days", "next week", "end of month", "some day"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", resolve_hint(hint, F.to_date("ts")).alias("due"))


@query("""SELECT doc_id, regexp_replace(text, '\\b(der|the|and)\\b', '**\\1**', 'gi') AS marked FROM documents""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words end at ASCII characters, as in the SQL, whatever the Java version takes for \b
    marked = F.regexp_replace("text", "(?i)(?<![A-Za-z0-9_])(der|the|and)(?![A-Za-z0-9_])", "**$1**")
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("marked"))

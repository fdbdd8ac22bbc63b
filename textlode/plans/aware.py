"""Mentions of known terms, what they connect, and notes for conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators import awareness, terms
from textlode.plans.extraction import TERM_MENTIONS_SQL, held_terms, known_terms
from textlode.plans.registry import query
from textlode.sources.shared import durable, stored
from textlode.sources.tables import AS_OF, table

NOW = f"TIMESTAMP '{AS_OF}'"
MENTION_ROWS_SQL = f"""{TERM_MENTIONS_SQL}, mentions AS MATERIALIZED (SELECT doc_id AS id, term AS entity, 'doc ' || (doc_id // 2) AS source, {NOW} - to_days((doc_id % 200)::INTEGER) AS created_at,
  list_sort(list(term) OVER (PARTITION BY doc_id)) AS terms FROM held)"""


def mention_rows(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Mentions: two neighbouring documents are one source, and a document is as many days old as its id tells.

    With ``once`` texts are read now, and their terms are stored as a row a text: each mention's row would hold all of them again.
    """
    held = held_terms(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    held = stored(held) if once else held
    created = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("doc_id") % 200).cast("int"))
    source = F.concat(F.lit("doc "), F.floor(F.col("doc_id") / 2).cast("string"))
    return held.select(F.col("doc_id").alias("id"), F.explode("terms").alias("entity"), source.alias("source"), created.alias("created_at"), "terms")


@query(f"WITH {TERM_MENTIONS_SQL} SELECT doc_id, term FROM held")
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts name which of some thousand known terms."""
    return held_terms(spark, sf_dir)


PAIRS_SQL = f"""pairs AS (SELECT b.entity, a.id AS id_a, a.source AS source_a, a.terms AS terms_a, b.id AS id_b, b.source AS source_b, b.created_at AS created_at_b, b.terms AS terms_b
  FROM mentions a JOIN mentions b ON a.entity = b.entity AND a.id < b.id AND a.source <> b.source
  WHERE a.created_at > {NOW} - INTERVAL 90 DAY AND b.created_at > {NOW} - INTERVAL 90 DAY)"""


@query(f"""WITH {MENTION_ROWS_SQL}, {PAIRS_SQL}
SELECT entity, row_number() OVER w AS place, id_a, source_a, id_b, source_b FROM pairs WINDOW w AS (PARTITION BY entity ORDER BY created_at_b DESC, id_b DESC, id_a DESC) QUALIFY place <= 3""")
def entity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three pairs of mentions of each term in different sources within 90 days."""
    since = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(90))
    return awareness.mismatches(durable(mention_rows(spark, sf_dir)), 3, since).select("entity", "place", "id_a", "source_a", "id_b", "source_b")


CONNECTIONS_SQL = """sources AS (SELECT DISTINCT entity, source FROM mentions),
connected AS (SELECT x.entity AS a, y.entity AS b, count(*) AS sources, min(x.source) AS first_source FROM sources x JOIN sources y ON x.source = y.source AND x.entity < y.entity GROUP BY ALL)"""


@query(f"WITH {MENTION_ROWS_SQL}, {CONNECTIONS_SQL} SELECT * FROM connected ORDER BY sources DESC, a, b LIMIT 100")
def entity_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred pairs of terms that share most sources."""
    return awareness.connections(mention_rows(spark, sf_dir)).orderBy(F.desc("sources"), "a", "b").limit(100)


ENTITIES_SQL = "seen AS (SELECT entity, count(*) AS mentions, max(created_at) AS last_seen FROM mentions GROUP BY entity)"


@query(f"""WITH {MENTION_ROWS_SQL}, {ENTITIES_SQL}, ranked AS (SELECT entity, id, source, created_at, row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, id DESC) AS place FROM mentions)
SELECT s.entity, s.mentions, s.last_seen, r.place, r.source, r.created_at FROM seen s JOIN ranked r ON r.entity = s.entity AND r.place <= 50""")
def entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's mentions: how many, and the newest fifty."""
    from pyspark.sql import Window

    m = durable(mention_rows(spark, sf_dir))
    newest = Window.partitionBy("entity").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = m.withColumn("place", F.row_number().over(newest)).filter("place <= 50").select(F.col("entity").alias("of"), "place", "source", "created_at")
    return awareness.entities(m).join(ranked, F.col("entity") == F.col("of")).drop("of")


def named_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and entity: known terms in the last three turns of a conversation and in eight words of the benchmark item that its id tells; null where there are none."""
    c, items = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark")
    last = c.groupBy("conv_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "text")))), 1, 3).alias("t"))
    front = items.select(F.col("item_id").alias("of"), F.array_join(F.slice(F.split(F.lower("text"), "[^\\p{L}]+"), 1, 8), " ").alias("front"))
    last = last.join(front, F.col("conv_id") % 50 == F.col("of"), "left")
    said = last.select(F.col("conv_id").alias("key"), F.concat_ws(" ", F.transform(F.reverse("t"), lambda t: t["text"]), "front").alias("text"))
    found = terms.find(said, known_terms(spark, sf_dir), "key").filter("bounded").select("key", F.col("term").alias("entity"))
    return found.unionByName(said.select("key").join(found.select("key").distinct(), "key", "left_anti").withColumn("entity", F.lit(None).cast("string")))


NOTES_SQL = f"""WITH {MENTION_ROWS_SQL}, {PAIRS_SQL}, {CONNECTIONS_SQL}, {ENTITIES_SQL},
recent AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id),
said AS MATERIALIZED (SELECT conv_id AS key, lower(concat_ws(' ', r.text, array_to_string(regexp_split_to_array(lower(b.text), '[^\\p{{L}}]+')[1:8], ' '))) AS low FROM recent r LEFT JOIN benchmark b ON b.item_id = r.conv_id % 50),
named AS MATERIALIZED (SELECT key, term AS entity FROM said JOIN known ON contains(low, term) AND regexp_matches(low, '\\b' || term || '\\b')),
matched AS (SELECT key, n.entity, mentions, last_seen FROM named n JOIN seen s ON s.entity = n.entity WHERE mentions >= 2),
others AS (SELECT s.key, n.entity FROM said s LEFT JOIN named n ON n.key = s.key WHERE s.key NOT IN (SELECT key FROM matched)),
both_ways AS (SELECT a, b, sources FROM connected UNION ALL SELECT b, a, sources FROM connected),
near AS (SELECT o.key, w.b AS entity, s.mentions, row_number() OVER (PARTITION BY o.key ORDER BY sum(w.sources) DESC, s.mentions DESC, w.b) AS place
  FROM others o JOIN both_ways w ON w.a = o.entity JOIN seen s ON s.entity = w.b AND s.mentions >= 2 GROUP BY o.key, w.b, s.mentions QUALIFY place <= 3),
top AS (SELECT entity, mentions, row_number() OVER (ORDER BY mentions DESC, entity) AS place FROM seen WHERE mentions >= 2 QUALIFY place <= 3),
background AS (SELECT * FROM near UNION ALL SELECT key, entity, mentions, place FROM (SELECT DISTINCT key FROM others WHERE key NOT IN (SELECT key FROM near)), top),
told AS (SELECT m.key, p.*, row_number() OVER (PARTITION BY m.key ORDER BY created_at_b DESC, id_b DESC, id_a DESC, p.entity) AS n,
  list_filter(terms_a, lambda t: NOT list_contains(terms_b, t)) AS only_a, list_filter(terms_b, lambda t: NOT list_contains(terms_a, t)) AS only_b FROM matched m JOIN pairs p ON p.entity = m.entity QUALIFY n <= 3),
old AS (SELECT key, entity, last_seen, date_diff('day', last_seen, {NOW}) AS days, row_number() OVER (PARTITION BY key ORDER BY date_diff('day', last_seen, {NOW}) DESC, entity) AS n
  FROM matched WHERE date_diff('day', last_seen, {NOW}) >= 30 QUALIFY n <= 3),
tied AS (SELECT x.key, c.*, row_number() OVER (PARTITION BY x.key ORDER BY sources DESC, a, b) AS n FROM matched x JOIN connected c ON c.a = x.entity JOIN matched y ON y.key = x.key AND y.entity = c.b QUALIFY n <= 3),
lines AS (
  SELECT key, 0 AS part, place, 'proactive' AS kind, 'Background: "' || entity || '" (' || mentions || ' mentions) — high-activity entity' AS line FROM background
  UNION ALL SELECT key, 1, n, 'mismatch', 'Possible mismatch: "' || entity || '" — ' || source_a || ' mentions [' || array_to_string(only_a, ', ') || '] but ' || source_b || ' mentions [' || array_to_string(only_b, ', ') || ']'
    FROM told WHERE len(only_a) > 0 OR len(only_b) > 0
  UNION ALL SELECT key, 2, n, 'staleness', 'Stale reference: "' || entity || '" last seen ' || days || ' days ago (' || strftime(last_seen, '%Y-%m-%d %H:%M:%S') || ')' FROM old
  UNION ALL SELECT key, 3, n, 'connection', 'Connection: "' || a || '" and "' || b || '" co-occur in ' || first_source FROM tied),
folded AS (SELECT key, list_reduce(list({{'kind': kind, 'line': line, 'cost': ceil(length(line) / 4.0)::BIGINT}} ORDER BY part, place),
  lambda s, x: CASE WHEN s.n < 3 AND x.cost <= s.room THEN {{'room': s.room - x.cost, 'n': s.n + 1, 'kinds': s.kinds || [x.kind], 'lines': s.lines || [x.line]}} ELSE s END,
  {{'room': 97::BIGINT, 'n': 0, 'kinds': []::VARCHAR[], 'lines': []::VARCHAR[]}}) AS s FROM lines GROUP BY key)
SELECT key, '[Awareness]' || chr(10) || array_to_string(s.lines, chr(10)) AS notes, array_to_string(s.kinds, ',') AS kinds, 100 - s.room AS tokens FROM folded WHERE s.n > 0"""


@query(NOTES_SQL)
def awareness_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes for each conversation by its last three turns."""
    return awareness.notes(durable(named_terms(spark, sf_dir)), durable(mention_rows(spark, sf_dir)), F.lit(AS_OF).cast("timestamp_ntz"))

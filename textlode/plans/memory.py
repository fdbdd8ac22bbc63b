"""Writes to the knowledge store: upserts in order, decay of all kinds, supersession, capsules of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators import memory
from textlode.plans.registry import query
from textlode.sources.tables import AS_OF, OBJECTS_SQL, objects, table

NOW = f"TIMESTAMP '{AS_OF}'"
CHANGES_SQL = """existing AS (SELECT event_id AS row, 'c' || event_id AS composite_id, CASE WHEN event_id % 9 <> 0 THEN event_type || '::' || user_id END AS canonical_key, 'claim' AS kind, user_id % 7 AS scope_id,
  CASE WHEN event_id % 6 = 0 THEN 'superseded' ELSE 'active' END AS status, round(value % 1, 4) AS confidence, props AS content FROM events WHERE ts < TIMESTAMP '2024-01-04' AND event_id % 5 = 0),
candidates AS (SELECT CASE WHEN event_id % 8 = 0 THEN 'c' || (event_id % 40) * 5 ELSE 'n' || event_id END AS composite_id, CASE WHEN event_id % 9 <> 1 THEN event_type || '::' || user_id END AS canonical_key, 'claim' AS kind,
  user_id % 7 AS scope_id, 'active' AS status, round(value % 1, 4) AS confidence, props AS content, event_id AS arrived, event_id % 13 = 0 AS supersedes, event_id % 17 = 0 AS violates FROM events WHERE ts >= TIMESTAMP '2024-01-04')"""


@query(f"""WITH {CHANGES_SQL}, by_key AS (SELECT scope_id, kind, canonical_key, min(row) AS row FROM existing WHERE canonical_key IS NOT NULL AND status <> 'superseded' GROUP BY ALL),
met AS (SELECT c.*, coalesce(e.row, k.row) AS row FROM candidates c LEFT JOIN existing e ON e.composite_id = c.composite_id LEFT JOIN by_key k ON k.scope_id = c.scope_id AND k.kind = c.kind AND k.canonical_key = c.canonical_key),
named AS (SELECT *, CASE WHEN row IS NOT NULL THEN 'row:' || row WHEN canonical_key IS NOT NULL THEN 'key:' || scope_id || ':' || canonical_key ELSE 'id:' || composite_id END AS identity FROM met),
folded AS (SELECT identity, any_value(row) AS row, arg_max({{'composite_id': composite_id, 'canonical_key': canonical_key, 'kind': kind, 'scope_id': scope_id, 'status': CASE WHEN violates THEN 'needs_confirmation' ELSE status END, 'content': content}}, arrived) AS last,
  count(*) AS updates, list({{'x': confidence, 'r': supersedes}} ORDER BY arrived) AS xs FROM named GROUP BY identity),
blended AS (SELECT f.*, list_reduce(xs, lambda c, y: CASE WHEN c.x IS NULL OR y.r THEN {{'x': y.x, 'r': false}} ELSE {{'x': y.x * 0.7::DOUBLE + c.x * 0.3::DOUBLE, 'r': false}} END, {{'x': e.confidence, 'r': false}}) AS c FROM folded f LEFT JOIN existing e ON e.row = f.row)
SELECT row, last.composite_id AS composite_id, last.canonical_key AS canonical_key, last.kind AS kind, last.scope_id AS scope_id, last.status AS status, round(c.x, 9) AS confidence, last.content AS content, updates, row IS NULL AS is_new FROM blended
UNION ALL SELECT row, composite_id, canonical_key, kind, scope_id, status, round(confidence, 9), content, 0, false FROM existing WHERE row NOT IN (SELECT row FROM folded WHERE row IS NOT NULL)""")
def upserts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events upsert into what earlier ones left, one after the other for each key."""
    e = table(spark, sf_dir, "events")
    n, cut = F.col("event_id"), F.lit("2024-01-04 00:00:00").cast("timestamp_ntz")
    key = F.concat("event_type", F.lit("::"), F.col("user_id").cast("string"))
    shared = [F.lit("claim").alias("kind"), (F.col("user_id") % 7).alias("scope_id"), F.round(F.col("value") % 1, 4).alias("confidence"), F.col("props").alias("content")]
    existing = e.filter((F.col("ts") < cut) & (n % 5 == 0)).select(
        n.alias("row"), F.concat(F.lit("c"), n.cast("string")).alias("composite_id"), F.when(n % 9 != 0, key).alias("canonical_key"), F.when(n % 6 == 0, "superseded").otherwise("active").alias("status"), *shared
    )
    again = F.concat(F.lit("c"), ((n % 40) * 5).cast("string"))
    candidates = e.filter(F.col("ts") >= cut).select(
        F.when(n % 8 == 0, again).otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("composite_id"), F.when(n % 9 != 1, key).alias("canonical_key"), F.lit("active").alias("status"), *shared,
        n.alias("arrived"), (n % 13 == 0).alias("supersedes"), (n % 17 == 0).alias("violates"),
    )
    return memory.upserted(existing, candidates).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {OBJECTS_SQL}, worked AS (SELECT DISTINCT user_id % 7 AS scope_id, event_type AS tool FROM events WHERE event_id % 101 = 0 AND ts > {NOW} - to_seconds(90 * 86400 * 0.1)),
rows AS (SELECT o.*, id % 4 AS successes, w.tool IS NOT NULL AND kind = 'anti_runbook' AND confidence > 0.3 AS relieved FROM objects o LEFT JOIN worked w ON w.scope_id = o.scope_id AND w.tool = o.event_type
  WHERE status = 'active' AND kind IN ('anti_runbook', 'runbook', 'loop', 'relation')),
steps AS (SELECT *, kind = 'runbook' AND failures / (successes + failures) > 0.5 AND created_at < {NOW} - to_seconds(90 * 86400 * 0.1) AS failing,
  CASE WHEN relieved THEN confidence * 0.7::DOUBLE WHEN kind = 'anti_runbook' AND confidence > 0.2 AND created_at < {NOW} - to_seconds(90 * 86400 * 0.1) THEN confidence * 0.8::DOUBLE ELSE confidence END AS c FROM rows)
SELECT id, kind, round(CASE WHEN failing THEN c * 0.5::DOUBLE ELSE c END, 9) AS confidence, CASE WHEN CASE kind WHEN 'anti_runbook' THEN c <= 0.2 WHEN 'runbook' THEN NOT failing AND created_at < {NOW} - to_seconds(180 * 86400 * 0.1)
  WHEN 'loop' THEN created_at < {NOW} - to_seconds(3 * 86400 * 0.1) ELSE created_at < {NOW} - to_seconds(180 * 86400 * 0.1) END THEN 'stale' ELSE 'active' END AS status FROM steps""")
def decayed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of decay over all kinds, ages at a tenth of their days."""
    o = objects(spark, sf_dir).withColumn("successes", F.col("id") % 4).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    worked = table(spark, sf_dir, "events").filter("event_id % 101 = 0").select((F.col("user_id") % 7).alias("scope_id"), F.col("event_type").alias("tool"), F.col("ts").alias("at"))
    found = memory.decayed(o, worked, F.lit(AS_OF).cast("timestamp_ntz"), 0.1)
    return found.withColumn("confidence", F.round("confidence", 9))


@query("""WITH v AS (SELECT user_id, event_type, event_id, row_number() OVER w AS n, lead(event_id) OVER w AS next, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS first,
  last_value(event_id) OVER (PARTITION BY user_id, event_type) AS unused, count(*) OVER (PARTITION BY user_id, event_type) AS size FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
ends AS (SELECT user_id, event_type, max_by(event_id, n) AS head FROM v GROUP BY ALL)
SELECT event_id AS node, CASE WHEN user_id % 50 <> 7 THEN head END AS head, CASE WHEN user_id % 50 <> 7 THEN size - n END AS steps, user_id % 50 = 7 AS cyclic FROM v JOIN ends USING (user_id, event_type) WHERE next IS NOT NULL OR user_id % 50 = 7""")
def supersession_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event of a user and type was superseded by in the end; some users' last events lead back to their first."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    first = F.first("event_id").over(by)
    after = F.lead("event_id").over(by)
    edges = e.select(F.col("event_id").alias("node"), F.when(after.isNotNull(), after).when(F.col("user_id") % 50 == 7, first).alias("next"))
    return memory.heads(edges)


CAPSULE_SQL = f"""{OBJECTS_SQL}, conflicts AS (SELECT id, scope_id, id::VARCHAR AS a, (id + 8)::VARCHAR AS b, CASE WHEN id % 3 = 0 THEN 'needs_confirmation' ELSE 'active' END AS status, confidence, created_at FROM objects WHERE kind = 'claim' AND id % 64 = 0),
deltas AS (SELECT id, scope_id, subject AS entity, CASE WHEN id % 20 <> 3 THEN event_type END AS old, object AS new, created_at FROM objects WHERE id % 10 = 3)"""


@query(f"""WITH {CAPSULE_SQL}, contested AS (SELECT a AS named FROM conflicts UNION SELECT b FROM conflicts),
open AS (SELECT o.*, CASE WHEN named IS NOT NULL THEN ' [CONTESTED]' WHEN confidence >= 0.9 THEN ' [FIRM]' WHEN confidence < 0.5 THEN ' [PROVISIONAL]' ELSE '' END AS label, greatest(0, date_diff('day', created_at, {NOW})) AS days
  FROM objects o LEFT JOIN contested ON named = id::VARCHAR WHERE status IN ('active', 'needs_confirmation')),
made AS (SELECT scope_id, 'claim' AS kind, 4 AS o, id, confidence, created_at, '[claim] ' || subject || ' ' || predicate || ': ' || object || label AS line,
    confidence * least(1.0, 1 / 3.0::DOUBLE) * CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.8 WHEN days <= 90 THEN 0.5 ELSE 0.3 END::DOUBLE AS score FROM open WHERE kind = 'claim'
  UNION ALL SELECT scope_id, kind, 3, id, confidence, created_at, '[decision] ' || subject || ': ' || content || label, 0.9 FROM open WHERE kind = 'decision'
  UNION ALL SELECT scope_id, kind, 5, id, confidence, created_at, '[loop] ' || content, 0.3::DOUBLE + least(10, priority) / 10 * 0.7::DOUBLE FROM open WHERE kind = 'loop'
  UNION ALL SELECT scope_id, kind, 1, id, confidence, created_at, '[INVARIANT: STRICT/' || severity || '] ' || content, 1.0 FROM open WHERE kind = 'invariant'
  UNION ALL SELECT scope_id, kind, 0, id, confidence, created_at, '[anti-runbook] AVOID: ' || content || ' (' || event_type || ', ' || failures || ' failures)' || label, 0.95 FROM open WHERE kind = 'anti_runbook'
  UNION ALL SELECT scope_id, kind, 7, id, confidence, created_at, '[runbook] ' || event_type || ': ' || content || ' (0% success)' || label, confidence * 0.85::DOUBLE FROM open WHERE kind = 'runbook'
  UNION ALL SELECT scope_id, kind, 8, id, confidence, created_at, '[relation] ' || subject || ' ' || predicate || ' ' || object || label, confidence * 0.8::DOUBLE FROM open WHERE kind = 'relation'
  UNION ALL SELECT scope_id, 'conflict', 2, id, confidence, created_at, '[conflict] ' || a || ' vs ' || b || ' (' || CASE status WHEN 'active' THEN 'unresolved' ELSE status END || ')', 0.85 FROM conflicts
  UNION ALL SELECT scope_id, 'delta', 6, id, NULL, created_at, '[delta] ' || entity || ': ' || coalesce(old, '?') || ' → ' || new, 0.5 FROM deltas),
first AS (SELECT *, row_number() OVER (PARTITION BY scope_id, kind ORDER BY confidence DESC NULLS LAST, created_at DESC, id) AS place FROM made QUALIFY place <= CASE WHEN kind IN ('claim', 'relation') THEN 10 ELSE 5 END),
best AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY scope_id, trim(regexp_replace(line, '\\s*\\[(FIRM|CONTESTED|PROVISIONAL)\\]', '')) ORDER BY score DESC, o, place) = 1),
rated AS (SELECT *, ceil(length(line) / 4.0::DOUBLE)::BIGINT AS tokens FROM best WHERE score > 0),
folded AS (SELECT scope_id, list_reduce(list({{'o': o, 'rate': -round(score / greatest(1, tokens), 12), 'place': place, 'kind': kind, 'line': line, 'tokens': tokens}} ORDER BY round(score / greatest(1, tokens), 12) DESC, o, place), lambda s, x:
    CASE WHEN s.spent + x.tokens <= 190 THEN {{'spent': s.spent + x.tokens, 'kept': s.kept || [x]}} ELSE s END,
  {{'spent': 3::BIGINT, 'kept': []::STRUCT(o INTEGER, rate DOUBLE, place BIGINT, kind VARCHAR, line VARCHAR, tokens BIGINT)[]}}) AS s FROM rated GROUP BY scope_id)
SELECT scope_id, '[Evidence]' || chr(10) || (SELECT string_agg(x.line, chr(10) ORDER BY x.o, x.rate, x.place) FROM unnest(s.kept) AS t(x)) AS text,
  (SELECT string_agg(x.kind, ',' ORDER BY x.o, x.rate, x.place) FROM unnest(s.kept) AS t(x)) AS kinds, s.spent AS tokens FROM folded WHERE len(s.kept) > 0""")
def context_capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capsules of all kinds for each scope within the standard budget."""
    o = objects(spark, sf_dir)
    n = F.col("id")
    conflicts = o.filter((F.col("kind") == "claim") & (n % 64 == 0)).select(
        "id", "scope_id", n.cast("string").alias("a"), (n + 8).cast("string").alias("b"), F.when(n % 3 == 0, "needs_confirmation").otherwise("active").alias("status"), "confidence", "created_at"
    )
    deltas = o.filter(n % 10 == 3).select("id", "scope_id", F.col("subject").alias("entity"), F.when(n % 20 != 3, F.col("event_type")).alias("old"), F.col("object").alias("new"), "created_at")
    return memory.capsules(o, conflicts, deltas, F.lit(AS_OF).cast("timestamp_ntz"))

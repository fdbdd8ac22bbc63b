"""The knowledge store: reads, reconciliation, decay, promotion, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import reconcile as R
from textlode.plans.registry import query
from textlode.sources.tables import ATTEMPTS_SQL, CLAIMS_SQL, attempts, claims, table

CUT = "2024-01-20"
AGE = "date_diff('day', created_at::DATE, DATE '2024-02-01')"
SPLIT_SQL = f"""{CLAIMS_SQL}, existing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY confidence DESC, id DESC) AS n
  FROM claims WHERE created_at < TIMESTAMP '{CUT}') WHERE n = 1),
candidates AS (SELECT * FROM claims WHERE created_at >= TIMESTAMP '{CUT}')"""


def age_days() -> F.Column:
    return F.datediff(F.lit("2024-02-01").cast("date"), F.col("created_at").cast("date"))


@query(f"""WITH {SPLIT_SQL}, judged AS (SELECT c.id, e.id AS existing_id, CASE WHEN e.id IS NULL THEN 'insert'
  WHEN c.provisional AND NOT e.provisional THEN 'evidence' WHEN c.confidence - e.confidence > 0.001 THEN 'supersede'
  WHEN abs(c.confidence - e.confidence) <= 0.001 THEN CASE WHEN c.object = e.object THEN 'evidence' ELSE 'supersede' END ELSE 'evidence' END AS action,
  CASE WHEN e.id IS NOT NULL AND NOT (c.provisional AND NOT e.provisional) AND c.confidence >= 0.3 AND c.object <> e.object
    AND NOT contains(c.object, e.object) AND NOT contains(e.object, c.object) THEN true ELSE false END AS conflict
  FROM candidates c LEFT JOIN existing e USING (canonical_key))
SELECT id, existing_id, action FROM judged UNION ALL
SELECT id, existing_id, CASE WHEN action = 'supersede' THEN 'conflict:active' ELSE 'conflict:needs_confirmation' END FROM judged WHERE conflict""")
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    existing = c.filter(f"created_at < TIMESTAMP_NTZ '{CUT} 00:00:00'")
    return R.reconcile(existing, c.filter(f"created_at >= TIMESTAMP_NTZ '{CUT} 00:00:00'")).select("id", "existing_id", "action")


@query(f"""WITH {SPLIT_SQL}, judged AS (SELECT c.id, e.id AS existing_id, c.confidence, c.object AS o, e.object AS eo, c.provisional AND NOT e.provisional AS weak,
  c.id % 5 = 0 AND c.scope_id = e.scope_id AND NOT (c.provisional AND NOT e.provisional) AND c.confidence >= 0.3 AS fixes, c.confidence - e.confidence AS gap
  FROM candidates c LEFT JOIN existing e USING (canonical_key)),
acted AS (SELECT *, CASE WHEN existing_id IS NULL THEN 'insert' WHEN weak THEN 'evidence' WHEN fixes THEN 'supersede' WHEN gap > 0.001 THEN 'supersede'
  WHEN abs(gap) <= 0.001 THEN CASE WHEN o = eo THEN 'evidence' ELSE 'supersede' END ELSE 'evidence' END AS action,
  round(CASE WHEN fixes THEN least(1.0::DOUBLE, confidence + 0.15::DOUBLE) ELSE confidence END, 6) AS gained FROM judged)
SELECT id, existing_id, action, gained AS confidence FROM acted
UNION ALL SELECT id, existing_id, CASE WHEN action = 'supersede' THEN 'conflict:active' ELSE 'conflict:needs_confirmation' END, gained FROM acted
WHERE existing_id IS NOT NULL AND NOT weak AND confidence >= 0.3 AND o <> eo AND NOT contains(o, eo) AND NOT contains(eo, o)""")
def reconcile_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``reconcile_actions``, where every fifth claim corrects: within its scope it supersedes whatever the confidences."""
    c = claims(spark, sf_dir)
    existing = c.filter(f"created_at < TIMESTAMP_NTZ '{CUT} 00:00:00'")
    candidates = c.filter(f"created_at >= TIMESTAMP_NTZ '{CUT} 00:00:00'").withColumn("corrects", F.col("id") % 5 == 0)
    return R.reconcile(existing, candidates).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {CLAIMS_SQL}, net AS (SELECT canonical_key, min(confidence) AS base,
  least(1, sum(CASE WHEN object::INT % 3 > 0 THEN 0.1 ELSE 0 END)) - least(1, sum(CASE WHEN object::INT % 3 = 0 THEN 0.1 ELSE 0 END)) AS net FROM claims GROUP BY canonical_key)
SELECT canonical_key, round(CASE WHEN net > 0 THEN least(1, base + net * (1 - base) * 0.7::DOUBLE) WHEN net < 0 THEN greatest(0.05, base * (1 + net)) ELSE base END, 6) AS confidence FROM net""")
def belief_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    supports = F.col("object").cast("int") % 3 > 0
    c = claims(spark, sf_dir).groupBy("canonical_key").agg(
        F.min("confidence").alias("base"), F.sum(F.when(supports, 0.1).otherwise(0.0)).alias("pro"), F.sum(F.when(~supports, 0.1).otherwise(0.0)).alias("con")
    )
    return c.select("canonical_key", F.round(R.believe(F.col("base"), F.col("pro"), F.col("con")), 6).alias("confidence"))


@query(f"""WITH {CLAIMS_SQL}, pairs AS (SELECT a.id AS a, b.id AS b, a.confidence AS ca, b.confidence AS cb FROM claims a JOIN claims b
  ON a.canonical_key = b.canonical_key AND a.scope_id = b.scope_id AND a.id < b.id AND a.object <> b.object AND a.confidence > 0.85)
SELECT a, b, CASE WHEN ca > cb THEN b ELSE a END AS loser FROM pairs WHERE (greatest(ca, cb) > 0.85 OR least(ca, cb) < 0.1) AND abs(ca - cb) >= 0.3""")
def conflict_autoresolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    side = lambda n: c.select("canonical_key", "scope_id", F.col("id").alias(n), F.col("confidence").alias(f"c{n}"), F.col("object").alias(f"o{n}"))
    pairs = side("a").filter("ca > 0.85").join(side("b"), ["canonical_key", "scope_id"]).filter("a < b AND oa <> ob")
    clear = "(greatest(ca, cb) > 0.85 OR least(ca, cb) < 0.1) AND abs(ca - cb) >= 0.3"
    return pairs.filter(clear).select("a", "b", F.when(F.col("ca") > F.col("cb"), F.col("b")).otherwise(F.col("a")).alias("loser"))


@query(f"""WITH {CLAIMS_SQL} SELECT id, first_value(id) OVER (PARTITION BY scope_id, canonical_key ORDER BY confidence DESC, id DESC) AS keeper FROM claims
QUALIFY row_number() OVER (PARTITION BY scope_id, canonical_key ORDER BY confidence DESC, id DESC) > 1""")
def dedup_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a stronger one of their key supersedes: the keeper is aggregated, then joined, so a hot key is not one task's."""
    c = claims(spark, sf_dir)
    keeper = c.groupBy("scope_id", "canonical_key").agg(F.max_by("id", F.struct("confidence", "id")).alias("keeper"))
    return c.join(keeper, ["scope_id", "canonical_key"]).filter("id <> keeper").select("id", "keeper")


@query(f"""WITH {ATTEMPTS_SQL}, last AS (SELECT *, row_number() OVER (PARTITION BY scope_id, tool ORDER BY created_at DESC, id DESC) AS n FROM attempts)
SELECT scope_id, tool, CASE WHEN bool_and(ok) THEN 'runbook' ELSE 'anti_runbook' END AS kind FROM last WHERE n <= 3 GROUP BY ALL
HAVING count(*) = 3 AND (bool_and(ok) OR NOT bool_or(ok))""")
def runbook_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools whose last three attempts all succeeded, or all failed."""
    n = F.row_number().over(Window.partitionBy("scope_id", "tool").orderBy(F.desc("created_at"), F.desc("id")))
    last = attempts(spark, sf_dir).withColumn("n", n).filter("n <= 3").groupBy("scope_id", "tool")
    seen = last.agg(F.count("*").alias("n"), F.bool_and("ok").alias("all_ok"), F.bool_or("ok").alias("any_ok")).filter("n = 3 AND (all_ok OR NOT any_ok)")
    return seen.select("scope_id", "tool", F.when(F.col("all_ok"), "runbook").otherwise("anti_runbook").alias("kind"))


@query(f"""WITH {CLAIMS_SQL}, recent AS (SELECT *, {AGE} AS days FROM claims ORDER BY created_at DESC, id DESC LIMIT 300),
scored AS (SELECT id, round(0.6::DOUBLE * confidence + 0.4::DOUBLE * CASE WHEN days < 0 THEN 1.0 ELSE greatest(0.1, pow(0.5::DOUBLE, days / 30.0::DOUBLE)) END, 6) AS score FROM recent)
SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 100""")
def relevance_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most relevant of the most recent: both limits count."""
    recent = claims(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(300)
    score = F.round(0.6 * F.col("confidence") + 0.4 * T.freshness(age_days()), 6)
    return recent.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(100)


@query(f"""WITH {CLAIMS_SQL}, g AS (SELECT canonical_key, max(confidence) AS base, count(*) AS mentions, min({AGE}) AS days FROM claims GROUP BY canonical_key)
SELECT canonical_key, round(base * least(1.0, mentions / 3.0::DOUBLE) * CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.8 WHEN days <= 90 THEN 0.5 ELSE 0.3 END, 6) AS confidence,
  CASE WHEN base >= 0.9 THEN 'FIRM' WHEN base < 0.5 THEN 'PROVISIONAL' ELSE '' END AS label FROM g""")
def effective_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = claims(spark, sf_dir).groupBy("canonical_key").agg(F.max("confidence").alias("base"), F.count("*").alias("mentions"), F.min(age_days()).alias("days"))
    found = T.effective_confidence(F.col("base"), F.col("mentions"), F.col("days"))
    return g.select("canonical_key", F.round(found, 6).alias("confidence"), T.epistemic_label(F.col("base"), F.lit(False)).alias("label"))


@query(f"""WITH {CLAIMS_SQL} SELECT id, CASE WHEN confidence < 0.1 AND {AGE} > 20 THEN 'archived' WHEN provisional AND {AGE} > 10 THEN 'stale' ELSE 'active' END AS status FROM claims""")
def decay_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules, of which the first that holds decides."""
    status = F.when((F.col("confidence") < 0.1) & (age_days() > 20), "archived").when(F.col("provisional") & (age_days() > 10), "stale").otherwise("active")
    return claims(spark, sf_dir).select("id", status.alias("status"))


@query(f"""WITH {CLAIMS_SQL}, b AS (SELECT canonical_key, max(confidence) AS c FROM claims WHERE scope_id = 1 GROUP BY 1),
s AS (SELECT canonical_key, max(confidence) AS c FROM claims WHERE scope_id = 0 GROUP BY 1)
SELECT b.canonical_key, CASE WHEN s.c IS NULL THEN 'move' WHEN b.c > s.c THEN 'replace' ELSE 'drop' END AS action FROM b LEFT JOIN s USING (canonical_key)""")
def promote_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch's claims against the shared ones: the more confident stays, new ones move."""
    best = lambda scope: claims(spark, sf_dir).filter(f"scope_id = {scope}").groupBy("canonical_key").agg(F.max("confidence").alias(f"c{scope}"))
    both = best(1).join(best(0), "canonical_key", "left")
    return both.select("canonical_key", F.when(F.col("c0").isNull(), "move").when(F.col("c1") > F.col("c0"), "replace").otherwise("drop").alias("action"))


@query("""WITH v AS (SELECT user_id, event_type, event_id, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS until FROM events)
SELECT user_id, event_type, event_id FROM v WHERE ts <= TIMESTAMP '2024-01-15' AND (until IS NULL OR until > TIMESTAMP '2024-01-15')""")
def snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was current at a time: the last version before it, by an aggregate instead of a window over all history."""
    e = table(spark, sf_dir, "events").filter("ts <= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events QUALIFY ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a span with their number in their scope's whole history."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    span = "ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"
    return table(spark, sf_dir, "events").withColumn("seq", seq.cast("long")).filter(span).select("event_id", "seq")


@query("""SELECT user_id, string_agg(n || ' ' || event_type || CASE WHEN n = 1 THEN '' ELSE 's' END, ', ' ORDER BY event_type) AS briefing
FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY ALL) GROUP BY user_id""")
def session_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-25 00:00:00'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    phrase = F.concat(F.col("n").cast("string"), F.lit(" "), "event_type", F.when(F.col("n") == 1, "").otherwise("s"))
    parts = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", phrase.alias("phrase")))).alias("parts"))
    return parts.select("user_id", F.array_join(F.transform("parts", lambda p: p["phrase"]), ", ").alias("briefing"))


@query(f"""WITH {CLAIMS_SQL} SELECT id, CASE WHEN confidence < 0.1 THEN 'low confidence' ELSE 'old' END AS reason FROM claims WHERE (confidence < 0.1 AND {AGE} > 5) OR {AGE} > 28""")
def archive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cold = claims(spark, sf_dir).filter(((F.col("confidence") < 0.1) & (age_days() > 5)) | (age_days() > 28))
    return cold.select("id", F.when(F.col("confidence") < 0.1, "low confidence").otherwise("old").alias("reason"))


@query(f"""WITH {CLAIMS_SQL} SELECT scope_id, id, confidence FROM claims QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY confidence DESC, id) <= 10""")
def top_claims_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("confidence"), "id"))
    return claims(spark, sf_dir).withColumn("n", n).filter("n <= 10").select("scope_id", "id", "confidence")


@query(f"""WITH {ATTEMPTS_SQL} SELECT tool, scope_id, max(created_at) AS last_seen FROM attempts GROUP BY ALL HAVING max(created_at) < TIMESTAMP '2024-01-30 12:00:00'""")
def stale_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).groupBy("tool", "scope_id").agg(F.max("created_at").alias("last_seen"))
    return a.filter("last_seen < TIMESTAMP_NTZ '2024-01-30 12:00:00'")


@query(f"""WITH {CLAIMS_SQL}, priced AS (SELECT scope_id, id, confidence AS score, ceil(length(concat_ws(' ', canonical_key, object)) / 3.8::DOUBLE)::BIGINT AS tokens FROM claims),
folded AS (SELECT scope_id, list_reduce(list({{'id': id, 'score': score, 'tokens': tokens}} ORDER BY score / greatest(tokens, 1) DESC, id), lambda s, x:
    CASE WHEN x.tokens <= s.room THEN {{'room': s.room - x.tokens, 'kept': s.kept || [x]}} ELSE s END, {{'room': 120::BIGINT, 'kept': []::STRUCT(id BIGINT, score DOUBLE, tokens BIGINT)[]}}) AS s FROM priced GROUP BY scope_id)
SELECT scope_id, x.id, x.score, x.tokens FROM (SELECT scope_id, unnest(s.kept) AS x FROM folded)""")
def capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each scope packed into a token budget, best score a token first; what does not fit is skipped."""
    line = F.concat_ws(" ", "canonical_key", "object")
    return R.knapsack(claims(spark, sf_dir).select("scope_id", "id", F.col("confidence").alias("score"), T.estimate_tokens(line).alias("tokens")), "scope_id", 120)

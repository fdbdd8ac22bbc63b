"""Tables of a data folder, and stand-ins for the evidence store that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time at which "now" is taken: after the last event.
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool attempts: an event is an attempt of its user's scope with its type as the tool."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("scope_id"), F.col("event_type").alias("tool"),
        (F.col("value") >= 20).alias("ok"), "value", F.col("ts").alias("created_at"),
    )


ATTEMPTS_SQL = """attempts AS (SELECT event_id AS id, user_id % 7 AS scope_id, event_type AS tool, value >= 20 AS ok, value, ts AS created_at FROM events)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims: a user says of an event type that its value is the event's key."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("scope_id"),
        F.concat(F.lit("claim::"), F.col("event_type"), F.lit("::"), (F.col("user_id") % 50).cast("string")).alias("canonical_key"),
        F.get_json_object("props", "$.k").alias("object"), F.round(F.col("value") % 1, 4).alias("confidence"), F.col("ts").alias("created_at"),
        (F.col("event_id") % 11 == 0).alias("provisional"),
    )


CLAIMS_SQL = """claims AS (SELECT event_id AS id, user_id % 7 AS scope_id,
  'claim::' || event_type || '::' || (user_id % 50)::VARCHAR AS canonical_key, json_extract_string(props, '$.k') AS object,
  round(value % 1, 4) AS confidence, ts AS created_at, event_id % 11 = 0 AS provisional FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with token counts (a token is four characters)."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", "text", F.ceil(F.length("text") / 4.0).cast("long").alias("tokens"))


MESSAGES_SQL = """messages AS (SELECT conv_id, turn, role, text, ceil(length(text) / 4.0::DOUBLE)::BIGINT AS tokens FROM conversations)"""


#: Fixed values of the stand-in: kinds of knowledge, predicates and severities by the event's number.
KINDS = ("claim", "decision", "loop", "invariant", "runbook", "anti_runbook", "entity", "relation")
SAYS, SEVERITIES = ("is", "uses", "owns", "states"), ("critical", "error", "warning", "info")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge of every kind: an event speaks of a part (of the first 200), in the scope of its user."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    n = F.col("event_id")
    e = e.withColumn("part", n % 200).join(p.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("subject")), "part")
    e = e.select(
        n.alias("id"), (F.col("user_id") % 7).alias("scope_id"), pick(KINDS, n).alias("kind"), "subject", pick(SAYS, F.floor(n / 8)).alias("predicate"),
        F.concat(F.lit("u"), "user_id").alias("object"), "event_type", F.round(F.col("value") % 1, 4).alias("confidence"),
        F.when(n % 17 == 0, "superseded").otherwise("active").alias("status"), F.col("ts").alias("created_at"), (1 + n % 9).alias("priority"),
        pick(SEVERITIES, F.floor(n / 8)).alias("severity"), (1 + n % 5).alias("failures"),
    )
    s, t = F.col("subject"), F.col("event_type")
    said = {
        "claim": F.concat_ws(" ", s, "predicate", "object"), "decision": F.concat(F.lit("use "), s, F.lit(" for "), t), "loop": F.concat(F.lit("check "), s, F.lit(" after "), t),
        "invariant": F.concat(F.lit("never "), t, F.lit(" the "), s), "runbook": F.concat(F.lit("run "), t, F.lit(" on "), s),
        "anti_runbook": F.concat(t, F.lit(" of "), s, F.lit(" fails")), "entity": s, "relation": F.concat_ws(" ", s, "predicate", "object"),
    }
    content = F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in said.items()))
    return e.withColumn("content", content)


def listed_sql(values: tuple[str, ...], n: str) -> str:
    return f"([{', '.join(f"'{v}'" for v in values)}])[1 + ({n}) % {len(values)}]"


OBJECTS_SQL = f"""objects AS (SELECT *, CASE kind WHEN 'claim' THEN subject || ' ' || predicate || ' ' || object WHEN 'decision' THEN 'use ' || subject || ' for ' || event_type
  WHEN 'loop' THEN 'check ' || subject || ' after ' || event_type WHEN 'invariant' THEN 'never ' || event_type || ' the ' || subject WHEN 'runbook' THEN 'run ' || event_type || ' on ' || subject
  WHEN 'anti_runbook' THEN event_type || ' of ' || subject || ' fails' WHEN 'entity' THEN subject ELSE subject || ' ' || predicate || ' ' || object END AS content FROM (
  SELECT event_id AS id, user_id % 7 AS scope_id, {listed_sql(KINDS, 'event_id')} AS kind, p_name AS subject, {listed_sql(SAYS, 'event_id // 8')} AS predicate, 'u' || user_id AS object, event_type,
    round(value % 1, 4) AS confidence, CASE WHEN event_id % 17 = 0 THEN 'superseded' ELSE 'active' END AS status, ts AS created_at, 1 + event_id % 9 AS priority,
    {listed_sql(SEVERITIES, 'event_id // 8')} AS severity, 1 + event_id % 5 AS failures FROM events JOIN part ON p_partkey = event_id % 200))"""

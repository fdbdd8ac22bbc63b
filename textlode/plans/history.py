"""Conversation history: budgets, compaction, the summary graph, integrity, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.operators import graph, integrity
from textlode.operators.search import within_budget
from textlode.plans.registry import query
from textlode.sources.tables import MESSAGES_SQL, messages, table


@query(f"""WITH {MESSAGES_SQL} SELECT conv_id, turn, tokens, running FROM (SELECT *,
  sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM messages) WHERE running <= 120""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns of each conversation that fit the budget, up to the first that does not."""
    return within_budget(messages(spark, sf_dir), ["conv_id"], [F.desc("turn")], "tokens", 120).select("conv_id", "turn", "tokens", "running")


@query(f"""WITH {MESSAGES_SQL} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM messages) WHERE n <= 3""")
def fresh_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages(spark, sf_dir).withColumn("n", n).filter("n <= 3").select("conv_id", "turn")


@query(f"""WITH {MESSAGES_SQL}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM messages) WHERE n > 3),
islands AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM old WHERE role <> 'system'),
firsts AS (SELECT *, min(island) OVER (PARTITION BY conv_id) AS first_island FROM islands),
runs AS (SELECT *, sum(tokens) OVER w AS running, row_number() OVER w AS place FROM firsts WHERE island = first_island
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, running::BIGINT AS running FROM runs WHERE running <= 60 OR place = 1""")
def leaf_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest contiguous run before the fresh tail, within 60 tokens, one turn at least."""
    by = Window.partitionBy("conv_id")
    old = messages(spark, sf_dir).withColumn("n", F.row_number().over(by.orderBy(F.desc("turn")))).filter("n > 3 AND role <> 'system'")
    islands = old.withColumn("island", F.col("turn") - F.row_number().over(by.orderBy("turn")))
    first = islands.withColumn("first", F.min("island").over(by)).filter("island = first")
    return within_budget(first, ["conv_id"], [F.col("turn")], "tokens", 60, 1).select("conv_id", "turn", "running")


@query(f"""WITH {MESSAGES_SQL} SELECT conv_id, sum(tokens)::BIGINT AS tokens, sum(tokens) > floor(0.75::DOUBLE * 200) AS compact FROM messages GROUP BY conv_id""")
def compaction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = messages(spark, sf_dir).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))
    return total.withColumn("compact", F.col("tokens") > 150)


@query(f"""WITH {MESSAGES_SQL}, seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS occurrence FROM messages),
stored AS (SELECT conv_id, role, text, occurrence FROM seen WHERE turn < 3),
anchor AS (SELECT s.conv_id, max(s.turn) AS at FROM seen s JOIN stored USING (conv_id, role, text, occurrence) GROUP BY 1)
SELECT s.conv_id, s.turn FROM seen s JOIN anchor a ON a.conv_id = s.conv_id AND s.turn > a.at""")
def tail_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after the last one that is stored already; equal turns are told apart by their occurrence."""
    m = messages(spark, sf_dir)
    seen = m.withColumn("occurrence", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")))
    stored = seen.filter("turn < 3").select("conv_id", "role", "text", "occurrence")
    anchor = seen.join(stored, ["conv_id", "role", "text", "occurrence"], "left_semi").groupBy("conv_id").agg(F.max("turn").alias("at"))
    return seen.join(anchor, "conv_id").filter("turn > at").select("conv_id", "turn")


@query("""WITH turns AS (SELECT conv_id, turn, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations),
bad AS (SELECT DISTINCT conv_id, block FROM turns WHERE length(text) < 30)
SELECT conv_id, turn FROM turns ANTI JOIN bad USING (conv_id, block)""")
def heartbeat_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops whole exchanges, from a user's turn on, that hold an idle message."""
    c = table(spark, sf_dir, "conversations")
    block = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = c.withColumn("block", block)
    idle = turns.filter(F.length("text") < 30).select("conv_id", "block").distinct()
    return turns.join(idle, ["conv_id", "block"], "left_anti").select("conv_id", "turn")


def node_sql(depth: int, place: str) -> str:
    return f"lpad(conv_id::VARCHAR, 12, '0') || '.{depth}.' || lpad(({place})::VARCHAR, 10, '0')"


LEAF, MID, ROOT = node_sql(0, "turn // 2"), node_sql(1, "turn // 4"), node_sql(2, "0")
DAG_SQL = f"""{MESSAGES_SQL}, nodes AS (SELECT {LEAF} AS id, conv_id, 0 AS depth, sum(tokens)::BIGINT AS tokens FROM messages GROUP BY ALL
  UNION ALL SELECT {MID}, conv_id, 1, (sum(tokens) // 2)::BIGINT FROM messages GROUP BY ALL
  UNION ALL SELECT {ROOT}, conv_id, 2, (sum(tokens) // 4)::BIGINT FROM messages GROUP BY ALL),
edges AS (SELECT DISTINCT {MID} AS parent, {LEAF} AS child FROM messages UNION ALL SELECT DISTINCT {ROOT}, {MID} FROM messages)"""


def dag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A summary graph: two turns a leaf, two leaves a summary, one root a conversation. Ids name conversation, depth and place."""
    node = lambda depth, place: F.expr(f"format_string('%012d.{depth}.%010d', conv_id, {place})")
    m = messages(spark, sf_dir).withColumns({"leaf": node(0, "turn div 2"), "mid": node(1, "turn div 4"), "root": node(2, "0L")})
    level = lambda name, depth, share: m.groupBy(F.col(name).alias("id"), "conv_id").agg(F.lit(depth).alias("depth"), F.expr(f"sum(tokens) div {share}").alias("tokens"))
    nodes = level("leaf", 0, 1).unionByName(level("mid", 1, 2)).unionByName(level("root", 2, 4))
    edge = lambda a, b: m.select(F.col(a).alias("parent"), F.col(b).alias("child")).distinct()
    return nodes, edge("mid", "leaf").unionByName(edge("root", "mid"))


@query(f"""WITH RECURSIVE {DAG_SQL}, walk AS (SELECT id AS root, id AS node, 0 AS depth, id AS path FROM nodes WHERE depth = 2
  UNION ALL SELECT w.root, e.child, w.depth + 1, w.path || '/' || e.child FROM walk w JOIN edges e ON e.parent = w.node WHERE w.depth < 10)
SELECT root, node, depth, (SELECT count(*) FROM edges e WHERE e.parent = walk.node) AS children FROM walk""")
def summary_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = dag(spark, sf_dir)
    walk = graph.descend(nodes.filter("depth = 2").select("id"), edges, 10)
    children = edges.groupBy("parent").agg(F.count("*").alias("children"))
    return walk.join(children, walk["node"] == children["parent"], "left").select("root", "node", "depth", F.coalesce("children", F.lit(0)).alias("children"))


@query(f"""WITH RECURSIVE {DAG_SQL}, walk AS (SELECT id AS root, id AS node, id AS path FROM nodes WHERE depth = 2
  UNION ALL SELECT w.root, e.child, w.path || '/' || e.child FROM walk w JOIN edges e ON e.parent = w.node)
SELECT root, node, running FROM (SELECT root, node, sum(n.tokens) OVER (PARTITION BY root ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running
  FROM walk JOIN nodes n ON n.id = walk.node) WHERE running <= 150""")
def summary_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first expansion of each root until the token cap."""
    nodes, edges = dag(spark, sf_dir)
    walk = graph.descend(nodes.filter("depth = 2").select("id"), edges, 10).join(nodes.select(F.col("id").alias("node"), "tokens"), "node")
    return within_budget(walk, ["root"], [F.col("path")], "tokens", 150).select("root", "node", "running")


@query(f"""WITH {DAG_SQL} SELECT conv_id, sum(tokens)::BIGINT AS tokens, count(*) AS items FROM (SELECT conv_id, tokens FROM messages UNION ALL SELECT conv_id, tokens FROM nodes) GROUP BY conv_id""")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = dag(spark, sf_dir)
    every = messages(spark, sf_dir).select("conv_id", "tokens").unionByName(nodes.select("conv_id", "tokens"))
    return every.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))


@query(f"""WITH {DAG_SQL}, ordered AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM messages WHERE turn <> 2)
SELECT 'contiguous' AS rule, conv_id::VARCHAR AS item FROM ordered WHERE coalesce(prev + 1, 0) <> turn
UNION ALL SELECT 'lineage', id FROM nodes WHERE depth > 0 AND id NOT IN (SELECT parent FROM edges)
UNION ALL SELECT 'orphan', id FROM nodes WHERE depth < 2 AND id NOT IN (SELECT child FROM edges)
UNION ALL SELECT 'duplicate', conv_id::VARCHAR FROM messages GROUP BY conv_id, role, text HAVING count(*) > 1""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = dag(spark, sf_dir)
    m = messages(spark, sf_dir)
    return integrity.report({
        "contiguous": integrity.gaps(m.filter("turn <> 2"), "conv_id", "turn"),
        "lineage": integrity.without(nodes.filter("depth > 0"), "id", edges, "parent"),
        "orphan": integrity.without(nodes.filter("depth < 2"), "id", edges, "child"),
        "duplicate": integrity.duplicates(m, ["conv_id", "role", "text"], "conv_id"),
    })


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""SELECT time_bucket(INTERVAL 12 hours, ts) - k * INTERVAL 12 hours AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "24 hours", "12 hours")).agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").alias("start"), "n")


@query("""WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hours THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM gaps)
SELECT user_id, min(ts) AS start, count(*) AS n FROM runs GROUP BY user_id, session""")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type")
    return e.agg(F.min("event_id").alias("event_id"))

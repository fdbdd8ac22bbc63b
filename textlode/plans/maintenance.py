"""Maintenance of the summary graph: levels, roll-ups, checks, dissolving, transplanting, expansion, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.operators import lineage
from textlode.plans.history import DAG_SQL, LEAF, dag
from textlode.plans.registry import query
from textlode.sources.tables import messages

MARK = "[fallback summary]"
#: A store over the summary graph: roots stand in the context, and the last turn of odd conversations behind them.
STORE_SQL = f"""{DAG_SQL},
summaries AS (SELECT id AS summary_id, conv_id, CASE WHEN depth = 0 THEN 'leaf' ELSE 'condensed' END AS kind, depth, tokens, TIMESTAMP '2024-01-01' + to_hours(depth * 100 + (conv_id % 50)::INTEGER) AS created_at,
  'about ' || id || CASE WHEN right(id, 1) IN ('0', '3') AND conv_id % 3 = 0 THEN '{MARK}' ELSE '' END AS content FROM nodes),
parents AS (SELECT parent AS summary_id, child AS parent_id, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS ordinal FROM edges),
said AS (SELECT conv_id || ':' || turn AS message_id, conv_id, turn AS seq, tokens, TIMESTAMP '2024-01-01' + to_minutes(turn::INTEGER) AS created_at, {LEAF} AS leaf FROM messages),
sources AS (SELECT leaf AS summary_id, message_id, row_number() OVER (PARTITION BY leaf ORDER BY seq) - 1 AS ordinal FROM said),
context AS (SELECT conv_id, 0 AS ordinal, 'summary' AS item_type, NULL::VARCHAR AS message_id, summary_id FROM summaries WHERE depth = 2
  UNION ALL SELECT conv_id, 1, 'message', arg_max(message_id, seq), NULL FROM said WHERE conv_id % 2 = 1 GROUP BY conv_id)"""


def store(spark: SparkSession, sf_dir: str) -> lineage.Store:
    nodes, edges = dag(spark, sf_dir)
    noon = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    marked = F.substring("id", -1, 1).isin("0", "3") & (F.col("conv_id") % 3 == 0)
    summaries = nodes.select(
        F.col("id").alias("summary_id"), "conv_id", F.when(F.col("depth") == 0, "leaf").otherwise("condensed").alias("kind"), "depth", "tokens",
        (noon + F.make_dt_interval(F.lit(0), (F.col("depth") * 100 + F.col("conv_id") % 50).cast("int"))).alias("created_at"),
        F.concat(F.lit("about "), "id", F.when(marked, MARK).otherwise("")).alias("content"),
    )
    siblings = edges.groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children"))  # two a summary and one root a conversation
    parents = siblings.select(F.col("parent").alias("summary_id"), F.posexplode("children").alias("ordinal", "parent_id")).select("summary_id", "parent_id", "ordinal")
    m = messages(spark, sf_dir).withColumn("leaf", F.expr("format_string('%012d.0.%010d', conv_id, turn div 2)"))
    said = m.select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), "conv_id", F.col("turn").alias("seq"), "tokens", (noon + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("created_at"), "leaf")
    of = said.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("seq", "message_id"))).alias("held"))  # two a leaf
    sources = of.select(F.col("leaf").alias("summary_id"), F.posexplode("held").alias("ordinal", "h")).select("summary_id", F.col("h.message_id").alias("message_id"), "ordinal")
    none, summary = F.lit(None).cast("string"), F.lit("summary")
    roots = summaries.filter("depth = 2").select("conv_id", F.lit(0).cast("long").alias("ordinal"), summary.alias("item_type"), none.alias("message_id"), "summary_id")
    last = said.filter("conv_id % 2 = 1").groupBy("conv_id").agg(F.max_by("message_id", "seq").alias("message_id"))
    context = roots.unionByName(last.select("conv_id", F.lit(1).cast("long").alias("ordinal"), F.lit("message").alias("item_type"), "message_id", none.alias("summary_id")))
    return lineage.Store(summaries, parents, sources, said.drop("leaf"), context)


#: Some graphs with a cycle: in every tenth conversation the root was folded into its first part.
LOOPED_SQL = """links AS (SELECT summary_id, parent_id FROM parents UNION ALL SELECT parent_id, summary_id FROM parents JOIN summaries USING (summary_id) WHERE depth = 2 AND ordinal = 0 AND conv_id % 10 = 3)"""


@query(f"""WITH RECURSIVE {STORE_SQL}, {LOOPED_SQL},
up AS (SELECT summary_id AS node, parent_id AS anc FROM links UNION SELECT u.node, l.parent_id FROM up u JOIN links l ON l.summary_id = u.anc),
bad AS (SELECT DISTINCT node FROM up WHERE node = anc OR anc IN (SELECT node FROM up WHERE node = anc)),
paths AS (SELECT summary_id AS node, summary_id AS at, 0 AS n FROM summaries WHERE summary_id NOT IN (SELECT node FROM bad) UNION ALL SELECT p.node, l.parent_id, p.n + 1 FROM paths p JOIN links l ON l.summary_id = p.at)
SELECT summary_id, CASE WHEN summary_id IN (SELECT node FROM bad) THEN 1 ELSE (SELECT max(n) FROM paths WHERE node = summary_id) END::INTEGER AS depth, summary_id NOT IN (SELECT node FROM bad) AS resolved FROM summaries""")
def summary_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of all summaries, found again from the links, some of which run in a circle."""
    s = store(spark, sf_dir)
    roots = s.summaries.filter("depth = 2 AND conv_id % 10 = 3").select("summary_id")
    turned = s.parents.filter("ordinal = 0").join(roots, "summary_id", "left_semi")
    looped = s.parents.unionByName(turned.select(F.col("parent_id").alias("summary_id"), F.col("summary_id").alias("parent_id"), "ordinal"))
    return lineage.depths(s.summaries, looped)


@query(f"""WITH RECURSIVE {STORE_SQL}, walk AS (SELECT summary_id AS top, summary_id AS node FROM summaries UNION ALL SELECT w.top, p.parent_id FROM walk w JOIN parents p ON p.summary_id = w.node),
held AS (SELECT top, count(*) - 1 AS descendants, sum(tokens) FILTER (summary_id <> top) AS descendant_tokens FROM walk JOIN summaries ON summary_id = node GROUP BY top),
spans AS (SELECT top, min(m.created_at) AS earliest_at, max(m.created_at) AS latest_at, sum(m.tokens) AS source_tokens FROM walk JOIN sources s ON s.summary_id = node JOIN said m ON m.message_id = s.message_id GROUP BY top)
SELECT h.top AS summary_id, earliest_at, latest_at, descendants, coalesce(descendant_tokens, 0)::BIGINT AS descendant_tokens, source_tokens::BIGINT AS source_tokens FROM held h JOIN spans s ON s.top = h.top""")
def summary_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, numbers and tokens of what lies below each summary, bottom-up."""
    return lineage.rollups(store(spark, sf_dir))


@query(f"""WITH {STORE_SQL}, kept AS (SELECT * FROM said WHERE NOT (conv_id % 7 = 2 AND seq = 1)), links AS (SELECT p.* FROM parents p WHERE NOT starts_with(p.summary_id, lpad('5', 12, '0'))),
items AS (SELECT * FROM context UNION ALL SELECT conv_id, 0, item_type, message_id, summary_id FROM context WHERE conv_id % 11 = 4)
SELECT 'conversation_exists' AS rule, 'fail' AS status, conv_id, conv_id::VARCHAR AS item FROM (SELECT DISTINCT conv_id FROM summaries WHERE conv_id % 13 = 6)
UNION ALL SELECT 'context_items_ordered', 'fail', conv_id, ordinal::VARCHAR FROM items GROUP BY conv_id, ordinal HAVING count(*) > 1
UNION ALL SELECT 'context_items_valid_refs', 'fail', conv_id, message_id FROM items WHERE message_id IS NOT NULL AND message_id NOT IN (SELECT message_id FROM kept)
UNION ALL SELECT 'summaries_have_lineage', 'fail', conv_id, summary_id FROM summaries WHERE kind = 'condensed' AND summary_id NOT IN (SELECT summary_id FROM links)
UNION ALL SELECT 'no_orphan_summaries', 'warn', conv_id, summary_id FROM summaries WHERE summary_id NOT IN (SELECT parent_id FROM links) AND summary_id NOT IN (SELECT summary_id FROM items WHERE summary_id IS NOT NULL)
UNION ALL SELECT 'message_seq_contiguous', 'fail', conv_id, conv_id::VARCHAR FROM kept GROUP BY conv_id HAVING min(seq) <> 0 OR max(seq) <> count(*) - 1
UNION ALL SELECT 'no_duplicate_context_refs', 'fail', conv_id, coalesce(message_id, summary_id) FROM items GROUP BY conv_id, message_id, summary_id HAVING count(*) > 1""")
def store_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the eight rules in a store that lacks conversations, messages and links, and has items twice."""
    from dataclasses import replace

    s = store(spark, sf_dir)
    again = s.context.filter("conv_id % 11 = 4").withColumn("ordinal", F.lit(0).cast("long"))
    broken = replace(
        s, messages=s.messages.filter("NOT (conv_id % 7 = 2 AND seq = 1)"), parents=s.parents.filter(~F.startswith("summary_id", F.lit("5".rjust(12, "0")))), context=s.context.unionByName(again),
    )
    return lineage.checks(broken, s.summaries.filter("conv_id % 13 <> 6").select("conv_id").distinct())


@query(f"""WITH {STORE_SQL}, targets AS (SELECT * FROM context WHERE summary_id IS NOT NULL AND conv_id % 4 <> 2), n AS (SELECT summary_id, count(*) AS n FROM parents GROUP BY 1)
SELECT t.conv_id, p.ordinal, 'summary' AS item_type, NULL::VARCHAR AS message_id, p.parent_id AS summary_id FROM targets t JOIN parents p ON p.summary_id = t.summary_id
UNION ALL SELECT c.conv_id, c.ordinal + n.n - 1, c.item_type, c.message_id, c.summary_id FROM context c JOIN targets t ON t.conv_id = c.conv_id JOIN n ON n.summary_id = t.summary_id WHERE c.ordinal > 0
UNION ALL SELECT c.* FROM context c WHERE conv_id % 4 = 2""")
def dissolved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context once most roots have given way to what was folded into them."""
    s = store(spark, sf_dir)
    targets = s.context.filter("summary_id IS NOT NULL AND conv_id % 4 <> 2").select("conv_id", "summary_id")
    return lineage.dissolved(s, targets)[1].context


NEW_SQL = "'sum_' || left(sha256(target || ':' || summary_id), 32)"


@query(f"""WITH {STORE_SQL}, moves AS (SELECT DISTINCT conv_id AS source, conv_id + 1 AS target FROM summaries WHERE conv_id % 4 = 0 AND conv_id + 1 IN (SELECT conv_id FROM summaries)),
copied AS (SELECT target AS conv_id, {NEW_SQL} AS summary_id, depth, created_at FROM moves JOIN summaries ON conv_id = source WHERE depth = 2),
folded AS (SELECT conv_id, summary_id, depth, created_at FROM context JOIN summaries USING (conv_id, summary_id) UNION ALL SELECT * FROM copied),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC, created_at, summary_id) - 1 AS ordinal, 'summary' AS item_type, NULL::VARCHAR AS message_id, summary_id FROM folded),
counted AS (SELECT conv_id, count(*) AS n FROM folded GROUP BY 1)
SELECT * FROM placed UNION ALL SELECT conv_id, n, item_type, message_id, NULL FROM context JOIN counted USING (conv_id) WHERE item_type = 'message'""")
def transplanted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context once every fourth conversation's summaries were copied into the next one."""
    s = store(spark, sf_dir)
    known = s.summaries.select("conv_id").distinct()
    moves = known.filter("conv_id % 4 = 0").select(F.col("conv_id").alias("source"), (F.col("conv_id") + 1).alias("target"))
    return lineage.transplanted(s, moves, known)[2].context


@query(f"""WITH RECURSIVE {STORE_SQL}, asked AS (SELECT conv_id // 10 AS request, (conv_id % 10)::INTEGER AS place, summary_id FROM summaries WHERE depth = 2),
walk AS (SELECT request, place, summary_id AS root, p.parent_id AS item, '/' || lpad(p.ordinal::VARCHAR, 10, '0') || ':' || p.parent_id AS path FROM asked JOIN parents p USING (summary_id)
  UNION ALL SELECT w.request, w.place, w.root, p.parent_id, w.path || '/' || lpad(p.ordinal::VARCHAR, 10, '0') || ':' || p.parent_id FROM walk w JOIN parents p ON p.summary_id = w.item),
every AS (SELECT request, place, root, 'summary' AS kind, item, tokens, path FROM walk JOIN summaries ON summary_id = item
  UNION ALL SELECT request, place, root, 'message', s.message_id, m.tokens, w.path || '/' || lpad(s.ordinal::VARCHAR, 10, '0') || ':' || s.message_id FROM walk w JOIN sources s ON s.summary_id = w.item JOIN said m ON m.message_id = s.message_id)
SELECT request, place, root, kind, item, tokens, running, path FROM (SELECT *, sum(tokens) OVER (PARTITION BY request ORDER BY place, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM every) WHERE running <= 1000""")
def expanded_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten conversations a request, unfolded down to their turns within one cap of tokens."""
    s = store(spark, sf_dir)
    roots = s.summaries.filter("depth = 2")
    asked = roots.select(F.floor(F.col("conv_id") / 10).alias("request"), (F.col("conv_id") % 10).cast("int").alias("place"), "summary_id", F.lit(1000).cast("long").alias("cap"))
    return lineage.expanded(asked, s, 5, with_messages=True)


@query(f"""WITH {STORE_SQL}, bad AS (SELECT * FROM summaries WHERE contains(content, '{MARK}'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN depth = 0 THEN 0 ELSE depth END, created_at, summary_id) AS place, summary_id, depth, NULL::BIGINT AS ordinal FROM bad""")
def repair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of last resort in the order in which to write them anew."""
    return lineage.repair_plan(store(spark, sf_dir), MARK)

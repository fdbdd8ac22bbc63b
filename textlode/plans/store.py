"""More of the store: filters, junk, roll-ups, renumbering, ordered decay, ingest actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.operators import graph
from textlode.operators.filters import LEAST_CONFIDENCE, META_PREDICATES, META_SUBJECTS, PATHS, RELATIVE, SENDING, STATING, is_junk
from textlode.plans.history import DAG_SQL, dag
from textlode.plans.registry import query
from textlode.plans.relational import MENTIONS_SQL, mentions
from textlode.plans.retrieval import BM25_ROWS, QUESTIONS, _bm25, bm25_sql
from textlode.sources.tables import CLAIMS_SQL, MESSAGES_SQL, claims, messages, table

def listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: Claims of each kind of junk and of none, by event.
SAID = (
    ("Message", "contains", "hello"), ("docs site", "is", "https://docs.example.com"), ("config", "path", "/etc/hosts"), ("http://x.y", "is", "down"), ("build", "output", "./dist/a"),
    ("alice", "sent", "a note"), ("general", "states", "x"), ("constraint", "states", "never do x"), ("api key", "expires", "friday"), ("c:\\temp", "is", "full"), ("image", "size", "3"),
)


@query(f"""WITH said AS (SELECT event_id, round(value % 1, 4) AS confidence, ([{', '.join(f"{{'s': '{s}', 'p': '{p}', 'v': '{v}'}}" for s, p, v in SAID)}])[1 + event_id % {len(SAID)}] AS c FROM events),
low AS (SELECT event_id, confidence, lower(trim(c.s)) AS s, lower(trim(c.p)) AS p, lower(trim(c.v)) AS v FROM said)
SELECT event_id, (s IN ({listed(META_SUBJECTS)}) AND p IN ({listed(META_PREDICATES)})) OR regexp_matches(v, '(?i){PATHS}') OR regexp_matches(s, '(?i){PATHS}')
  OR regexp_matches(s, '^(http|https|ftp)://') OR regexp_matches(v, '{RELATIVE}') OR confidence < {LEAST_CONFIDENCE} OR p IN ({listed(SENDING)})
  OR (p = 'states' AND s IN ({listed(STATING)})) AS junk FROM low""")
def junk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip("spv", row, strict=True))) for row in SAID)), (F.col("event_id") % len(SAID)).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") % 1, 4).alias("confidence"), said.alias("c"))
    return e.select("event_id", is_junk(F.col("c.s"), F.col("c.p"), F.col("c.v"), F.col("confidence")).alias("junk"))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every condition that is given: a value, a list of values, or a part of a text (``name_like``)."""

    def condition(name: str, value) -> Column:
        if name.endswith("_like"):
            return F.contains(F.lower(F.col(name.removesuffix("_like"))), F.lit(value.lower()))
        return F.col(name).isin(*value) if isinstance(value, list | tuple) else F.col(name) == value

    return reduce(DataFrame.filter, [condition(n, v) for n, v in wanted.items() if v is not None], rows)


@query(f"""WITH {CLAIMS_SQL} SELECT id, canonical_key FROM claims WHERE scope_id IN (1, 2, 3) AND provisional = false AND contains(lower(canonical_key), 'click')
  ORDER BY created_at DESC, id DESC LIMIT 100""")
def filtered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing by conditions of which any may be left out; the newest 100."""
    found = matching(claims(spark, sf_dir), scope_id=[1, 2, 3], provisional=False, canonical_key_like="Click", object=None)
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "canonical_key")


@query("SELECT l_partkey AS chunk, min(l_discount) AS distance, min(l_linenumber) AS rank FROM lineitem GROUP BY 1")
def best_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several query variants, reduced to the least distance and the least rank of each chunk."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("chunk")).agg(F.min("l_discount").alias("distance"), F.min("l_linenumber").alias("rank"))


@query("""SELECT source, count(*) AS chunks, round(avg(n_chars / 1000.0::DOUBLE), 6) AS score, left(arg_max(text, row(n_chars, -doc_id)), 300) AS snippet FROM documents GROUP BY source""")
def source_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: hits, mean score, and the front of its best hit's text."""
    d = table(spark, sf_dir, "documents").groupBy("source")
    best = F.max_by("text", F.struct("n_chars", -F.col("doc_id")))
    return d.agg(F.count("*").alias("chunks"), F.round(F.avg(F.col("n_chars") / 1000.0), 6).alias("score"), F.substring(best, 1, 300).alias("snippet"))


@query(f"""WITH {bm25_sql(QUESTIONS, 'documents', 'doc_id')}, {BM25_ROWS}
SELECT query_id, doc_id, round(1 - (rank - 1.0::DOUBLE) / count(*) OVER (PARTITION BY query_id), 6) AS score FROM bm25 WHERE rank <= 10""")
def synthetic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by rank alone, where no reranker gave any."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return _bm25(spark, sf_dir, 10).select("query_id", "doc_id", F.round(1 - (F.col("rank") - 1) / n, 6).alias("score"))


@query(f"""WITH RECURSIVE {DAG_SQL}, walk AS (SELECT id AS root, id AS node, 0 AS depth FROM nodes UNION ALL SELECT w.root, e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node),
times AS (SELECT DISTINCT lpad(conv_id::VARCHAR, 12, '0') || '.0.' || lpad((turn // 2)::VARCHAR, 10, '0') AS leaf, min(turn) AS first, max(turn) AS last FROM messages GROUP BY 1)
SELECT root AS id, count(*) FILTER (w.depth > 0) AS descendants, coalesce(sum(n.tokens) FILTER (w.depth > 0), 0)::BIGINT AS descendant_tokens, min(first) AS earliest, max(last) AS latest
FROM walk w JOIN nodes n ON n.id = w.node LEFT JOIN times t ON t.leaf = w.node GROUP BY root""")
def lineage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each summary: how many lie below it, their tokens, and the first and last turn that it covers."""
    nodes, edges = dag(spark, sf_dir)
    leaf = F.expr("format_string('%012d.0.%010d', conv_id, turn div 2)")
    times = messages(spark, sf_dir).groupBy(leaf.alias("leaf")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    walk = graph.descend(nodes.select("id"), edges, 10).join(nodes.select(F.col("id").alias("node"), "tokens"), "node")
    below = F.when(F.col("depth") > 0, F.col("tokens"))
    return walk.join(times, F.col("node") == F.col("leaf"), "left").groupBy(F.col("root").alias("id")).agg(
        F.count(below).alias("descendants"), F.coalesce(F.sum(below), F.lit(0)).alias("descendant_tokens"), F.min("first").alias("earliest"), F.max("last").alias("latest")
    )


@query(f"""WITH RECURSIVE {DAG_SQL}, up AS (SELECT id AS start, id AS node, 0 AS steps FROM nodes WHERE depth = 0 UNION ALL SELECT u.start, e.parent, u.steps + 1 FROM up u JOIN edges e ON e.child = u.node)
SELECT start, node, steps FROM up WHERE steps > 0""")
def summary_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries above each leaf: the same walk over turned edges."""
    nodes, edges = dag(spark, sf_dir)
    turned = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    walk = graph.descend(nodes.filter("depth = 0").select("id"), turned, 10)
    return walk.filter("depth > 0").select(F.col("root").alias("start"), "node", F.col("depth").alias("steps"))


@query(f"""WITH {DAG_SQL} SELECT n.id, n.depth, n.tokens, (SELECT max(parent) FROM edges e WHERE e.child = n.id) AS parent,
  (SELECT coalesce(string_agg(child, ',' ORDER BY child), '') FROM edges e WHERE e.parent = n.id) AS children FROM nodes n""")
def summary_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each summary with the one above and those below it."""
    nodes, edges = dag(spark, sf_dir)
    above = edges.groupBy("child").agg(F.max("parent").alias("above"))
    below = edges.groupBy("parent").agg(F.array_join(F.sort_array(F.collect_list("child")), ",").alias("below"))
    joined = nodes.join(above, F.col("id") == F.col("child"), "left").join(below, F.col("id") == F.col("parent"), "left")
    return joined.select("id", "depth", "tokens", F.col("above").alias("parent"), F.coalesce("below", F.lit("")).alias("children"))


@query(f"""WITH {DAG_SQL} SELECT (SELECT count(DISTINCT conv_id) FROM messages) AS conversations, (SELECT count(*) FROM messages) AS messages, (SELECT sum(tokens)::BIGINT FROM messages) AS message_tokens,
  (SELECT count(*) FROM nodes WHERE depth = 0) AS leaves, (SELECT count(*) FROM nodes WHERE depth > 0) AS condensed, (SELECT count(*) FROM edges) AS links,
  (SELECT max(depth) FROM nodes) AS deepest, (SELECT sum(tokens)::BIGINT FROM nodes) AS summary_tokens""")
def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight numbers about the store, a row each from one aggregate a table."""
    nodes, edges = dag(spark, sf_dir)
    m = messages(spark, sf_dir).agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("messages"), F.sum("tokens").alias("message_tokens"))
    n = nodes.agg(F.count_if(F.col("depth") == 0).alias("leaves"), F.count_if(F.col("depth") > 0).alias("condensed"), F.max("depth").alias("deepest"), F.sum("tokens").alias("summary_tokens"))
    return m.crossJoin(n).crossJoin(edges.agg(F.count("*").alias("links")))  # one row each


@query(f"WITH {MESSAGES_SQL} SELECT role, count(*) AS messages, sum(tokens)::BIGINT AS tokens FROM messages GROUP BY role")
def tokens_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("role").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {DAG_SQL} SELECT conv_id, (SELECT count(*) FROM messages m WHERE m.conv_id = n.conv_id) AS turns, count(*) AS summaries, (SELECT max(turn) FROM messages m WHERE m.conv_id = n.conv_id) AS last_turn FROM nodes n GROUP BY conv_id""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = dag(spark, sf_dir)
    turns = messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
    return nodes.groupBy("conv_id").agg(F.count("*").alias("summaries")).join(turns, "conv_id")


@query(f"""WITH {DAG_SQL}, items AS (SELECT conv_id, 0 AS class, id AS item, depth AS place FROM nodes UNION ALL SELECT conv_id, 1, turn::VARCHAR, turn FROM messages)
SELECT conv_id, item, row_number() OVER (PARTITION BY conv_id ORDER BY class, place, item) - 1 AS ordinal FROM items""")
def renumbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context items in one order from 0 on: summaries first, then messages."""
    nodes, _ = dag(spark, sf_dir)
    first = nodes.select("conv_id", F.lit(0).alias("class"), F.col("id").alias("item"), F.col("depth").cast("long").alias("place"))
    every = first.unionByName(messages(spark, sf_dir).select("conv_id", F.lit(1).alias("class"), F.col("turn").cast("string").alias("item"), F.col("turn").alias("place")))
    ordinal = F.row_number().over(Window.partitionBy("conv_id").orderBy("class", "place", "item")) - 1
    return every.select("conv_id", "item", ordinal.cast("long").alias("ordinal"))


@query(f"""WITH {DAG_SQL}, runs AS (SELECT conv_id, depth, count(*) AS fanout, sum(tokens)::BIGINT AS tokens FROM nodes GROUP BY ALL HAVING count(*) >= 2 AND sum(tokens) >= 40)
SELECT conv_id, min(depth) AS depth, arg_min(fanout, depth) AS fanout, arg_min(tokens, depth) AS tokens FROM runs GROUP BY conv_id""")
def condensation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shallowest depth of each conversation with enough summaries and tokens to condense."""
    nodes, _ = dag(spark, sf_dir)
    runs = nodes.groupBy("conv_id", "depth").agg(F.count("*").alias("fanout"), F.sum("tokens").alias("tokens")).filter("fanout >= 2 AND tokens >= 40")
    best = runs.groupBy("conv_id").agg(F.min(F.struct("depth", "fanout", "tokens")).alias("b"))
    return best.select("conv_id", "b.*")


@query("""SELECT scope, id, place FROM (SELECT user_id % 7 AS scope, event_id AS id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY CASE event_type WHEN 'error' THEN 8 WHEN 'purchase' THEN 4 ELSE 2 END DESC, ts, event_id) AS place
  FROM events) WHERE place <= 10""")
def open_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most urgent loops of each scope, the oldest of equals first."""
    urgency = F.when(F.col("event_type") == "error", 8).when(F.col("event_type") == "purchase", 4).otherwise(2)
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("urgency"), "ts", "event_id")).cast("long")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("scope"), "event_id", "ts", urgency.alias("urgency"))
    return e.withColumn("place", place).filter("place <= 10").select("scope", F.col("event_id").alias("id"), "place")


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS words, lag(list_distinct(string_split(lower(text), ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, len(list_filter(words, lambda x: NOT list_contains(before, x))) AS fresh, array_to_string(list_sort(list_filter(words, lambda x: NOT list_contains(before, x))), ' ')  AS terms FROM w WHERE before IS NOT NULL""")
def fresh_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a turn that the turn before lacks."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))
    before = F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))
    found = c.withColumn("before", before).filter("before IS NOT NULL").withColumn("fresh", F.array_except("words", "before"))
    return found.select("conv_id", "turn", F.size("fresh").cast("long").alias("fresh"), F.array_join(F.array_sort("fresh"), " ").alias("terms"))


@query(f"""WITH {MENTIONS_SQL}, given AS (SELECT term FROM mentions GROUP BY term ORDER BY count(*) DESC, term LIMIT 2), near AS (SELECT DISTINCT doc_id FROM mentions WHERE term IN (SELECT term FROM given))
SELECT term, sources FROM (SELECT term, count(*) AS sources, row_number() OVER (ORDER BY count(*) DESC, term) AS n FROM mentions SEMI JOIN near USING (doc_id) WHERE term NOT IN (SELECT term FROM given) GROUP BY term) WHERE n <= 3""")
def proactive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms that most often share a text with the two most frequent ones."""
    m = mentions(spark, sf_dir).select("term", "doc_id")
    given = F.broadcast(m.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(2).select("term"))
    near = m.join(given, "term", "left_semi").select("doc_id").distinct()
    counted = m.join(given, "term", "left_anti").join(near, "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("sources"))
    return counted.orderBy(F.desc("sources"), "term").limit(3)


RUNBOOKS_SQL = """runbooks AS (SELECT event_id AS id, user_id % 7 AS scope_id, event_type AS tool, round(value % 1, 4) AS confidence, ts AS updated_at FROM events WHERE event_id % 13 = 0),
worked AS (SELECT DISTINCT user_id % 7 AS scope_id, event_type AS tool FROM events WHERE event_id % 101 = 0 AND ts > TIMESTAMP '2024-01-12')"""


@query(f"""WITH {RUNBOOKS_SQL}, first AS (SELECT r.*, w.tool IS NOT NULL AND confidence > 0.3 AS relieved FROM runbooks r LEFT JOIN worked w USING (scope_id, tool)),
second AS (SELECT *, CASE WHEN relieved THEN confidence * 0.7::DOUBLE ELSE confidence END AS c1 FROM first),
third AS (SELECT *, CASE WHEN NOT relieved AND c1 > 0.2 AND updated_at < TIMESTAMP '2024-01-12' THEN c1 * 0.8::DOUBLE ELSE c1 END AS c2 FROM second)
SELECT id, round(c2, 6) AS confidence, CASE WHEN c2 <= 0.2 THEN 'stale' ELSE 'active' END AS status FROM third""")
def decayed_runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered decay of warnings: where the tool has worked of late, then (if not touched) by age, then what is low is stale."""
    e = table(spark, sf_dir, "events").withColumn("scope_id", F.col("user_id") % 7)
    cut = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    books = e.filter("event_id % 13 = 0").select(F.col("event_id").alias("id"), "scope_id", F.col("event_type").alias("tool"), F.round(F.col("value") % 1, 4).alias("confidence"), "ts")
    worked = e.filter((F.col("event_id") % 101 == 0) & (F.col("ts") > cut)).select("scope_id", F.col("event_type").alias("tool")).distinct().withColumn("works", F.lit(True))
    relieved = F.coalesce("works", F.lit(False)) & (F.col("confidence") > 0.3)
    aged = ~F.col("relieved") & (F.col("confidence") > 0.2) & (F.col("ts") < cut)
    left = F.when(F.col("relieved"), F.col("confidence") * 0.7).when(aged, F.col("confidence") * 0.8).otherwise(F.col("confidence"))
    done = books.join(worked, ["scope_id", "tool"], "left").withColumn("relieved", relieved).withColumn("left", left)
    return done.select("id", F.round("left", 6).alias("confidence"), F.when(F.col("left") <= 0.2, "stale").otherwise("active").alias("status"))


@query("""WITH known AS (SELECT doc_id, n_chars AS mtime, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0),
found AS (SELECT doc_id, n_chars, n_chars + (doc_id % 2)::BIGINT AS mtime, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS hash FROM documents)
SELECT f.doc_id, CASE WHEN f.n_chars > 15000 THEN 'too large' WHEN k.doc_id IS NULL THEN 'add' WHEN k.mtime = f.mtime THEN 'unchanged' WHEN k.hash = f.hash THEN 'touched' ELSE 'update' END AS action
FROM found f LEFT JOIN known k USING (doc_id)""")
def ingest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each file that is found: by size, then by what is known of its path, its time and its content."""
    d = table(spark, sf_dir, "documents")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    known = d.filter("doc_id % 3 <> 0").select("doc_id", F.col("n_chars").alias("old_mtime"), sha(F.col("text")).alias("old_hash"), F.lit(True).alias("known"))
    text = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = d.select("doc_id", "n_chars", (F.col("n_chars") + F.col("doc_id") % 2).alias("mtime"), sha(text).alias("hash"))
    action = (
        F.when(F.col("n_chars") > 15_000, "too large").when(F.col("known").isNull(), "add").when(F.col("old_mtime") == F.col("mtime"), "unchanged")
        .when(F.col("old_hash") == F.col("hash"), "touched").otherwise("update")
    )
    return found.join(known, "doc_id", "left").select("doc_id", action.alias("action"))


ASKED = ("er", "und", "that", "zzz")


@query(f"""SELECT conv_id, turn, round(0.2 + 0.8::DOUBLE * len(list_filter([{listed(ASKED)}], lambda w: contains(lower(text), w))) / {len(ASKED)}, 6) AS relevance FROM conversations""")
def query_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the query's words that a text contains, between 0.2 and 1."""
    low = F.lower("text")
    hits = F.size(F.filter(F.array(*map(F.lit, ASKED)), lambda w: F.contains(low, w)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(0.2 + 0.8 * hits / len(ASKED), 6).alias("relevance"))


#: What a status leaves of an object's score; others leave a half.
STATUS_SHARES = {"active": 1.0, "needs_confirmation": 0.9, "stale": 0.3, "superseded": 0.0, "retracted": 0.0}
STATUSES = (*STATUS_SHARES, "draft")


@query(f"""SELECT event_id, status, round(value * CASE status {' '.join(f"WHEN '{s}' THEN {x}::DOUBLE" for s, x in STATUS_SHARES.items())} ELSE 0.5 END, 6) AS score
FROM (SELECT event_id, value, ([{listed(STATUSES)}])[1 + event_id % {len(STATUSES)}] AS status FROM events)""")
def status_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % len(STATUSES)).cast("int"))
    share = reduce(lambda c, kv: c.when(F.col("status") == kv[0], kv[1]), list(STATUS_SHARES.items())[1:], F.when(F.col("status") == "active", 1.0)).otherwise(0.5)
    e = table(spark, sf_dir, "events").select("event_id", "value", status.alias("status"))
    return e.select("event_id", "status", F.round(F.col("value") * share, 6).alias("score"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS written FROM events")
def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" UTC")).alias("written"))


@query("""SELECT DISTINCT c_nationkey AS source, n_nationkey AS target FROM (SELECT c_nationkey, lower(CASE WHEN c_custkey % 4 = 0 THEN 'missing' ELSE p.n_name END) AS link
  FROM customer JOIN nation p ON p.n_nationkey = (c_custkey % 25)) JOIN nation n ON lower(n.n_name) = link WHERE c_nationkey <> n.n_nationkey""")
def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between notes for the links that resolve; links to a note itself are none."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"), F.lower("n_name").alias("link"))
    named = n.select(F.col("target").alias("at"), F.col("link").alias("name"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(named), F.col("c_custkey") % 25 == F.col("at"))
    links = c.select(F.col("c_nationkey").alias("source"), F.when(F.col("c_custkey") % 4 == 0, "missing").otherwise(F.col("name")).alias("link"))
    return links.join(F.broadcast(n), "link").filter("source <> target").select("source", "target").distinct()

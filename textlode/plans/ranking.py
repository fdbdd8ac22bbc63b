"""Ranking by task, routing of expansions, shapes of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions import ranking as R
from textlode.functions import text as T
from textlode.operators import shapes
from textlode.plans.registry import query
from textlode.plans.texts import quoted
from textlode.sources.tables import AS_OF, OBJECTS_SQL, objects, table

NOW = f"TIMESTAMP '{AS_OF}'"
MODES = tuple(R.MODES)
KEPT = ("active", "needs_confirmation", "superseded")
CASE = lambda c, values, other: f"CASE {c} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in values.items())} ELSE {other} END::DOUBLE"
WEIGHTED = " + ".join(f"{s} * {CASE('mode', {m: w[s] for m, w in R.MODES.items()}, R.MODES['default'][s])}" for s in ("semantic", "recency", "trust", "conflict", "influence"))


@query(f"""WITH {OBJECTS_SQL}, rows AS (SELECT id, scope_id, created_at, CASE WHEN id % 19 = 5 THEN 'needs_confirmation' ELSE status END AS status, severity, (['{"', '".join(MODES)}', 'odd'])[1 + scope_id % 6] AS mode FROM objects),
recent AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, id DESC) <= 60),
signals AS (SELECT *, 0.5::DOUBLE AS semantic, greatest(0.1::DOUBLE, pow(0.5::DOUBLE, date_diff('day', created_at, {NOW}) / 30.0::DOUBLE)) AS recency, 0.7::DOUBLE AS trust,
  CASE WHEN status = 'needs_confirmation' THEN 1.0 ELSE 0.0 END::DOUBLE AS conflict, {CASE("CASE severity WHEN 'critical' THEN 'critical' WHEN 'error' THEN 'high' WHEN 'info' THEN 'low' ELSE 'unknown' END", R.INFLUENCE, R.OTHER)} AS influence FROM recent),
scored AS (SELECT scope_id, id, round(({WEIGHTED}) * {CASE('status', R.STATUS, R.OTHER)}, 9) AS score FROM signals)
SELECT scope_id, id, score, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, id) AS place FROM scored QUALIFY place <= 20""")
def ranked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most relevant of the sixty newest objects of each scope, which has a mode of its own."""
    from pyspark.sql import Window

    o = objects(spark, sf_dir).withColumn("status", F.when(F.col("id") % 19 == 5, "needs_confirmation").otherwise(F.col("status")))
    newest = Window.partitionBy("scope_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = o.withColumn("n", F.row_number().over(newest)).filter("n <= 60")
    mode = F.get(F.array(*map(F.lit, (*MODES, "odd"))), (F.col("scope_id") % 6).cast("int"))
    days = F.datediff(F.lit(AS_OF).cast("timestamp_ntz"), F.col("created_at"))
    weight = F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "error", "high").when(F.col("severity") == "info", "low").otherwise("unknown")
    conflict = (F.col("status") == "needs_confirmation").cast("double")
    score = R.relevance(mode, F.lit(R.WITHOUT_WORD), T.freshness(days), F.lit(0.7), conflict, R.influence_score(weight), F.col("status"))
    best = Window.partitionBy("scope_id").orderBy(F.desc("score"), "id")
    scored = recent.select("scope_id", "id", F.round(score, 9).alias("score")).withColumn("place", F.row_number().over(best))
    return scored.filter("place <= 20")


#: What is asked of each conversation, by its number.
ASKED = (
    "What is the state?", "Show the timeline of it", "root cause of the outage over time", "between May and June", "from 2019 to 2023", "2022 and 2023", "how did this lead to that", "the last quarter",
    "a multi-step plan", "", "Which of the servers, if any, runs it: now?", "history 2020",
)
MATCH = lambda c, patterns: " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns)


@query(f"""WITH c AS (SELECT conv_id, ([{', '.join(map(quoted, ASKED))}])[1 + conv_id % {len(ASKED)}] AS query, CASE WHEN conv_id % 5 <> 0 THEN (conv_id % 13)::INTEGER END AS depth, count(*) AS n, count(*) * 300 AS cap, conv_id % 2 = 0 AS messages, conv_id % 3 <> 0 AS probe
  FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id),
years AS (SELECT *, list_transform(regexp_extract_all(query, '{R.YEAR}'), lambda y: y::INTEGER) AS ys, CASE WHEN depth IS NULL THEN 3 ELSE greatest(1, least(10, depth)) END AS lvl FROM c),
marks AS (SELECT *, query <> '' AND ({MATCH('query', R.BROAD)} OR (len(ys) >= 2 AND list_max(ys) - list_min(ys) >= 2)) AS broad, lvl >= 3 OR n >= 5 OR {MATCH('query', R.HOPS)} AS hops FROM years),
costs AS (SELECT *, ceil(round(CASE WHEN messages THEN 220 * 1.9::DOUBLE ELSE 220.0::DOUBLE END * (1 + (lvl - 1) * 0.65::DOUBLE) * CASE WHEN broad THEN 1.35::DOUBLE ELSE 1.0 END * CASE WHEN hops THEN 1.25::DOUBLE ELSE 1.0 END * n, 6))::BIGINT AS tokens FROM marks)
SELECT conv_id, CASE WHEN probe AND lvl <= 2 AND n <= 1 AND tokens / cap < 0.35 AND NOT broad AND NOT hops THEN 'answer_directly' WHEN tokens / cap >= 0.7 OR (broad AND hops) THEN 'delegate_traversal' ELSE 'expand_shallow' END AS action, lvl::INTEGER AS depth, tokens,
  round(tokens / cap, 6) AS ratio, CASE WHEN tokens / cap >= 0.7 THEN 'high' WHEN tokens / cap >= 0.35 THEN 'moderate' ELSE 'low' END AS risk, broad, hops,
  array_to_string(list_transform(list_filter(regexp_split_to_array(lower(query), '[\\s,;:!?.]+'), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(map(quoted, R.STOPWORDS))})), lambda w: left(w, 100))[1:5], ' ') AS terms FROM costs""")
def expansion_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a question to each conversation is to be answered, and the words to search for."""
    asked = F.get(F.array(*map(F.lit, ASKED)), (F.col("conv_id") % len(ASKED)).cast("int"))
    c = table(spark, sf_dir, "conversations").filter("turn % 2 = 0").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("query", asked)
    depth = F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 13)
    route = R.routed(F.col("query"), depth, F.col("n"), F.col("n") * 300, F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 != 0)
    found = c.select("conv_id", route.alias("r"), F.array_join(R.search_terms(F.col("query")), " ").alias("terms")).select("conv_id", "r.*", "terms")
    return found.withColumn("ratio", F.round("ratio", 6))


@query("""WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, event_id % 3 AS m FROM events)
SELECT '$' AS path, count(*) AS n, 'object' AS types, NULL::INTEGER AS longest, NULL::VARCHAR AS least, NULL::VARCHAR AS greatest FROM e WHERE m <> 2
UNION ALL SELECT '!', count(*), '', NULL, NULL, NULL FROM e WHERE m = 2
UNION ALL SELECT '$.type', count(*), 'text', NULL, min(event_type), max(event_type) FROM e WHERE m <> 2
UNION ALL SELECT '$.props', count(*), 'object', NULL, NULL, NULL FROM e WHERE m <> 2
UNION ALL SELECT '$.props.k', count(*), 'number', NULL, min(k), max(k) FROM e WHERE m <> 2
UNION ALL SELECT '$.ids', count(*), 'array', 2, NULL, NULL FROM e WHERE m <> 2
UNION ALL SELECT '$.ids[]', count(*) + count(*) FILTER (m = 1), 'null|number', NULL, min(event_id::VARCHAR), max(event_id::VARCHAR) FROM e WHERE m <> 2""")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of events as JSON, a third of which is broken: from sketches of three parts, merged."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    ids = F.when(n % 3 == 1, F.concat(n.cast("string"), F.lit(", null"))).otherwise(n.cast("string"))
    text = F.when(n % 3 == 2, "{broken").otherwise(F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit(', "ids": ['), ids, F.lit("]}")))
    rows = e.select(text.alias("json"), (n % 5 == 0).alias("first"), (n % 2 == 0).alias("even"))
    parts = [rows.filter("first"), rows.filter("NOT first AND even"), rows.filter("NOT first AND NOT even")]
    sketches = shapes.sketch(parts[0], "json").unionByName(shapes.sketch(parts[1], "json")).unionByName(shapes.sketch(parts[2], "json"))
    return shapes.described(shapes.merged(sketches)).select("path", "n", "types", "longest", "least", "greatest")

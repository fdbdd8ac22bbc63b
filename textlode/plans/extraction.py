"""Claims, decisions, open loops, rules, relations and names that turns and texts state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import extract, filters, terms
from textlode.plans.registry import query
from textlode.plans.texts import quoted
from textlode.sources.tables import table

#: What follows a turn on a line of its own, by its number, so that each kind of statement occurs, and small talk too.
LINES = (
    "", "We decided to use Postgres for staging. Next topic", "Decision: ship on Friday", "we agreed to meet weekly", "Task: rotate the api key", "Reminder: call the vendor",
    "Blocker: the build depends on the mirror", "Question: who owns the server?", "Follow-up: urgent report", "Remember: the staging DB uses Postgres", "Note: API key expires on Friday",
    "Alice Smith manages the Build Server", "Nova depends on Orion", "## Auth System\n- Login Method: tokens\n- Owner: Kim", "Billing is part of the Platform", "a `Task: not this` b",
    "Remember this: the VPN is slow", "FYI: the CI pipeline needs 20 minutes. Later less", "Don't forget: I have brown hair", "Keep in mind: region: eu west", "Important: never deploy on Fridays",
    "We've decided to adopt Rust instead of C", "Going with plan B", "We chose to migrate to Kafka", "Choosing: blue over red", "Action item: fix the urgent bug", "Next step: write the plan",
    "Need to: clean the cache", "Remind me: pay Kim", "Open question: who pays", "Redis is a fast cache.", "Nova Team depends on Orion Core for billing.", "Gateway handles the incoming traffic.",
    "The owner is Kim Lee.", "Postgres on port 5432", "You must run the tests!", "Avoid global state", "you should always write docs", "Rule: two reviews a change", "Note: don't store this joke",
    "Must remember: password is hunter", "critical: key point: none", "Billing Service manages Invoice Flow.", "Fact: the disk is full\nFact: the disk has failed",
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, role and text of each turn with its line."""
    line = F.get(F.array(*map(F.lit, LINES)), ((F.col("conv_id") * 5 + F.col("turn")) % len(LINES)).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("msg_id"), "role", F.concat_ws("\n", "text", line).alias("text"))


def quoted_lines(values: tuple[str, ...]) -> str:
    return ", ".join(quoted(v).replace("\n", "' || chr(10) || '") for v in values)


TURNS_SQL = f"""turns AS (SELECT conv_id || ':' || turn AS msg_id, regexp_replace(regexp_replace(text || chr(10) || ([{quoted_lines(LINES)}])[1 + (conv_id * 5 + turn) % {len(LINES)}],
  '```[\\s\\S]*?```', '', 'g'), '`[^`]+`', '', 'g') AS text FROM conversations)"""


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def sentence_sql(line: str) -> str:
    return strip_sql(f"regexp_split_to_array({strip_sql(line)}, '[.!?]\\s')[1]")


def said_sql(pattern: str, least: int, most: int) -> str:
    """msg_id, line (the whole match) and said (the first sentence of its group)."""
    return f"""SELECT * FROM (SELECT msg_id, line, {sentence_sql(f'regexp_extract(line, {quoted(pattern)}, 1)')} AS said
  FROM (SELECT msg_id, unnest(regexp_extract_all(text, {quoted(pattern)}, 0)) AS line FROM turns)) WHERE length(said) BETWEEN {least} AND {most}"""


ABOUT, CHOSEN = quoted(extract.CHOSEN_FOR), quoted(extract.CHOSEN)


@query(f"""WITH {TURNS_SQL}, said AS ({said_sql(extract.DECISION, 5, 300)})
SELECT msg_id, substr(CASE WHEN regexp_matches(said, {ABOUT}) THEN regexp_replace(lower({strip_sql(f'regexp_extract(said, {ABOUT}, 2)')}), '^(?:the|a|an|our|my)\\s+', '')
  WHEN regexp_matches(said, {CHOSEN}) THEN lower({strip_sql(f'regexp_extract(said, {CHOSEN}, 1)')})
  ELSE array_to_string(list_filter(regexp_split_to_array(lower(said), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(quoted, extract.TOPIC_STOP))}))[1:3], ' ') END, 1, 60) AS topic,
  said AS decision FROM said""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.decisions(turns(spark, sf_dir), "msg_id")


LOOP_SQL = [f"CASE {' '.join(f'WHEN contains(lower(line), {quoted(word)}) THEN {value}' for word, value in pairs)} ELSE {other} END" for pairs, other in (
    ([(w, quoted(k)) for w, k, _ in extract.LOOP_KINDS], "'task'"), ([(w, p) for w, _, p in extract.LOOP_KINDS], 4))]


@query(f"WITH {TURNS_SQL}, said AS ({said_sql(extract.LOOP, 5, 300)}) SELECT msg_id, {LOOP_SQL[0]} AS kind, said AS text, {LOOP_SQL[1]} AS priority FROM said")
def stated_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.loops(turns(spark, sf_dir), "msg_id")


RULES_SQL = " UNION ALL ".join(
    f"SELECT msg_id, {k} AS n, place, {sentence_sql('found')} AS description, '{severity}' AS severity, '{enforcement}' AS enforcement FROM (SELECT msg_id, unnest(x) AS found, unnest(range(len(x))) AS place FROM (SELECT msg_id, regexp_extract_all(text, {quoted(p)}, 1) AS x FROM turns))"
    for k, (p, severity, enforcement) in enumerate(extract.INVARIANTS)
)


@query(f"""WITH {TURNS_SQL}, rules AS (SELECT * FROM ({RULES_SQL}) WHERE length(description) BETWEEN 5 AND 200)
SELECT msg_id, substr(regexp_replace(lower(description), '[^a-z0-9]+', '_', 'g'), 1, 60) AS invariant, description, severity, enforcement FROM rules
QUALIFY row_number() OVER (PARTITION BY msg_id, lower(description) ORDER BY n, place) = 1""")
def stated_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.invariants(turns(spark, sf_dir), "msg_id")


VERBS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(b, {quoted('(?i)' + p)}) THEN '{name}'" for p, name in extract.VERBS) + " END"


@query(f"""WITH {TURNS_SQL}, lines AS (SELECT msg_id, unnest(regexp_extract_all(text, {quoted(extract.BETWEEN)}, 0)) AS line FROM turns),
parts AS (SELECT msg_id, lower(regexp_extract(line, {quoted(extract.BETWEEN)}, 1)) AS subject, regexp_extract(line, {quoted(extract.BETWEEN)}, 2) AS b, lower(regexp_extract(line, {quoted(extract.BETWEEN)}, 3)) AS object FROM lines)
SELECT DISTINCT msg_id, subject, {VERBS_SQL} AS predicate, object FROM parts WHERE {VERBS_SQL} IS NOT NULL""")
def stated_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.relations(turns(spark, sf_dir), "msg_id")


#: Between which names of nations, and with which words, a turn states a relation.
TIES = ("depends on", "is a backup for", "and", "connects to the", "owns the old", "is part of", "sends data to")


@query(f"""WITH said AS (SELECT conv_id || ':' || turn AS msg_id, text || chr(10) || 'We know that Nation_' || conv_id % 25 || ' ' || ([{', '.join(map(quoted, TIES))}])[1 + (conv_id + turn) % {len(TIES)}]
    || ' NATION_' || (conv_id * 3 + turn) % 25 || ' now.' AS text FROM conversations),
lines AS (SELECT msg_id, line FROM (SELECT msg_id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS line FROM said) WHERE length({strip_sql('line')}) > 10),
here AS (SELECT msg_id, line, lower(n_name) AS name, strpos(lower(line), lower(n_name)) AS at FROM lines JOIN nation ON contains(lower(line), lower(n_name))
  QUALIFY row_number() OVER (PARTITION BY msg_id, line ORDER BY length(n_name) DESC, n_name) <= 10),
pairs AS (SELECT a.msg_id, a.name AS subject, b.name AS object, {strip_sql('substr(a.line, a.at + length(a.name), greatest(b.at - a.at - length(a.name), 0))')} AS b
  FROM here a JOIN here b ON a.msg_id = b.msg_id AND a.line = b.line AND a.at < b.at)
SELECT DISTINCT msg_id, subject, {VERBS_SQL} AS predicate, object FROM pairs WHERE length(b) BETWEEN 2 AND 100 AND {VERBS_SQL} IS NOT NULL""")
def known_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between the names of nations, of which a sentence behind each turn tells."""
    c, known = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"))
    tie = F.get(F.array(*map(F.lit, TIES)), ((F.col("conv_id") + F.col("turn")) % len(TIES)).cast("int"))
    line = F.concat(F.lit("We know that Nation_"), F.col("conv_id") % 25, F.lit(" "), tie, F.lit(" NATION_"), (F.col("conv_id") * 3 + F.col("turn")) % 25, F.lit(" now."))
    said = c.select(F.concat_ws(":", "conv_id", "turn").alias("msg_id"), F.concat_ws("\n", "text", line).alias("text"))
    return extract.known_relations(said, known, "msg_id")


def places_sql(sql: str, strategy: int, source: str, confidence: float) -> str:
    return f"SELECT msg_id, {strategy} AS strategy, place, subject, predicate, object, {confidence}::DOUBLE AS confidence, {extract.TRUST[source]}::DOUBLE AS trust, '{source}' AS source_type FROM ({sql})"


def found_sql(pattern: str) -> str:
    """msg_id, place and line for each match."""
    return f"(SELECT msg_id, unnest(x) AS line, unnest(range(len(x))) AS place FROM (SELECT msg_id, regexp_extract_all(text, {quoted(pattern)}, 0) AS x FROM turns))"


def group_sql(pattern: str, n: int, line: str = "line") -> str:
    return strip_sql(f"regexp_extract({line}, {quoted(pattern)}, {n})")


STATED, COLON, LIMIT = quoted(extract.STATED), quoted(extract.COLON), quoted(extract.CONSTRAINT)
PERSON = f"regexp_matches({group_sql(extract.STATED, 1, 'said')}, {quoted(extract.FIRST_PERSON)})"
EXPLICIT_SQL = f"""SELECT msg_id, place, lower(CASE WHEN stated AND person THEN {group_sql(extract.STATED, 2, 'said')} WHEN stated THEN {group_sql(extract.STATED, 1, 'said')}
    WHEN colon THEN {group_sql(extract.COLON, 1, 'said')} WHEN regexp_matches(said, {LIMIT}) THEN 'constraint' ELSE 'user_note' END) AS subject,
  CASE WHEN stated AND person THEN 'user_' || lower({group_sql(extract.STATED, 1, 'said')}) WHEN stated OR colon THEN 'is' ELSE 'states' END AS predicate,
  CASE WHEN stated AND NOT person THEN {group_sql(extract.STATED, 2, 'said')} WHEN NOT stated AND colon THEN {group_sql(extract.COLON, 2, 'said')} ELSE said END AS object
FROM (SELECT *, regexp_matches(said, {STATED}) AS stated, {PERSON} AS person, regexp_matches(said, {COLON}) AS colon
  FROM (SELECT msg_id, place, {sentence_sql(f'regexp_extract(line, {quoted(extract.EXPLICIT)}, 1)')} AS said FROM {found_sql(extract.EXPLICIT)})
  WHERE length(said) BETWEEN 3 AND 300 AND NOT regexp_matches(said, {quoted(extract.UNREAL)}))"""


def narrative_sql(k: int, pattern: str, groups: int) -> str:
    value = group_sql(pattern, 2) if groups > 1 else strip_sql("line")
    if groups > 2:
        value = f"CASE WHEN {group_sql(pattern, 3)} <> '' THEN {value} || ' for ' || {group_sql(pattern, 3)} ELSE {value} END"
    verb = f"trim(regexp_replace(lower(regexp_extract({strip_sql('line')}, {quoted(extract.NARRATIVE_VERB)}, 1)), 's$', ''))"
    facts = f"""SELECT msg_id, {k * 1000} + place AS place, lower({group_sql(pattern, 1)}) AS subject, CASE WHEN {verb} = '' THEN 'is' ELSE {verb} END AS predicate, {value} AS object
  FROM {found_sql(pattern)} WHERE length({strip_sql('line')}) BETWEEN 10 AND 200"""
    return f"SELECT * FROM ({facts}) WHERE length(subject) >= 2 AND object <> '' AND subject NOT IN ({', '.join(map(quoted, extract.NO_SUBJECTS))})"


NARRATIVE_SQL = " UNION ALL ".join(narrative_sql(k, p, g) for k, (p, g) in enumerate(zip(extract.NARRATIVE, extract.NARRATIVE_GROUPS, strict=True)))
LISTED_SQL = f"""SELECT msg_id, block * 1000 + place AS place, subject, lower({group_sql(extract.BULLET, 1)}) AS predicate, {group_sql(extract.BULLET, 2)} AS object
FROM (SELECT msg_id, block, subject, unnest(x) AS line, unnest(range(len(x))) AS place FROM (SELECT msg_id, place AS block, lower({group_sql(extract.HEADED, 2)}) AS subject, string_split(line, chr(10)) AS x FROM {found_sql(extract.HEADED)}))
WHERE regexp_matches(line, {quoted(extract.BULLET)}) AND length({group_sql(extract.BULLET, 1)}) <= 50 AND length({group_sql(extract.BULLET, 2)}) <= 300"""
ALIASED = "CASE p " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in T.PREDICATE_ALIASES.items()) + " ELSE p END"
NORMAL = "regexp_replace(trim(lower({})), '\\s+', ' ', 'g')"


@query(f"""WITH {TURNS_SQL}, facts AS ({places_sql(EXPLICIT_SQL, 1, 'user_explicit', 0.9)} UNION ALL {places_sql(NARRATIVE_SQL, 2, 'narrative', 0.6)} UNION ALL {places_sql(LISTED_SQL, 3, 'document', 0.7)}),
keyed AS (SELECT *, 'claim::' || {NORMAL.format('subject')} || '::' || {ALIASED} AS canonical_key FROM (SELECT *, replace({NORMAL.format('predicate')}, ' ', '_') AS p FROM facts)),
best AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY msg_id, canonical_key ORDER BY trust DESC, strategy, place) = 1)
SELECT msg_id, subject, predicate, object, 'text' AS value_type, confidence, trust, source_type, canonical_key FROM best
WHERE NOT regexp_matches(lower(subject || ' ' || predicate || ' ' || object), {quoted('|'.join(filters.SENSITIVE))})
  AND NOT (subject IN ({', '.join(map(quoted, filters.OWN_SUBJECTS))}) OR contains(subject, ' vibe') OR contains(subject, ' identity') OR regexp_matches(lower(object), {quoted(filters.TOOL_LIST)}))
  AND NOT ((subject IN ({', '.join(map(quoted, filters.META_SUBJECTS))}) AND lower(predicate) IN ({', '.join(map(quoted, filters.META_PREDICATES))}))
    OR regexp_matches(lower(trim(object)), {quoted('(?i)' + filters.PATHS)}) OR regexp_matches(lower(trim(subject)), {quoted('(?i)' + filters.PATHS)}) OR regexp_matches(lower(trim(subject)), '^(http|https|ftp)://')
    OR regexp_matches(lower(trim(object)), {quoted(filters.RELATIVE)}) OR lower(predicate) IN ({', '.join(map(quoted, filters.SENDING))})
    OR (predicate = 'states' AND subject IN ({', '.join(map(quoted, filters.STATING))})))""")
def stated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.claims(turns(spark, sf_dir), "msg_id")


@query("""WITH e AS (SELECT event_id AS id, event_type AS tool, json_extract_string(props, '$.k') AS k, user_id, round(value, 2) AS value, event_id % 3 = 0 AS late FROM events)
SELECT id, tool AS subject, predicate, object, value_type, 0.8::DOUBLE AS confidence, 1.0::DOUBLE AS trust, 'tool_result' AS source_type, 'claim::' || tool || '::' || CASE predicate WHEN 'state' THEN 'status' ELSE predicate END AS canonical_key FROM (
  SELECT id, tool, 'props.k' AS predicate, k AS object, 'number' AS value_type FROM e
  UNION ALL SELECT id, tool, 'user.id', user_id::VARCHAR, 'number' FROM e UNION ALL SELECT id, tool, 'user.name.first', 'U' || user_id, 'text' FROM e
  UNION ALL SELECT id, tool, 'state', 'done', 'text' FROM e UNION ALL SELECT id, tool, 'seen.' || i || '.at', (id + i - 1)::VARCHAR, 'number' FROM e, (VALUES (1), (2)) AS n(i)
  UNION ALL SELECT id, tool, 'late', CASE WHEN late THEN 'true' ELSE 'false' END, 'boolean' FROM e)""")
def tool_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of tools' results: an event is a call of its type, and its row, nested up to one level too deep, the result."""
    number = lambda c: F.col(c).cast("string")
    result = F.concat(
        F.lit('{"props": '), "props", F.lit(', "state": "done", "none": null, "late": '), (F.col("event_id") % 3 == 0).cast("string"), F.lit(', "user": {"id": '), number("user_id"),
        F.lit(', "name": {"first": "U'), number("user_id"), F.lit('", "more": {"deep": {"deeper": 1}}}}, "seen": [7, {"at": '), number("event_id"), F.lit('}, {"at": '), (F.col("event_id") + 1).cast("string"), F.lit("}]}"),
    )
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), result.alias("result"))
    return extract.tool_claims(calls)


@query()
def understood_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns say, by all detectors; tests/test_extract.py has the facts that must come out."""
    return extract.understood(turns(spark, sf_dir), "msg_id")


def known_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two words: neighbours in a benchmark item, and the names of parts."""
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    held = table(spark, sf_dir, "benchmark").select(words.alias("words")).filter(F.size("words") > 1).select(F.explode(pairs).alias("term"))
    return held.unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("term"))).distinct()


KNOWN_SQL = """words AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM benchmark),
known AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM words) UNION SELECT p_name FROM part)"""
TERM_MENTIONS_SQL = f"""{KNOWN_SQL}, low AS MATERIALIZED (SELECT doc_id, source, lower(text) AS low FROM documents),
tokens AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(regexp_extract_all(low, '[a-z0-9_]+'))) AS token FROM low),
keyed AS (SELECT term, regexp_extract(term, '^[^a-z0-9_]*([a-z0-9_]+)', 1) AS first, regexp_extract(term, '([a-z0-9_]+)[^a-z0-9_]*$', 1) AS last FROM known),
held AS MATERIALIZED (SELECT DISTINCT low.doc_id, term, source FROM keyed JOIN tokens a ON a.token = first JOIN tokens b ON b.token = last AND b.doc_id = a.doc_id JOIN low ON low.doc_id = a.doc_id
  WHERE contains(low, term) AND regexp_matches(low, '\\b' || term || '\\b'))"""


def held_terms(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, term and further columns of documents: which texts name which known terms."""
    d = table(spark, sf_dir, "documents")
    if not more:
        return terms.find(d, known_terms(spark, sf_dir)).filter("bounded").select("doc_id", "term")
    # the columns travel through the pass as a part of the key, so no join follows
    keyed = d.select(F.to_json(F.struct("doc_id", *more)).alias("key"), "text")
    found = terms.find(keyed, known_terms(spark, sf_dir), "key").filter("bounded")
    row = F.from_json("key", d.select("doc_id", *more).schema)
    return found.select(row.alias("d"), "term").select("d.*", "term")


@query()
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all texts, known terms included: SQL for them would be the operator over again, so tests have brute force."""
    found = extract.entities(table(spark, sf_dir, "documents"), known=known_terms(spark, sf_dir))
    return found.withColumn("context_terms", F.array_join("context_terms", "|"))

"""Text functions, search without an index, parsing and chunking over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.plans.registry import query
from textlode.sources.tables import table


@query("""SELECT doc_id, ceil(length(text) / 3.8::DOUBLE)::BIGINT AS tokens, ceil(length(text) / 4.0::DOUBLE)::BIGINT AS tokens4,
  regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS normal, substr(sha256(substr(trim(lower(text)), 1, 100)), 1, 16) AS prefix_hash FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.estimate_tokens(t).alias("tokens"), T.estimate_tokens(t, 4.0).alias("tokens4"), T.normalize(t).alias("normal"), T.hash_prefix(t, 100).alias("prefix_hash"),
    )


@query("""SELECT page_id, list_distinct(list_filter(list_concat([regexp_extract(lower(url), '\\.([a-z0-9]+)$', 1)],
    CASE WHEN len(p) > 1 THEN p[greatest(len(p) - 2, 1) : greatest(len(p) - 2, 1) + least(2, len(p) - 1) - 1] ELSE [] END),
    lambda t: length(t) BETWEEN 2 AND 29 AND t NOT IN ('src', 'docs', 'index', 'tmp', 'www'))).list_sort() AS tags,
  regexp_extract(url, '[^/]*$') AS file
FROM (SELECT page_id, url, list_filter(regexp_split_to_array(lower(url), '[/\\\\]+'), lambda x: x <> '') AS p FROM pages)""")
def auto_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sort_array(T.auto_tags(F.col("url"))).alias("tags"), T.file_name(F.col("url")).alias("file"))


@query("""SELECT conv_id, turn, CASE WHEN pos > 0 THEN (CASE WHEN greatest(pos - 25, 0) > 0 THEN '...' ELSE '' END)
    || substr(text, greatest(pos - 25, 0) + 1, least(length(text), pos - 1 + 7 + 40) - greatest(pos - 25, 0))
    || (CASE WHEN least(length(text), pos - 1 + 7 + 40) < length(text) THEN '...' ELSE '' END)
  WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS snippet
FROM (SELECT *, instr(lower(text), 'version') AS pos FROM conversations)""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.fallback_snippet(F.col("text"), ["version"]).alias("snippet"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND NOT contains(text, '%')")
def like_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term must be contained; no wildcards, so nothing needs an escape."""
    c = table(spark, sf_dir, "conversations")
    has = F.forall(F.array(F.lit("the"), F.lit("and")), lambda t: F.contains(F.lower("text"), t))
    return c.filter(has & ~F.contains("text", F.lit("%"))).select("conv_id", "turn")


@query("SELECT doc_id, regexp_extract(text, '[0-9]+\\.[0-9]+', 0) AS match FROM documents WHERE regexp_matches(text, '[0-9]+\\.[0-9]+')")
def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, pattern = table(spark, sf_dir, "documents"), "[0-9]+\\.[0-9]+"
    return d.filter(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 0).alias("match"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND user_id IN (1, 2, 3, 5, 8, 13) AND event_type = 'click'")
def time_range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    span = "ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-12 00:00:00'"
    return e.filter(span).filter(F.col("user_id").isin(1, 2, 3, 5, 8, 13) & (F.col("event_type") == "click")).select("event_id", "user_id")


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
  len(regexp_extract_all(html, '(?i)<h[1-6][^>]*>')) AS headings FROM pages""")
def html_title_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    title = F.nullif(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return p.select("page_id", title.alias("title"), F.regexp_count("html", F.lit("(?i)<h[1-6][^>]*>")).cast("long").alias("headings"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k')::INT < 10")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.filter(F.col("k").cast("int") < 10)


@query("""SELECT conv_id, turn, CASE WHEN prev IS NULL THEN text ELSE array_to_string(
    string_split(prev, chr(10))[-(greatest(1, least(102, floor(0.3::DOUBLE * len(string_split(prev, chr(10))))::INT))) :], chr(10)) || chr(10) || text END AS chunk
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlode.operators.chunking import with_overlap

    c = table(spark, sf_dir, "conversations")
    return with_overlap(c, ["conv_id"], "turn", "text").select("conv_id", "turn", F.col("overlapped").alias("chunk"))


@query("""SELECT g AS chunk, 'rows ' || (g * 20 + 1) || '-' || (g * 20 + count(*)) AS prefix,
  'p_partkey | p_name' || chr(10) || string_agg(p_partkey || ' | ' || p_name, chr(10) ORDER BY p_partkey) AS text
FROM (SELECT *, p_partkey // 20 AS g FROM part) GROUP BY g""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlode.operators.chunking import table_groups

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.concat_ws(" | ", F.col("p_partkey").cast("string"), "p_name").alias("line"))
    return table_groups(p, "p_partkey | p_name", 20)


@query()
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlode.operators.chunking import chunk_texts

    return chunk_texts(table(spark, sf_dir, "documents"))


#: A document of each kind that has a strategy, as SQL over the tables: conversations in Markdown, nations as CSV, parts as code.
DOCUMENTS = {
    "markdown": """SELECT concat('conversation ', conv_id) AS doc_id, 'markdown' AS kind, concat('# Conversation ', conv_id, '\\n\\n', array_join(transform(
        array_sort(collect_list(struct(turn, role, text))), x -> concat('## ', x.role, ' ', x.turn, '\\n\\n', x.text)), '\\n\\n')) AS text FROM conversations GROUP BY conv_id""",
    "csv": """SELECT concat('region ', n_regionkey) AS doc_id, 'csv' AS kind, concat('key,name\\n', array_join(transform(
        array_sort(collect_list(struct(n_nationkey, n_name))), x -> concat(x.n_nationkey, ',', x.n_name)), '\\n')) AS text FROM nation GROUP BY n_regionkey""",
    "code": """SELECT concat('brand ', p_brand) AS doc_id, 'code' AS kind, concat('import prices\\n\\n', array_join(transform(array_sort(collect_list(struct(p_partkey, p_name, p_size))),
        x -> concat('def part_', x.p_partkey, '():\\n    name = "', x.p_name, '"\\n    return prices.of(name, ', x.p_size, ')\\n')), '\\n')) AS text FROM part GROUP BY p_brand""",
    "text": "SELECT concat('document ', doc_id) AS doc_id, 'text' AS kind, text FROM documents",
}


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of document through its own strategy, then merged and overlapped. Held against a plain loop in the tests."""
    from textlode.operators.chunking import chunk_documents
    from textlode.sources.parsers import html_documents

    tables = {n: table(spark, sf_dir, n) for n in ("conversations", "nation", "part", "documents")}
    marks = F.lit(None).cast("array<struct<start:int,end:int,level:int>>")
    found = html_documents(table(spark, sf_dir, "pages")).select(F.concat(F.lit("page "), "page_id").alias("doc_id"), F.lit("html").alias("kind"), "text", "headings")
    for sql in DOCUMENTS.values():
        name = sql.split(" FROM ")[-1].split()[0]
        found = found.unionByName(spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=tables[name]).withColumn("headings", marks))
    return chunk_documents(found)


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textlode.sources.parsers import parse_html

    return parse_html(table(spark, sf_dir, "pages"))


#: What is said after a turn, by its number, so that signals of each kind occur.
SAID = (
    "", "Actually, use the other one.", "We changed our mind about this", "I think it might work", "For now keep it", "We prefer short answers", "Please never send it",
    "Starting next week we move", "Finish it by Friday", "It is a blocker, it depends on the build", "This is urgent", "Is that so?", "No, not that", "Forget about it until June",
)
SIGNALS = {"correction": T.CORRECTIONS, "uncertainty": T.UNCERTAINTIES, "preference": T.PREFERENCES, "effective": T.EFFECTIVE, "expiry": T.EXPIRY}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def first_sql(patterns: tuple[str, ...]) -> str:
    return "trim(coalesce(" + ", ".join(f"nullif(regexp_extract(said, {quoted(p)}, 0), '')" for p in patterns) + "))"


@query(f"""WITH said AS (SELECT conv_id, turn, role, text || ' ' || ([{', '.join(map(quoted, SAID))}])[1 + (conv_id + turn) % {len(SAID)}] AS said FROM conversations)
SELECT conv_id, turn, {', '.join(f'{first_sql(p)} AS {name}' for name, p in SIGNALS.items())},
  CASE WHEN regexp_matches(lower(said), {quoted(T.BLOCKED)}) THEN 8 WHEN regexp_matches(lower(said), {quoted(T.URGENT)}) THEN 7
    WHEN {first_sql(T.EXPIRY)} IS NOT NULL THEN 6 WHEN role = 'user' THEN 4 WHEN regexp_matches(lower(said), {quoted(T.ASKED)}) THEN 3 ELSE 4 END AS priority FROM said""")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with a phrase after it: its signals, and its urgency as a task (of users) or another kind of loop."""
    phrase = F.get(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % len(SAID)).cast("int"))
    c = table(spark, sf_dir, "conversations").withColumn("said", F.concat_ws(" ", "text", phrase))
    found = {name: T.first_signal(F.col("said"), patterns) for name, patterns in SIGNALS.items()}
    kind = F.when(F.col("role") == "user", "task").otherwise("question")
    return c.select("conv_id", "turn", *(v.alias(k) for k, v in found.items()), T.loop_priority(F.col("said"), kind, found["expiry"]).alias("priority"))


@query("""SELECT event_id, 'claim::' || event_type || '::' || CASE WHEN event_id % 2 = 0 THEN 'database' ELSE 'uses' END AS claim_key, 'entity::user::u' || user_id AS entity_key,
  'relation::u' || user_id || '::uses::' || event_type AS relation_key, 'decision::' || substr(sha256(substr(props, 1, 200)), 1, 16) AS decision_key FROM events""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user, kind = F.concat(F.lit("U"), F.col("user_id").cast("string")), F.col("event_type")
    key = lambda k, *parts: T.canonical_key(F.lit(k), *parts)
    return e.select(
        "event_id", key("claim", kind, F.lit(" Built  with "), F.lit("v"), F.when(F.col("event_id") % 2 == 0, "DB Technology")).alias("claim_key"),
        key("entity", user, F.lit("User"), F.lit("v")).alias("entity_key"),
        key("relation", user, F.lit("runs on"), kind).alias("relation_key"), key("decision", kind, kind, F.col("props")).alias("decision_key"),
    )


#: Texts of other scripts, and one of none, that stand in for some documents.
SCRIPTS = ("汉语文本没有空格", "русский текст", "هذا نص عربي", "12345 67890 ---")
SCRIPT_RANGES = {"en": "a-zA-Z", "zh": "一-鿿", "ar": "؀-ۿ", "ru": "Ѐ-ӿ", "ko": "가-힯", "hi": "ऀ-ॿ"}


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 < {len(SCRIPTS)} THEN ([{', '.join(map(quoted, SCRIPTS))}])[1 + doc_id % 7] ELSE text END AS text FROM documents),
shares AS (SELECT doc_id, {', '.join(f"length(regexp_replace(text, '[^{r}]', '', 'g')) / greatest(length(text), 1) AS {k}" for k, r in SCRIPT_RANGES.items())} FROM t)
SELECT doc_id, CASE WHEN greatest({', '.join(SCRIPT_RANGES)}) < 0.1 THEN 'unknown' {' '.join(f"WHEN {k} = greatest({', '.join(SCRIPT_RANGES)}) THEN '{k}'" for k in SCRIPT_RANGES)} END AS script FROM shares""")
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    other = F.get(F.array(*map(F.lit, SCRIPTS)), (F.col("doc_id") % 7).cast("int"))
    return d.select("doc_id", T.script_language(F.when(F.col("doc_id") % 7 < len(SCRIPTS), other).otherwise(F.col("text"))).alias("script"))


ITEMS_SQL = "(SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000, regexp_replace(text, '^\\S+\\s+\\S+\\s+', '') FROM benchmark WHERE item_id % 3 = 0)"


@query(f"""WITH items AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS words FROM {ITEMS_SQL})
SELECT a.item_id AS a, b.item_id AS b FROM items a JOIN items b ON a.item_id < b.item_id
  WHERE len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) >= 0.6""")
def word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the fixed benchmark items, some of which stand a second time without their front, by shared words: words meet by equality, sizes give the union."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    cut = items.filter("item_id % 3 = 0").select(F.col("item_id") + 1000, F.regexp_replace("text", "^\\S+\\s+\\S+\\s+", ""))
    b = items.union(cut).select("item_id", F.array_distinct(F.split(F.lower("text"), "\\s+")).alias("words"))
    each = b.select("item_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    left, right = each.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "word"), each.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "word")
    common = left.join(right, "word").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return common.filter(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) >= 0.6).select("a", "b")

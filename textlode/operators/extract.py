"""Extraction of entities, claims, decisions, open loops, invariants and relations by patterns.

All patterns run as column expressions over whole texts; code is taken out first.
Null and empty texts give no rows, repeated rows give repeated results for their
key (which the de-duplicating functions join), and a table without rows none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import filters, terms

#: Fixed values, from here to the next comment: what opens a statement, and what it holds.
EXPLICIT = r"(?im)^\s*(?:remember(?:\s+\w+)?|note(?:\s+\w+)?|fyi|important|keep\s+in\s+mind|fact|observation|key\s+point|critical|essential|must\s+remember|don'?t\s+forget)\s*:\s*(.+)"
UNREAL = r"(?i)\b(don'?t store|example only|just kidding|not real|hypothetical|just an example|ignore this)\b"
STATED = r"(?i)^(.+?)\s+(?:is|are|was|has|have|owns|uses|runs|manages|depends|requires|needs|expires|rotates|must|should|cannot|never)\s+(.+)$"
FIRST_PERSON = r"(?i)^(?:i|my|me|we|our)$"
COLON = r"^(.+?):\s+(.+)$"
CONSTRAINT = r"(?i)^(never|always|do\s+not|don't)\s+(.+)$"
HEADED = r"(?m)^(#{1,6})\s+(.+)\n((?:[\t ]*[-*]\s+.+(?:\n|$))+)"
BULLET = r"^[\t ]*[-*]\s+(\w[\w\s]*?):\s*(.+)"
FRONT = r"^---\n([\s\S]*?)\n---"
FRONT_LINE = r"^(\w[\w\s-]*?):\s*(.+)$"
FRONT_SKIPPED = r"(?i)^(title|date|draft|layout|template|slug|permalink)$"
NARRATIVE = (
    r"(?m)(?:^|\.\s+)([A-Z][\w\s-]{1,30})\s+is\s+(?:a|the|an)\s+(.{5,80}?)(?:\.|$)",
    r"(?im)(?:^|\.\s+)(?:the\s+)?(?:lead|owner|maintainer)\s+is\s+([A-Z][\w\s]{2,30})(?:\.|,|$)",
    r"(?m)([A-Z][\w\s]{2,30})\s+(?:leads?|owns?|manages?|maintains?|runs?)\s+([A-Z][\w\s]{2,40})(?:\.|,|$)",
    r"(?m)([A-Z][\w\s]{2,30})\s+(?:depends?\s+on|relies?\s+on|uses?|requires?)\s+([A-Z][\w\s]{2,40})(?:\s+for\s+(.{3,40}))?(?:\.|,|$)",
    r"(?im)(?:^|\.\s+)(?:it\s+)?runs\s+on\s+([\w-]{3,30})\s+at\s+([\d.]{7,15})(?:\.|,|$)",
    r"(?im)([A-Z][\w\s]{2,20})\s+(?:on|uses)\s+port\s+(\d{2,5})",
    r"(?m)([A-Z][\w\s]{2,20})\s+(?:handles?|processes?)\s+(?:the\s+)?(.{5,60}?)(?:\.|,|$)",
)
NARRATIVE_GROUPS = (2, 1, 2, 3, 2, 2, 2)
NARRATIVE_VERB = r"(?i)\b(leads?|owns?|manages?|maintains?|depends?\s+on|relies?\s+on|uses?|requires?|handles?|processes?|runs?\s+on)\b"
NO_SUBJECTS = ("it", "this", "that", "the", "we", "i", "he", "she", "they", "both")
DECISION = r"(?im)^\s*(?:we(?:'ve)?\s+decided|decision|decided|we\s+chose|we(?:'re)?\s+going\s+(?:to|with)|we\s+agreed|agreed\s+(?:to|upon|that)|choosing|going\s+with)\s*(?:to|that|:)?\s*(.+)"
CHOSEN_FOR = r"(?i)(?:use|switch\s+to|adopt|go\s+with|migrate\s+to)\s+(.+?)\s+(?:for|instead\s+of|as|over)\s+(.+)"
CHOSEN = r"(?i)(?:use|switch\s+to|adopt|go\s+with|migrate\s+to)\s+(.+)"
TOPIC_STOP = ("to", "the", "a", "an", "all", "our", "by", "for", "and", "or", "that", "this", "with")
LOOP = r"(?im)^\s*(?:task|todo|remind(?:er|\s+me)|action\s*item|open\s*(?:task|item|question)|follow[\s-]?up|next\s+step|pending|blocker|action|question|need\s+to)\s*:\s*(.+)"
LOOP_KINDS = (("blocker", "dependency", 8), ("urgent", "task", 7), ("question", "question", 3), ("follow", "follow_up", 2), ("remind", "follow_up", 2), ("next step", "follow_up", 2))
INVARIANTS = (
    (r"(?i)\b(?:never|must\s+not|must\s+never|do\s+not\s+ever)\s+(.{5,200})", "critical", "strict"),
    (r"(?i)\b(?:you\s+must|must\s+always|always\s+must|always\s+ensure|always\s+verify|always\s+check)\s+(.{5,200})", "error", "strict"),
    (r"(?i)\b(?:should\s+not|shouldn't|avoid)\s+(.{5,200})", "warning", "advisory"),
    (r"(?i)\byou\s+should\s+(?:always\s+)?(.{5,200})", "info", "advisory"),
    (r"(?i)\bprefer\s+to\s+(.{5,200})", "info", "advisory"),
    (r"(?i)\b(?:rule|constraint|invariant):\s*(.{5,200})", "error", "strict"),
)
CAPITALISED = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![A-Za-z0-9_])"
QUOTED = '["“]([^"”]{2,50})["”]'
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
OPENINGS = (
    "the", "this", "that", "these", "those", "here", "there", "what", "which", "where", "when", "while", "because", "since", "however", "therefore",
    "although", "please", "thank",
)
NOT_QUOTED = (r"^[/\\.]", r"^https?://", r"^[{\[<]", r"(?i:\.(ts|js|py|go|rs|json|yaml|yml|md|txt|html|css|sh)$)", r"^[a-z]+[A-Z]", r"^[a-z]+_[a-z]")
TRUST = {"tool_result": 1.0, "user_explicit": 0.9, "document": 0.7, "extraction": 0.5, "compaction": 0.3, "inference": 0.2, "message": 0.6, "narrative": 0.6}
UNCERTAIN_SHARE = 0.5
DISTRUSTED = r"(?i)^(i'?m not sure|hypothetical|these are examples|don'?t store|testing|just brainstorming)"
HYPOTHETICAL = r"(?i)\b(what if|for example|like if|suppose|hypothetically|could potentially)\b"
SARCASTIC = r"(?i)\b(obviously|definitely|surely|clearly)\b.*\b(magic|unicorn|fairy|impossible|never)\b"
PREDICATE_TOPICS = {
    "uses": "technology", "runs_on": "technology", "powered_by": "technology", "built_with": "technology", "reports_to": "manager", "manages": "manager",
    "works_under": "manager", "status": "status", "health": "status", "located_at": "location", "based_in": "location", "lives_in": "location",
    "region": "location", "owns": "ownership", "works_at": "employer", "married_to": "spouse", "name": "name", "works_with": "collaborator", "port": "port",
    "version": "version",
}
#: What stands between two names, and the relation that it states; the first that matches counts.
VERBS = (
    (r"\bis\s+(?:the\s+)?(?:a\s+)?backup\s+(?:server\s+)?(?:for|of)\b", "backup_for"), (r"\bbacks?\s+up\b", "backup_for"),
    (r"\bdepends?\s+on\b", "depends_on"), (r"\breli(?:es|ed)\s+on\b", "depends_on"), (r"\brequires?\b", "requires"),
    (r"\bleads?\s+(?:the\s+)?", "leads"), (r"\bowns?\s+(?:the\s+)?", "owns"), (r"\bmanages?\s+(?:the\s+)?", "manages"), (r"\bmaintains?\s+(?:the\s+)?", "maintains"),
    (r"\bruns?\s+on\b", "runs_on"), (r"\bconnects?\s+to\b", "connects_to"), (r"\bdeployed\s+(?:on|to|in)\b", "deployed_on"), (r"\bhosted\s+(?:on|by|in)\b", "hosted_on"),
    (r"\bis\s+(?:a\s+)?(?:part|component|module|service|member)\s+of\b", "part_of"), (r"\bbelongs?\s+to\b", "part_of"),
    (r"\bserves?\s+(?:as\s+)?(?:the\s+)?", "serves"), (r"\bpowers?\s+(?:the\s+)?", "powers"),
    (r"\bintegrates?\s+(?:with|into)\b", "integrates_with"), (r"\bcalls?\b", "calls"), (r"\binvokes?\b", "calls"), (r"\bextends?\b", "extends"), (r"\bimplements?\b", "implements"),
    (r"\bfeeds?\s+(?:into|to)\b", "feeds"), (r"\bsends?\s+(?:to|data\s+to)\b", "sends_to"),
    (r"\bauthorizes?\b", "authorizes"), (r"\bauthenticates?\s+(?:with|via|against)\b", "authenticates_with"),
)
#: Names that relations are looked for between where no list of names is given.
NAME = "[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*"
BETWEEN = f"({NAME})((?: [a-z]+){{1,8}}) ({NAME})"


def plain(text: Column) -> Column:
    """Without fenced and inline code."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"```[\s\S]*?```", ""), "`[^`]+`", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentence(text: Column) -> Column:
    """Up to the first end of a sentence."""
    return strip(F.split(strip(text), r"[.!?]\s", 2)[0])


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _fact(subject: Column, predicate: Column, value: Column, source: str, confidence: float, kind: Column | None = None) -> Column:
    return F.struct(
        subject.alias("subject"), predicate.alias("predicate"), value.alias("object"), (F.lit("text") if kind is None else kind).alias("value_type"),
        F.lit(confidence).alias("confidence"), F.lit(TRUST[source]).alias("trust"), F.lit(source).alias("source_type"),
    )


def explicit_claims(text: Column) -> Column:
    """An array of facts: what a text asks to be remembered, by the first sentence of 3 to 300 characters."""

    def fact(said: Column) -> Column:
        stated, person = said.rlike(STATED), strip(part(said, STATED, 1)).rlike(FIRST_PERSON)
        subject = F.when(stated & person, strip(part(said, STATED, 2))).when(stated, strip(part(said, STATED, 1))).when(said.rlike(COLON), strip(part(said, COLON, 1)))
        subject = subject.when(said.rlike(CONSTRAINT), "constraint").otherwise("user_note")
        predicate = F.when(stated & person, F.concat(F.lit("user_"), F.lower(strip(part(said, STATED, 1))))).when(stated | said.rlike(COLON), "is").otherwise("states")
        value = F.when(stated & ~person, strip(part(said, STATED, 2))).when(~stated & said.rlike(COLON), strip(part(said, COLON, 2))).otherwise(said)
        return _fact(F.lower(subject), predicate, value, "user_explicit", 0.9)

    said = F.filter(F.transform(every(text, EXPLICIT, 1), sentence), lambda s: F.length(s).between(3, 300) & ~s.rlike(UNREAL))
    return F.transform(said, fact)


def listed_claims(text: Column) -> Column:
    """Facts of lists under headings: the heading is the subject of each ``- key: value``."""
    # a possessive loop gives the same blocks and needs no stack
    blocks = every(text, HEADED.replace("$))+)", "$))++)"))

    def facts(block: Column) -> Column:
        heading = strip(part(block, HEADED.replace("$))+)", "$))++)"), 2))
        lines = F.filter(F.split(block, "\n"), lambda line: line.rlike(BULLET))
        short = F.filter(lines, lambda line: (F.length(strip(part(line, BULLET, 1))) <= 50) & (F.length(strip(part(line, BULLET, 2))) <= 300))
        return F.transform(short, lambda line: _fact(F.lower(heading), F.lower(strip(part(line, BULLET, 1))), strip(part(line, BULLET, 2)), "document", 0.7))

    return F.flatten(F.transform(blocks, facts))


def front_claims(text: Column) -> Column:
    """Facts of the lines ``key: value`` between the dashes that open a text; titles, dates and layouts are none."""
    lines = F.transform(F.split(part(text, FRONT, 1), "\n"), strip)
    kept = F.filter(
        lines,
        lambda line: line.rlike(FRONT_LINE)
        & (F.length(strip(part(line, FRONT_LINE, 1))) <= 50)
        & (F.length(strip(part(line, FRONT_LINE, 2))) <= 300)
        & ~strip(part(line, FRONT_LINE, 1)).rlike(FRONT_SKIPPED),
    )
    return F.transform(kept, lambda line: _fact(F.lit("document"), F.lower(strip(part(line, FRONT_LINE, 1))), strip(part(line, FRONT_LINE, 2)), "document", 0.7))


def narrative_claims(text: Column) -> Column:
    """Facts that ordinary sentences state, pattern by pattern."""

    def facts(pattern: str, groups: int) -> Column:
        def fact(found: Column) -> Column:
            whole = strip(found)
            value = strip(part(found, pattern, 2)) if groups > 1 else whole
            if groups > 2:
                extra = strip(part(found, pattern, 3))
                value = F.when(extra != "", F.concat(value, F.lit(" for "), extra)).otherwise(value)
            verb = F.trim(F.regexp_replace(F.lower(part(whole, NARRATIVE_VERB, 1)), "s$", ""))
            return _fact(F.lower(strip(part(found, pattern, 1))), F.when(verb == "", "is").otherwise(verb), value, "narrative", 0.6)

        found = F.filter(every(text, pattern), lambda m: F.length(strip(m)).between(10, 200))
        return F.filter(F.transform(found, fact), lambda f: (F.length(f["subject"]) >= 2) & (f["object"] != "") & ~f["subject"].isin(*NO_SUBJECTS))

    return F.concat(*map(facts, NARRATIVE, NARRATIVE_GROUPS))


def claims(docs: DataFrame, key: str = "doc_id", names: tuple[str, ...] = ()) -> DataFrame:
    """key, subject, predicate, object, value_type, confidence, trust, source_type and canonical_key.

    Of facts of one text with one canonical key the most trusted stays, then the first;
    sensitive and junk facts, and those about the machinery (``names`` included), go.
    One pass over the texts gives all kinds.
    """
    text = plain(F.col("text"))
    facts = F.concat(explicit_claims(text), narrative_claims(text), listed_claims(text), front_claims(text))
    found = docs.select(F.col(key), F.posexplode(facts).alias("place", "fact")).select(key, "place", "fact.*")
    return kept_claims(found, key, names)


def kept_claims(found: DataFrame, key: str, names: tuple[str, ...] = ()) -> DataFrame:
    null = F.lit(None).cast("string")
    canonical = T.canonical_key(F.lit("claim"), F.col("subject"), F.col("predicate"), null)
    named = found.withColumn("canonical_key", F.coalesce(canonical, F.concat_ws("::", F.lit("claim"), T.normalize(F.col("subject")), T.normalize(F.col("predicate")))))
    rest = [c for c in named.columns if c not in (key, "canonical_key", "place")]
    first = named.groupBy(key, "canonical_key").agg(F.min_by(F.struct(*rest), F.struct(-F.col("trust"), F.col("place"))).alias("fact")).select(key, "fact.*", "canonical_key")
    s, p, v = F.col("subject"), F.col("predicate"), F.col("object")
    return first.filter(~(filters.is_sensitive(s, p, v) | filters.is_meta(s, v, names) | filters.is_junk(s, p, v, F.col("confidence"))))


def tool_claims(results: DataFrame, key: str = "id", tool: str = "tool", result: str = "result", depth: int = 3, items: int = 10) -> DataFrame:
    """key and a fact for each leaf of a tool's JSON result, objects down to ``depth`` levels below the top.

    The path of keys is the predicate. Of an array the objects among its first ``items``
    are walked, and its other values are none; texts of no or of 500 and more characters
    are none. What is no JSON object or array at the top, or no JSON, gives nothing.
    """
    spark, kind = results.sparkSession, F.schema_of_variant
    # one pass: rows that are not opened go through the outer explode as they are
    opening = "SELECT w.*, e.pos, coalesce(e.key, CAST(e.pos AS STRING)) AS name, e.value FROM {{w}} AS w, LATERAL variant_explode_outer(CASE WHEN w.kind IN ({0}) THEN w.v END) AS e"
    first = lambda v: F.regexp_extract(kind(v), "^[A-Z]+", 0)

    def opened(rows: DataFrame, *kinds: str) -> DataFrame:
        """Rows with the members of those of these kinds in their place: ``inside`` tells which are members, ``pos`` where they stood."""
        found = spark.sql(opening.format(", ".join(f"'{k}'" for k in kinds)), w=rows)
        inside = F.col("kind").isin(*kinds)
        path = F.when(inside, F.concat_ws(".", F.nullif("path", F.lit("")), "name")).otherwise(F.col("path"))
        found = found.filter(~inside | F.col("pos").isNotNull()).select(key, "tool", path.alias("path"), F.when(inside, F.col("value")).otherwise(F.col("v")).alias("v"), "kind", "pos", inside.alias("inside"))
        return found.withColumn("kind", F.when(F.col("inside"), first(F.col("v"))).otherwise(F.col("kind")))

    # the walk takes far longer than the reading, so that it is dealt to all tasks, however few files there are
    dealt = results.select(F.col(key), F.col(tool).alias("tool"), F.col(result).alias("result")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    found = dealt.select(key, "tool", F.lit("").alias("path"), F.try_parse_json("result").alias("v"))
    found = found.withColumn("kind", first(F.col("v"))).filter("kind IN ('OBJECT', 'ARRAY')")
    for level in range(depth + 1):
        found = opened(found, "OBJECT", "ARRAY").filter("kind <> 'VOID'").drop("pos", "inside")
        if level < depth:
            found = opened(found, "ARRAY").filter(~F.col("inside") | (F.col("pos") < items) & (F.col("kind") == "OBJECT")).drop("pos", "inside")
    found = found.filter("kind NOT IN ('OBJECT', 'ARRAY')")
    number = F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE)")
    value = F.variant_get(F.col("v"), "$", "string")
    value = F.when(number & F.contains(value, F.lit(".")), F.regexp_replace(value, r"\.?0+$", "")).otherwise(value)
    kind = F.when(number, "number").when(F.col("kind") == "BOOLEAN", "boolean").otherwise("text")
    fact = _fact(F.lower(F.trim("tool")), F.col("path"), value, "tool_result", 0.8, kind)
    facts = found.select(key, fact.alias("fact")).select(key, "fact.*").filter(F.length("object").between(1, 499))
    null = F.lit(None).cast("string")
    return facts.withColumn("canonical_key", T.canonical_key(F.lit("claim"), F.col("subject"), F.col("predicate"), null))


def decision_topic(said: Column) -> Column:
    """What a decision is about: its context, else what is chosen, else its first three words of weight."""
    about = F.regexp_replace(F.lower(strip(part(said, CHOSEN_FOR, 2))), r"^(?:the|a|an|our|my)\s+", "")
    words = F.filter(F.split(F.lower(said), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*TOPIC_STOP))
    topic = F.when(said.rlike(CHOSEN_FOR), about).when(said.rlike(CHOSEN), F.lower(strip(part(said, CHOSEN, 1)))).otherwise(F.array_join(F.slice(words, 1, 3), " "))
    return F.substring(topic, 1, 60)


def stated_decisions(text: Column) -> Column:
    said = F.filter(F.transform(every(text, DECISION, 1), sentence), lambda s: F.length(s).between(5, 300))
    return F.transform(said, lambda s: F.struct(decision_topic(s).alias("topic"), s.alias("decision")))


def stated_loops(text: Column) -> Column:
    def loop(found: Column) -> Column:
        low = F.lower(found)
        kind, priority = F.lit("task"), F.lit(4)
        for word, name, urgency in reversed(LOOP_KINDS):
            kind, priority = F.when(F.contains(low, F.lit(word)), name).otherwise(kind), F.when(F.contains(low, F.lit(word)), urgency).otherwise(priority)
        return F.struct(kind.alias("kind"), sentence(part(found, LOOP, 1)).alias("text"), priority.alias("priority"))

    return F.filter(F.transform(every(text, LOOP), loop), lambda x: F.length(x["text"]).between(5, 300))


def decisions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key), F.explode(stated_decisions(plain(F.col("text")))).alias("d")).select(key, "d.*")


def loops(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, text, priority of open tasks and questions."""
    return docs.select(F.col(key), F.explode(stated_loops(plain(F.col("text")))).alias("x")).select(key, "x.*")


def invariants(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, invariant, description, severity, enforcement: rules that texts state; of equal descriptions of a text the first pattern's stays."""

    def stated(pattern: str, severity: str, enforcement: str) -> Column:
        said = F.filter(F.transform(every(F.col("text"), pattern, 1), sentence), lambda s: F.length(s).between(5, 200))
        return F.transform(said, lambda s: F.struct(s.alias("description"), F.lit(severity).alias("severity"), F.lit(enforcement).alias("enforcement")))

    found = docs.select(F.col(key), F.posexplode(F.concat(*(stated(*i) for i in INVARIANTS))).alias("place", "i"))
    first = found.groupBy(key, F.lower("i.description").alias("low")).agg(F.min_by("i", "place").alias("i"))
    name = F.substring(F.regexp_replace("low", "[^a-z0-9]+", "_"), 1, 60)
    return first.select(key, name.alias("invariant"), "i.*")


def _name(name: Column, confidence: float, kind: str) -> Column:
    return F.struct(name.alias("name"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("entity_type"))


def named_entities(text: Column) -> Column:
    """An array of (name, confidence, entity_type): capitalised phrases .6, quoted ones .5, without what only looks like a name."""
    first = lambda n: F.split(F.lower(n), r"\s+")[0]
    names = F.filter(every(text, CAPITALISED), lambda n: ~first(n).isin(*MONTHS, *OPENINGS) & (F.length(n) >= 4))
    inner = F.filter(F.transform(every(text, QUOTED, 1), strip), lambda n: F.length(n) >= 2)
    inner = F.filter(inner, lambda n: ~n.rlike("|".join(NOT_QUOTED)))
    return F.concat(F.transform(names, lambda n: _name(n, 0.6, "possible_name")), F.transform(inner, lambda n: _name(n, 0.5, "concept")))


def entities(docs: DataFrame, key: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """key, name, confidence, entity_type and, with ``known`` (a table of terms), context_terms: the highest confidence for each name of a text.

    Known terms (.9) are found at word boundaries; context_terms are all that the text holds, at boundaries or not.
    """
    text = plain(F.col("text"))
    found = docs.select(F.col(key), F.explode(named_entities(text)).alias("e")).select(key, "e.*")
    if known is not None:
        held = terms.find(docs.select(F.col(key), text.alias("text")), known, key)
        listed = held.filter("bounded").select(key, F.col("term").alias("name"), F.lit(0.9).alias("confidence"), F.lit("user_defined").alias("entity_type"))
        found = found.unionByName(listed)
    low = strip(F.lower(F.col("name")))
    best = found.groupBy(key, low.alias("name")).agg(F.max_by("entity_type", "confidence").alias("entity_type"), F.max("confidence").alias("confidence"))
    best = best.filter("name <> ''").select(key, "name", "confidence", "entity_type")
    if known is None:
        return best
    context = held.groupBy(F.col(key).alias("of")).agg(F.array_sort(F.collect_set("term")).alias("context_terms"))
    return best.join(context, F.col(key).eqNullSafe(F.col("of")), "left").drop("of")


def relation_of(between: Column) -> Column:
    """The relation that the words between two names state, or null."""
    first, *rest = (F.when(between.rlike(f"(?i){pattern}"), name) for pattern, name in VERBS)
    return F.coalesce(first, *rest)


def relations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, subject, predicate, object: two capitalised names with words between them that state a relation."""
    found = docs.select(key, F.explode(F.regexp_extract_all(plain(F.col("text")), F.lit(BETWEEN), F.lit(0))).alias("line"))
    side = lambda n: F.regexp_extract("line", BETWEEN, n)
    named = found.select(key, F.lower(side(1)).alias("subject"), relation_of(side(2)).alias("predicate"), F.lower(side(3)).alias("object"))
    return named.filter("predicate IS NOT NULL").distinct()


def known_relations(docs: DataFrame, known: DataFrame, key: str = "doc_id", most: int = 10) -> DataFrame:
    """key, subject, predicate, object (distinct) between known names of one sentence.

    Of a sentence the ``most`` longest names that it holds count (ties in order of the
    alphabet); a pair's subject comes first, 2 to 100 characters before its object.
    """
    held = terms.find(docs.select(F.col(key), "text"), known, key).groupBy(F.col(key).alias("of")).agg(F.collect_set(F.lower("term")).alias("names"))
    said = docs.join(held, F.col(key).eqNullSafe(F.col("of"))).select(key, "names", F.explode(F.split("text", "[.!?\\n]+")).alias("line"))
    low = F.lower(F.col("line"))
    longest = F.array_sort(F.transform(F.filter("names", lambda n: F.contains(low, n)), lambda n: F.struct((-F.length(n)).alias("n"), n.alias("name"), F.instr(low, n).alias("at"))))
    said = said.filter(F.length(strip(F.col("line"))) > 10).withColumn("here", F.slice(longest, 1, most)).filter(F.size("here") > 1)

    def pairs(a: Column) -> Column:
        between = lambda b: strip(F.substring(F.col("line"), a["at"] - a["n"], b["at"] - a["at"] + a["n"]))
        after = F.filter("here", lambda b: (b["at"] > a["at"]) & F.length(between(b)).between(2, 100))
        return F.transform(after, lambda b: F.struct(a["name"].alias("subject"), relation_of(between(b)).alias("predicate"), b["name"].alias("object")))

    found = said.select(key, F.explode(F.flatten(F.transform("here", pairs))).alias("r")).select(key, "r.*")
    return found.filter("predicate IS NOT NULL").distinct()


def understood(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """What messages (key, role, text) say: key, kind, content, confidence, provisional, influence, event_type, detail, canonical_key.

    Messages that distrust themselves, and those below three characters, say nothing.
    Only users decide, claim and leave tasks; names come from all. Uncertain words halve
    the trust of decisions and claims and make them provisional. Hypothetical and sarcastic
    contents go. A time that is named is noted behind contents that lack it.
    """
    text, code, user = F.col("text"), plain(F.col("text")), F.col("role") == "user"
    signal = {name: T.first_signal(text, patterns) for name, patterns in (("correction", T.CORRECTIONS), ("uncertainty", T.UNCERTAINTIES), ("preference", T.PREFERENCES))}
    effective, expiry = T.first_signal(text, T.EFFECTIVE), T.first_signal(text, T.EXPIRY)
    time = F.coalesce(F.concat(F.lit("temporal_effective: "), effective), F.concat(F.lit("temporal_expiry: "), expiry))
    heard = messages.filter((F.length(strip(text)) >= 3) & ~strip(text).rlike(DISTRUSTED))
    heard = heard.select(key, "text", user.alias("user"), code.alias("code"), *(c.alias(n) for n, c in signal.items()), time.alias("time"), F.coalesce(effective, expiry).alias("when"))
    unsure, preferred, corrects = F.col("uncertainty").isNotNull(), F.col("preference").isNotNull(), F.col("correction").isNotNull()
    null, none = F.lit(None).cast("string"), F.array().cast("array<struct<kind:string,content:string,subject:string,predicate:string,topic:string,confidence:double,provisional:boolean,influence:string,event_type:string>>")

    def item(kind: str, content: Column, subject: Column, predicate: Column, topic: Column, confidence: Column, provisional: Column, influence: Column, event: Column) -> Column:
        values = {"kind": F.lit(kind), "content": content, "subject": subject, "predicate": predicate, "topic": topic, "confidence": confidence, "provisional": provisional, "influence": influence, "event_type": event}
        return F.struct(*(v.alias(n) for n, v in values.items()))

    standard, event = F.lit("standard"), F.when(preferred, "preference").when(corrects, "correction").otherwise("fact_assertion")
    sure = F.when(unsure, TRUST["user_explicit"] * UNCERTAIN_SHARE).otherwise(0.9)
    topics = F.create_map(*(F.lit(x) for pair in PREDICATE_TOPICS.items() for x in pair))
    decided = F.transform(stated_decisions(F.col("text")), lambda d: item("decision", d["decision"], null, null, d["topic"], sure, unsure, F.lit("high"), F.when(corrects, "correction").otherwise("decision")))
    claimed = F.transform(
        explicit_claims(F.col("text")),
        lambda c: item("claim", F.concat(c["subject"], F.lit(" "), c["predicate"], F.lit(": "), c["object"]), c["subject"], c["predicate"], F.try_element_at(topics, T.normalize_predicate(c["predicate"])), sure, unsure, F.when(preferred, "high").otherwise("standard"), event),
    )
    left = F.transform(stated_loops(F.col("text")), lambda x: item("loop", x["text"], null, null, null, F.lit(0.8), F.lit(False), standard, F.when(x["kind"] == "follow_up", "reminder").otherwise("task")))
    named = F.transform(named_entities(F.col("code")), lambda e: item("entity", e["name"], strip(F.lower(e["name"])), e["entity_type"], null, e["confidence"], F.lit(False), standard, null))
    said = heard.withColumn("o", F.explode(F.concat(F.when(F.col("user"), F.concat(decided, claimed, left)).otherwise(none), named)))
    # of a name that occurs more than once in a message, the best counts
    place = Window.partitionBy(key, "text", "o.kind", "o.subject").orderBy(F.desc("o.confidence"), "o.content")
    said = said.withColumn("n", F.when(F.col("o.kind") == "entity", F.row_number().over(place)).otherwise(1)).filter("n = 1")
    said = said.filter(~F.col("o.content").rlike(HYPOTHETICAL) & ~F.col("o.content").rlike(SARCASTIC))
    noted = F.col("time").isNotNull() & ~F.contains("o.content", F.col("when"))
    content = F.when(noted, F.concat("o.content", F.lit(" ["), "time", F.lit("]"))).otherwise(F.col("o.content"))
    detail = F.when(corrects, F.concat(F.lit("correction_signal: "), "correction"))
    canonical = T.canonical_key(F.col("o.kind"), F.col("o.subject"), F.col("o.predicate"), F.col("o.content"), F.col("o.topic"))
    return said.select(key, "o.kind", content.alias("content"), "o.confidence", "o.provisional", "o.influence", "o.event_type", detail.alias("detail"), canonical.alias("canonical_key"))



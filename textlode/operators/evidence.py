"""Bundles of evidence: what a scope knows, and what several sources know of a question.

Lists are limited for each scope or question before they are gathered, so a row
holds a bounded number of lines; budgets run over these lines in order, inside the
row. A scope or question without lines gives no row, a null confidence comes last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import index as ix
from textlode.operators.search import small
from textlode.sources.shared import durable, stored

#: Sections of a scope's bundle in order, with their limits, and the characters after which it ends.
LIMITS = (("claim", "Claims:", 15), ("decision", "Decisions:", 10), ("loop", "Open Loops:", 10), ("invariant", "Invariants:", 10), ("anti_runbook", "Anti-Runbooks (avoid):", 5))
MOST_CHARS, CUT = 12_000, "\n[... truncated]"
SEVERITY = ("critical", "error", "warning", "info")
#: Sections of an answer, in order.
RESOLVED = "Note: Resolved Facts/Entities/Relations/Decisions are the authoritative current state. Conversation History shows what was discussed — it may contain outdated or superseded information.\n\n"
HEADERS = {
    "claims": "[Resolved Facts — current state]\n", "decisions": "[Active Decisions]\n", "entities": "[Entities]\n", "relations": "[Relations — entity connections]\n",
    "relationships": "[Relationships — from claims]\n", "summaries": "[Conversation History — may contain outdated info]\n",
    "messages": "[Conversation History — may contain outdated info]\n", "documents": "[From Documents]\n",
}


def rounded(confidence: Column) -> Column:
    return F.format_string("%.2f", confidence.cast("double"))


def standing(objects: DataFrame) -> DataFrame:
    """Active rows with first and second, by which those of a kind stand in a scope (ascending); ties go by id."""
    kind, newest = F.col("kind"), -F.col("created_at").cast("timestamp").cast("double")
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(float(i))) for i, s in enumerate(SEVERITY)), F.lit(float(len(SEVERITY))))
    first = F.when(kind == "decision", newest).when(kind == "loop", -F.coalesce(F.col("priority"), F.lit(0)).cast("double")).when(kind == "invariant", rank).otherwise(-F.col("confidence").cast("double"))
    second = F.when(kind == "loop", -newest).when(kind == "decision", -F.col("id").cast("double")).otherwise(newest)
    return objects.filter("status = 'active'").withColumn("first", F.coalesce(first, F.lit(float("inf")))).withColumn("second", second)


def foremost(objects: DataFrame, limits: dict[str, int], by: list[str]) -> DataFrame:
    """The first rows of each kind within ``by``, as many as ``limits`` say, with their place: one pass for all kinds."""
    most = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in limits.items()))
    ranked = standing(objects.filter(F.col("kind").isin(*limits))).withColumn("place", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("first", "second", "id")))
    return ranked.filter(F.col("place") <= max(limits.values())).filter(F.col("place") <= most)


def bundles(objects: DataFrame) -> DataFrame:
    """scope_id, evidence: the sections of each scope's active knowledge, cut after MOST_CHARS characters."""
    kept = foremost(objects, {k: n for k, _, n in LIMITS}, ["scope_id"])
    lines = {
        "claim": F.concat("subject", F.lit(" "), "predicate", F.lit(": "), F.coalesce("object", F.lit("?")), F.lit(" (confidence: "), rounded(F.col("confidence")), F.lit(")")),
        "decision": F.concat("subject", F.lit(": "), "content"),
        "loop": F.concat(F.lit("["), "event_type", F.lit("] "), "content", F.lit(" (priority: "), "priority", F.lit(")")),
        "invariant": F.concat(F.lit("["), "severity", F.lit("] "), "content"),
        "anti_runbook": F.concat("content", F.lit(" ("), "failures", F.lit(" failures)")),
    }
    line = F.concat(F.lit("  - "), F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in lines.items())))
    section = F.coalesce(*(F.when(F.col("kind") == k, i) for i, (k, _, _) in enumerate(LIMITS)))
    said = kept.groupBy("scope_id", section.alias("section")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    head = F.get(F.array(*(F.lit(h) for _, h, _ in LIMITS)), F.col("section"))
    said = said.select("scope_id", "section", F.concat_ws("\n", head, F.transform("lines", lambda x: x["line"])).alias("text"))
    whole = said.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    return whole.select("scope_id", F.when(F.length(text) > MOST_CHARS, F.concat(F.substring(text, 1, MOST_CHARS), F.lit(CUT))).otherwise(text).alias("evidence"))


def budgeted(sections: DataFrame, budget: int) -> DataFrame:
    """query_id, answer, sources, n_sections: lines of sections (query_id, section, name, header, needs, lines) within one budget.

    A line costs a token for four characters. A section takes lines until one does not
    fit, and then its header's cost, which may overdraw; one that needs more than is left is passed over.
    Later sections have what earlier ones left. A section named like one that stands already (before a slash) is passed over.
    """
    ordered = sections.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("section", "name", "header", "needs", "lines"))).alias("sections"))
    line0 = F.struct(F.lit(0).cast("long").alias("left"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("lines"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("texts"))
    cost = lambda c: T.estimate_tokens(c, 4.0)

    def line(state: Column, text: Column) -> Column:
        fits = ~state["full"] & (cost(text) <= state["left"])
        taken = F.struct((state["left"] - cost(text)).alias("left"), F.lit(False).alias("full"), F.array_append(state["lines"], text).alias("lines"))
        return F.when(fits, taken).otherwise(state.withField("full", F.lit(True)))

    def section(state: Column, s: Column) -> Column:
        open_ = (state["left"] > s["needs"]) & ~F.array_contains(state["names"], F.element_at(F.split(s["name"], "/"), 1))
        name = F.element_at(F.split(s["name"], "/"), -1)
        taken = F.aggregate(s["lines"], line0.withField("left", state["left"]), line)
        kept = F.struct(
            (taken["left"] - cost(s["header"])).alias("left"), F.array_append(state["names"], name).alias("names"),
            F.array_append(state["texts"], F.concat(s["header"], F.array_join(taken["lines"], "\n"))).alias("texts"),
        )
        return F.when(open_ & (F.size(taken["lines"]) > 0), kept).otherwise(state)

    done = ordered.select("query_id", F.aggregate("sections", start, section).alias("s")).filter(F.size("s.texts") > 0)
    resolved = F.arrays_overlap("s.names", F.array(*map(F.lit, ("claims", "decisions", "entities", "relations", "relationships"))))
    both = resolved & F.arrays_overlap("s.names", F.array(F.lit("summaries"), F.lit("messages")))
    answer = F.concat(F.when(both, RESOLVED).otherwise(""), F.array_join("s.texts", "\n\n"))
    return done.select("query_id", answer.alias("answer"), F.array_join("s.names", ",").alias("sources"), F.size("s.texts").alias("n_sections"))


@dataclass(frozen=True)
class History:
    """Turns to search: (msg_id, text, created), their index, and the name of their section."""

    name: str
    turns: DataFrame
    index: ix.Index


def foremost_holders(index: ix.Index, terms: DataFrame, rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``rows`` (id, part, first, second, more) that hold every term of a query, as many of a part as ``limits`` say: query_id, place and the rows' columns.

    Rows that hold the same of all asked terms are found by the same queries, so of each such set only the
    first of a part can be wanted; queries of the same terms are answered once. Sets meet queries, rows do not.
    """
    terms = durable(terms)
    wanted = terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("wanted"))
    most = F.coalesce(*(F.when(F.col("part") == part, n) for part, n in limits.items()))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by, "part").orderBy("first", "second", "id"))
    held = ix.hits(index, terms).groupBy("doc").agg(F.array_sort(F.collect_set("term")).alias("held"))
    kept = rows.join(held, F.col("id") == F.col("doc")).drop("doc").withColumn("place", first("held"))
    kept = stored(kept.filter(F.col("place") <= max(limits.values())).filter(F.col("place") <= most).drop("place"))
    sets = kept.select("held").distinct().withColumn("term", F.explode("held"))
    asked = wanted.select("wanted", F.element_at("wanted", 1).alias("term")).distinct()
    met = sets.join(asked, "term").filter(F.size(F.array_except("wanted", "held")) == 0).select("wanted", "held")
    found = met.join(kept, "held").withColumn("place", first("wanted")).filter(F.col("place") <= max(limits.values())).filter(F.col("place") <= most)
    return wanted.join(found.drop("held"), "wanted").drop("wanted")


def federated(queries: DataFrame, objects: DataFrame, index: ix.Index, histories: list[History] | None = None, documents: DataFrame | None = None, budget: int = 900) -> DataFrame:
    """What claims, decisions, entities, relations and conversations know of each query (query_id, query, scope_id), within one budget.

    ``index`` holds the objects' contents by id; objects must hold every word above two
    characters. Relations are the first 30 of the query's scope, those with more of its
    words first, twelve at most; where there are none, claims that relate. Histories follow (three
    snippets each, the newest of what their ladder finds), and where nothing else is
    known ``documents`` (query_id, text).
    """
    everyone = durable(queries.select("query_id", "query", "scope_id"))
    # a question that is asked again in its scope has the same answer
    queries = durable(everyone.groupBy("query", "scope_id").agg(F.min("query_id").alias("query_id")).select("query_id", "query", "scope_id"))
    words = F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: F.length(w) > 2)
    asked = queries.withColumn("words", words)
    terms = ix._terms(asked, F.transform(ix.words_of(F.array_join("words", " ")), ix.phrase))

    def section(rows: DataFrame, number: int, name: str, line: Column, needs: int = 0) -> DataFrame:
        lines = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        own = HEADERS[name.split("/")[-1]]
        lines = F.transform("lines", lambda x: x["line"]), lines
        return lines[1].select("query_id", F.lit(number).alias("section"), F.lit(name).alias("name"), F.lit(own).alias("header"), F.lit(needs).alias("needs"), lines[0].alias("lines"))

    relates = (F.col("kind") == "claim") & ~F.col("predicate").isin("is", "states")
    parts = F.array(F.when(F.col("kind").isin("claim", "decision", "entity"), F.col("kind")), F.when(relates, "relating"))
    known = standing(objects).withColumn("part", F.explode(F.array_compact(parts))).select("id", "part", "first", "second", "subject", "predicate", "object", "event_type", "content")
    found = stored(foremost_holders(index, terms, known, {"claim": 5, "decision": 3, "entity": 5, "relating": 5}))
    of = lambda part: found.filter(F.col("part") == part)
    dot, tie = F.lit("• "), lambda c: F.concat(F.lit("• "), "subject", F.lit(" —["), "predicate", F.lit("]→ "), c)
    made = [
        section(of("claim"), 1, "claims", F.concat(dot, "subject", F.lit(" "), "predicate", F.lit(": "), F.coalesce("object", F.lit("(empty)")))),
        section(of("decision"), 2, "decisions", F.concat(dot, "content")),
        section(of("entity"), 3, "entities", F.concat(dot, "subject", F.when(F.col("event_type").isNotNull(), F.concat(F.lit(" ("), "event_type", F.lit(")"))).otherwise(""))),
        section(of("relating"), 5, "relations/relationships", tie(F.coalesce("object", F.lit("")))),
    ]
    ranked = foremost(objects, {"relation": 30}, ["scope_id"]).select("scope_id", "id", "subject", "predicate", "object", "confidence")
    said = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    scored = asked.select("query_id", "scope_id", "words").join(ranked, "scope_id").withColumn("score", F.size(F.filter("words", lambda w: F.contains(said, w))))
    scored = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("confidence"), "id"))).filter("place <= 12")
    made.append(section(scored, 4, "relations", F.concat(tie(F.col("object")), F.lit(" (conf="), rounded(F.col("confidence")), F.lit(")"))))
    spoken = durable(queries.groupBy("query").agg(F.min("query_id").alias("query_id")).select("query_id", "query"))  # whatever the scope
    for number, history in enumerate(histories or [], 6):
        hits = ix.ladder(history.index, history.turns, spoken, key="msg_id", newest="created")
        newest = hits.join(history.turns.select(F.col("msg_id").alias("of"), "created"), F.col("doc") == F.col("of"))
        newest = newest.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created"), "doc"))).filter("place <= 3")
        shown = ix.snippets(newest.select("query_id", "step", "doc", "place"), history.turns, spoken, key="msg_id")
        shown = queries.select("query_id", "query").join(spoken.withColumnRenamed("query_id", "of"), "query").join(shown.withColumnRenamed("query_id", "of"), "of")
        made.append(section(shown, number, history.name, F.concat(dot, F.coalesce("snippet", F.lit("(no snippet)"))), 100 if number == 6 else 50))
    every = made[0]
    for one in made[1:]:
        every = every.unionByName(one)
    answers = queries.join(budgeted(every, budget).withColumnRenamed("query_id", "of"), F.col("query_id") == F.col("of")).drop("query_id", "of")
    again = [F.col(f"asked.{c}").eqNullSafe(F.col(f"known.{c}")) for c in ("query", "scope_id")]
    answered = everyone.alias("asked").join(answers.alias("known"), again).select("query_id", "answer", "sources", "n_sections")
    if documents is None:
        return answered
    answered = durable(answered)
    last = documents.join(everyone, "query_id").join(answered, "query_id", "left_anti").filter(F.trim("text") != "")
    text = F.concat(F.lit(HEADERS["documents"]), F.substring(F.trim("text"), 1, max(100, budget * 4)))
    return answered.unionByName(last.select("query_id", text.alias("answer"), F.lit("documents").alias("sources"), F.lit(1).alias("n_sections")))

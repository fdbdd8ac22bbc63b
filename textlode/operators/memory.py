"""Writes to the knowledge store, in order: upserts, decay, supersession chains, capsules.

Knowledge comes as rows (id, scope_id, kind, subject, predicate, object, event_type, confidence,
status, created_at, priority, severity, failures, content), as ``sources.tables.objects`` gives them. All
functions work on whole tables at once; a scope or key may hold any share of the rows. Tables without rows give none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.sources.shared import stored

#: How much of a confidence the new one makes, and statuses that an update finds.
NEW, OLD, OPEN = 0.7, 0.3, ("active", "needs_confirmation")
#: Updates of one key that count: what comes before weighs less than 1e-33.
LATEST = 64


def upserted(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """The table after all candidates, one by one in the order of ``arrived``: row, composite_id, canonical_key, kind, scope_id, status, confidence, content, updates, is_new.

    ``existing``: row, composite_id, canonical_key, kind, scope_id, status, confidence, content; ``candidates`` the same without row, with
    arrived (unique), supersedes (boolean) and violates (boolean). A candidate meets the row of its composite_id, else the open row of its scope,
    kind and key, else what an earlier candidate of that key made; without a key it meets only its own composite_id. Each one
    blends its confidence with the row's (0.7 and 0.3), unless it supersedes; a violation makes it wait for
    confirmation. The last one's values stay.

    A fold of blends is a sum whose weights fall with the distance from the end, so no row is folded one by one:
    the last LATEST updates of a key decide all digits, and ranks are limited before and after rows move.
    """
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.5))))
    full = F.concat_ws("\0", F.col("scope_id").cast("string"), "kind", "canonical_key")
    by_key = existing.filter(F.col("canonical_key").isNotNull() & F.col("status").isin(*OPEN)).groupBy(full.alias("of_key")).agg(F.min("row").alias("key_row"))
    by_id = existing.groupBy(F.col("composite_id").alias("of_id")).agg(F.min("row").alias("id_row"))
    name = F.when(F.col("canonical_key").isNotNull(), full)
    met = candidates.withColumn("full", name).join(by_id, F.col("composite_id") == F.col("of_id"), "left").join(by_key, F.col("full") == F.col("of_key"), "left")
    row = F.coalesce("id_row", "key_row")
    identity = F.when(row.isNotNull(), F.concat(F.lit("row:"), row.cast("string"))).when(F.col("full").isNotNull(), F.concat(F.lit("key:"), "full")).otherwise(F.concat(F.lit("id:"), "composite_id"))
    status = F.when(F.coalesce("violates", F.lit(False)), "needs_confirmation").otherwise(F.coalesce("status", F.lit("active")))
    known = met.select(
        identity.alias("identity"), row.alias("row"), "arrived", clamp(F.col("confidence")).alias("x"), F.coalesce("supersedes", F.lit(False)).alias("resets"),
        F.struct("composite_id", "canonical_key", "kind", "scope_id", status.alias("status"), "content").alias("last"),
    )
    facts = known.groupBy("identity").agg(
        F.max(F.when(F.col("resets"), F.col("arrived"))).alias("reset"), F.min("arrived").alias("first"), F.count("*").alias("updates"), F.max("row").alias("row"), F.max_by("last", "arrived").alias("last")
    )
    place = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("arrived"))) - 1
    ranked = known.select("identity", "arrived", "x").withColumn("back", place).filter(F.col("back") < LATEST)
    joined = ranked.join(facts.select(F.col("identity").alias("of"), "reset", "first", F.col("row").isNotNull().alias("has_row")), F.col("identity") == F.col("of"))
    whole = (F.col("arrived") == F.col("reset")) | (F.col("reset").isNull() & ~F.col("has_row") & (F.col("arrived") == F.col("first")))
    weight = F.when(F.col("arrived") < F.col("reset"), 0.0).otherwise(F.pow(F.lit(OLD), F.col("back")) * F.when(whole, 1.0).otherwise(NEW))
    sums = joined.groupBy("identity").agg(F.sum(F.col("x") * weight).alias("sum"))
    made = facts.join(sums, "identity").join(existing.select(F.col("row").alias("was"), clamp(F.col("confidence")).alias("before")), F.col("row") == F.col("was"), "left")
    old = F.when(F.col("reset").isNull(), F.coalesce("before", F.lit(0.0)) * F.pow(F.lit(OLD), F.col("updates"))).otherwise(0.0)
    new = made.select("row", "last.*", (F.col("sum") + old).alias("confidence"), "updates", F.col("row").isNull().alias("is_new"))
    rest = existing.join(made.select(F.col("row").alias("hit")).filter("hit IS NOT NULL"), F.col("row") == F.col("hit"), "left_anti")
    columns = ["row", "composite_id", "canonical_key", "kind", "scope_id", "status", "confidence", "content", "updates", "is_new"]
    return new.select(*columns).unionByName(rest.withColumn("updates", F.lit(0).cast("long")).withColumn("is_new", F.lit(False)).select(*columns))


#: Ages in days and what they do.
AVOID_DAYS, AVOID_WORKED, AVOID_WORKED_FLOOR, AVOID_AGED, AVOID_FLOOR = 90, 0.7, 0.3, 0.8, 0.2
RUNBOOK_DAYS, RUNBOOK_DEMOTED, RELATION_DAYS, LOOP_HOURS = 180, 0.5, 180, 72


def decayed(objects: DataFrame, worked: DataFrame, now: Column, scale: float = 1.0) -> DataFrame:
    """id, kind, confidence, status of active warnings, runbooks, loops and relations after one round of decay, steps in order.

    ``objects`` also has successes and updated_at; ``worked`` (scope_id, tool, at): successful attempts. Warnings lose where their tool
    has worked of late, others by age, and at the floor they are stale; runbooks that fail mostly lose half after half their
    days, which renews them, and are stale after all; loops are stale after 72 hours, relations after 180 days. ``scale``
    shortens all ages.
    """
    ago = lambda days: now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86_400 * scale))
    lately = worked.filter(F.col("at") > ago(AVOID_DAYS)).select(F.col("scope_id").alias("s"), F.col("tool").alias("t")).distinct()
    rows = objects.filter((F.col("status") == "active") & F.col("kind").isin("anti_runbook", "runbook", "loop", "relation"))
    rows = rows.join(lately, (F.col("scope_id") == F.col("s")) & (F.col("event_type") == F.col("t")), "left")
    kind, c, at = F.col("kind"), F.col("confidence"), F.coalesce("updated_at", "created_at")
    relieved = (kind == "anti_runbook") & F.col("t").isNotNull() & (c > AVOID_WORKED_FLOOR)
    aged = (kind == "anti_runbook") & ~relieved & (c > AVOID_FLOOR) & (at < ago(AVOID_DAYS))
    tries = F.col("successes") + F.col("failures")
    failing = (kind == "runbook") & (tries > 0) & (F.try_divide(F.col("failures"), tries) > 0.5) & (at < ago(RUNBOOK_DAYS // 2))
    left = F.when(relieved, c * AVOID_WORKED).when(aged, c * AVOID_AGED).when(failing, c * RUNBOOK_DEMOTED).otherwise(c)
    stale = (
        F.when(kind == "anti_runbook", F.col("left") <= AVOID_FLOOR).when(kind == "runbook", ~F.col("failing") & (at < ago(RUNBOOK_DAYS)))
        .when(kind == "loop", at < ago(LOOP_HOURS / 24)).otherwise(at < ago(RELATION_DAYS))
    )
    done = rows.withColumn("left", left).withColumn("failing", F.coalesce(failing, F.lit(False)))
    return done.select("id", "kind", F.col("left").alias("confidence"), F.when(stale, "stale").otherwise("active").alias("status"))


def heads(edges: DataFrame) -> DataFrame:
    """node, head, steps, cyclic of (node, next), one ``next`` a node: what each was superseded by in the end.

    Pointers double each round, so a chain of n links takes log n rounds; nodes that have arrived leave. What still moves after as
    many rounds as the table's size allows, or when a round stops nothing, is on a circle or leads to one: it has no head. Rounds are
    stored as tables, whose sizes Spark knows: its estimates of copies in memory multiply with each join, until the driver holds
    numbers of millions of digits.
    """
    links = stored(edges.filter("node IS NOT NULL AND next IS NOT NULL").groupBy("node").agg(F.min("next").alias("next")).withColumn("steps", F.lit(1).cast("long")))
    rounds = math.ceil(math.log2(max(2, links.count()))) + 1
    done, moving = [], links
    for _ in range(rounds):
        ahead = moving.select(F.col("node").alias("at"), F.col("next").alias("after"), F.col("steps").alias("more"))
        step = stored(moving.join(ahead.hint("merge"), F.col("next") == F.col("at"), "left"))
        # a node whose next one has arrived already may stop, too: its next one is looked up among the arrived below
        stopped = step.filter("at IS NULL").select("node", "next", "steps")
        if stopped.isEmpty():  # a chain of what moves would have a node that stops in this round
            break
        done.append(stopped)
        moving = step.filter("at IS NOT NULL").select("node", F.col("after").alias("next"), (F.col("steps") + F.col("more")).alias("steps"))
        if moving.isEmpty():
            break
    # ends of ends: a round's jump lands on a head or on a node that stopped in an earlier round, whose end is known by then
    arrived = links.limit(0)
    for stopped in done:
        last = arrived.select(F.col("node").alias("of"), F.col("next").alias("end"), F.col("steps").alias("rest"))
        hop = stopped.join(last.hint("merge"), F.col("next") == F.col("of"), "left")
        arrived = arrived.unionByName(stored(hop.select("node", F.coalesce("end", "next").alias("next"), (F.col("steps") + F.coalesce("rest", F.lit(0))).alias("steps"))))
    found = arrived.select("node", F.col("next").alias("head"), "steps", F.lit(False).alias("cyclic"))
    rest = links.join(arrived.select("node").hint("merge"), "node", "left_anti").select("node", F.lit(None).cast(dict(links.dtypes)["next"]).alias("head"), F.lit(None).cast("long").alias("steps"), F.lit(True).alias("cyclic"))
    return found.unionByName(rest)


#: capsules' kinds in the order of the text, and how many of each are candidates.
CAPSULES = {"anti_runbook": 5, "invariant": 5, "conflict": 5, "decision": 5, "claim": 10, "loop": 5, "delta": 5, "runbook": 5, "relation": 10}
TIERS = {"lite": 110, "standard": 190, "premium": 380}
LOW_VALUE = ("document", "user_note", "constraint", "conversation history tools", "agent", "bot")
PAST = ("renamed_to", "renamed_from", "previously", "origin", "former", "was", "used_to_be", "migrated_from", "replaced_by", "superseded_by")
SEVERITY_SCORES = {"critical": 1.0, "error": 0.9, "warning": 0.7, "info": 0.4}


def capsules(objects: DataFrame, conflicts: DataFrame, deltas: DataFrame, now: Column, budget: int = TIERS["standard"], asked: DataFrame | None = None, header: str = "[Evidence]\n") -> DataFrame:
    """scope_id, text, kinds, tokens: what each scope should be reminded of, by worth a token, within one budget.

    Of each kind the first few by confidence and time are candidates; equal texts (labels apart) count once, the best. ``conflicts``: id,
    scope_id, a, b, status, confidence, created_at (what they name is contested); ``deltas``: id, scope_id, entity, old, new, created_at;
    ``asked`` (scope_id, query): shares of the query's words that a text holds scale its worth. What does not fit is passed over. Lines
    stand by kind, then worth. ``objects`` may have successes, mentions, trust and enforcement.
    """
    optional = {"successes": 0, "mentions": 1, "trust": 1.0, "enforcement": "strict"}
    for column, value in optional.items():
        if column not in objects.columns:
            objects = objects.withColumn(column, F.lit(value))
    open_ = objects.filter(F.col("status").isin(*OPEN) & F.col("kind").isin(*CAPSULES))
    contested = conflicts.select(F.explode(F.array("a", "b")).alias("named")).distinct().withColumn("contested", F.lit(True))
    rows = open_.join(contested, F.col("id").cast("string") == F.col("named"), "left")
    days = F.greatest(F.lit(0), F.datediff(now, F.col("created_at")))
    label = T.epistemic_label(F.col("confidence"), F.coalesce("contested", F.lit(False)))
    label = F.when(label != "", F.concat(F.lit(" ["), label, F.lit("]"))).otherwise("")
    rate = F.when(F.col("successes") + F.col("failures") > 0, F.format_string("%.0f", F.round(100 * F.col("successes") / (F.col("successes") + F.col("failures"))))).otherwise("N/A")
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    s, p, o, c, content, tool = (F.col(n) for n in ("subject", "predicate", "object", "confidence", "content", "event_type"))
    texts = {
        "claim": cat("[claim] ", s, " ", p, ": ", F.coalesce(o, F.lit("(no value)")), label), "decision": cat("[decision] ", s, ": ", content, label), "loop": cat("[loop] ", content),
        "invariant": cat("[INVARIANT: ", F.when(F.col("enforcement") == "strict", "STRICT").otherwise("advisory"), "/", F.col("severity"), "] ", content),
        "anti_runbook": cat("[anti-runbook] AVOID: ", content, " (", tool, ", ", F.col("failures").cast("string"), " failures)", label),
        "runbook": cat("[runbook] ", tool, ": ", content, " (", rate, "% success)", label), "relation": cat("[relation] ", s, " ", p, " ", o, label),
    }
    severity = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITY_SCORES.items()), F.lit(0.5))
    worth = {
        "claim": T.effective_confidence(c, F.col("mentions"), days) * F.col("trust") * F.when(F.lower(F.trim(s)).isin(*LOW_VALUE), 0.2).otherwise(1.0), "decision": F.lit(0.9),
        "loop": 0.3 + F.least(F.lit(10), F.col("priority")) / 10 * 0.7, "invariant": F.when(F.col("enforcement") == "strict", 1.0).otherwise(severity), "anti_runbook": F.lit(0.95),
        "runbook": c * 0.85, "relation": c * 0.8,
    }
    choose = lambda named: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in named.items()))
    hidden = (F.col("kind") == "claim") & F.lower(F.trim(p)).isin(*PAST)
    made = rows.select("scope_id", "kind", F.col("id").alias("no"), "confidence", "created_at", choose(texts).alias("line"), choose(worth).cast("double").alias("score"), F.coalesce(hidden, F.lit(False)).alias("hidden"))
    state = F.when(F.col("status") == "active", "unresolved").otherwise(F.col("status"))
    said = cat("[conflict] ", F.col("a"), " vs ", F.col("b"), " (", state, ")")
    made = made.unionByName(conflicts.filter(F.col("status").isin(*OPEN)).select("scope_id", F.lit("conflict").alias("kind"), F.col("id").alias("no"), "confidence", "created_at", said.alias("line"), F.lit(0.85).alias("score"), F.lit(False).alias("hidden")))
    said = cat("[delta] ", F.col("entity"), ": ", F.coalesce("old", F.lit("?")), " → ", F.coalesce("new", F.lit("?")))
    made = made.unionByName(deltas.select("scope_id", F.lit("delta").alias("kind"), F.col("id").alias("no"), F.lit(None).cast("double").alias("confidence"), "created_at", said.alias("line"), F.lit(0.5).alias("score"), F.lit(False).alias("hidden")))
    place = F.row_number().over(Window.partitionBy("scope_id", "kind").orderBy(F.desc("confidence"), F.desc("created_at"), "no"))
    most = choose({k: F.lit(n) for k, n in CAPSULES.items()})
    first = made.withColumn("place", place).filter(F.col("place") <= max(CAPSULES.values())).filter((F.col("place") <= most) & ~F.col("hidden"))
    plain = F.trim(F.regexp_replace("line", r"\s*\[(FIRM|CONTESTED|PROVISIONAL)\]", ""))
    order = choose({k: F.lit(i) for i, k in enumerate(CAPSULES)})
    row = F.struct("score", (-order).alias("by"), (-F.col("place")).alias("at"), "kind", "line")
    first = first.groupBy("scope_id", plain.alias("plain")).agg(F.max(row).alias("r")).select("scope_id", "r.*")
    if asked is not None:
        words = F.filter(F.split(F.regexp_replace(F.lower("query"), r"[^\w\s]", ""), r"\s+"), lambda w: F.length(w) > 2)
        first = first.join(asked.select(F.col("scope_id").alias("of"), words.alias("words")), F.col("scope_id") == F.col("of"), "left")
        hits = F.size(F.filter("words", lambda w: F.contains(F.lower("line"), w)))
        first = first.withColumn("score", F.when(F.size("words") > 0, F.col("score") * (0.2 + 0.8 * hits / F.size("words"))).otherwise(F.col("score")))
    tokens = T.estimate_tokens(F.col("line"), 4.0)
    first = first.filter("score > 0").withColumn("tokens", tokens).withColumn("rate", F.round(F.col("score") / F.greatest(F.lit(1), tokens), 12))
    # some fifty candidates a scope
    each = first.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("rate"), (-F.col("by")).alias("by"), (-F.col("at")).alias("at"), "kind", "line", "tokens"))).alias("all"))
    spent = T.estimate_tokens(F.lit(header), 4.0)
    start = F.struct(spent.alias("spent"), F.slice("all", 1, 0).alias("kept"))
    fill = lambda state, x: F.when(state["spent"] + x["tokens"] <= budget, F.struct((state["spent"] + x["tokens"]).alias("spent"), F.array_append(state["kept"], x).alias("kept"))).otherwise(state)
    done = each.select("scope_id", F.aggregate("all", start, fill).alias("s")).filter(F.size("s.kept") > 0)
    shown = F.array_sort(F.transform("s.kept", lambda x: F.struct(x["by"].alias("by"), x["rate"].alias("rate"), x["at"].alias("at"), x["kind"].alias("kind"), x["line"].alias("line"))))
    return done.select(
        "scope_id", F.concat(F.lit(header), F.array_join(F.transform(shown, lambda x: x["line"]), "\n")).alias("text"),
        F.array_join(F.transform(shown, lambda x: x["kind"]), ",").alias("kinds"), F.col("s.spent").alias("tokens"),
    )

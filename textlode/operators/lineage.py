"""The graph of summaries: levels, roll-ups, checks, and edits that leave it whole.

Tables of a store:
``summaries`` (summary_id, conv_id, kind ``leaf`` or ``condensed``, depth, tokens, created_at, content),
``parents`` (summary_id, parent_id, ordinal): a parent was folded into its summary,
``sources`` (summary_id, message_id, ordinal): the messages of a leaf,
``messages`` (message_id, conv_id, seq, tokens, created_at),
``context`` (conv_id, ordinal, item_type ``message`` or ``summary``, message_id, summary_id).

All functions take whole stores and work on all conversations at once. Walks are
rounds of equi-joins, as many as the graph is deep; each round's rows are cut off in the shared
folder. Cycles end a walk and are reported. Tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.sources.shared import durable


@dataclass(frozen=True)
class Store:
    summaries: DataFrame
    parents: DataFrame
    sources: DataFrame
    messages: DataFrame
    context: DataFrame


def climb(first: DataFrame, edges: DataFrame, give: dict[str, tuple[Column, Callable]], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Values of nodes (node, ...) from those of all their parents, bottom-up.

    ``first`` has the nodes that need no parent, ``edges`` (node, parent) those of the others. ``give`` names
    what a parent gives (a column of its values) and how gifts add up; ``finish`` turns the sums into a
    node's values. A node is reached once all its parents are; nodes on or above a cycle, or whose parent is
    missing, never are.
    """
    edges = durable(edges.select("node", "parent").distinct())
    needs = edges.groupBy("node").agg(F.count("*").alias("_needs"))
    new = durable(first)
    found, waiting = [new], None
    while not new.isEmpty():
        gifts = new.select(F.col("node").alias("parent"), *(c.alias(name) for name, (c, _) in give.items())).join(edges, "parent")
        gifts = gifts.select("node", F.lit(1).cast("long").alias("_got"), *give)
        gifts = gifts if waiting is None else gifts.unionByName(waiting)
        sums = durable(gifts.groupBy("node").agg(F.sum("_got").alias("_got"), *(how(name).alias(name) for name, (_, how) in give.items())))
        whole = sums.join(needs, "node")
        new = durable(finish(whole.filter("_got = _needs").drop("_got", "_needs")).select(*first.columns))
        waiting = whole.filter("_got < _needs").drop("_needs")
        found.append(new)
    return reduce(DataFrame.unionByName, found)


def depths(summaries: DataFrame, parents: DataFrame) -> DataFrame:
    """summary_id, depth, resolved: leaves 0, others one above their deepest parent, 1 without parents.

    What lies on or above a cycle, or has a parent in another conversation or nowhere, is not resolved and counts as 1.
    """
    s = summaries.select("summary_id", "conv_id", "kind")
    p = s.select(F.col("summary_id").alias("parent_id"), F.col("conv_id").alias("parent_conv"))
    condensed = s.filter("kind <> 'leaf'").select("summary_id", "conv_id")
    edges = parents.select("summary_id", "parent_id").join(condensed, "summary_id").join(p, "parent_id", "left")
    # a parent that is missing or foreign stands for itself, and nothing ever reaches it
    within = F.col("conv_id").eqNullSafe(F.col("parent_conv"))
    edges = durable(edges.select(F.col("summary_id").alias("node"), F.when(within, F.col("parent_id")).otherwise(F.concat(F.lit("\0"), "parent_id")).alias("parent")))
    alone = condensed.join(edges.select(F.col("node").alias("summary_id")).distinct(), "summary_id", "left_anti").select(F.col("summary_id").alias("node"), F.lit(1).alias("depth"))
    first = s.filter("kind = 'leaf'").select(F.col("summary_id").alias("node"), F.lit(0).alias("depth")).unionByName(alone)
    reached = climb(first, edges, {"depth": (F.col("depth"), F.max)}, lambda df: df.withColumn("depth", F.col("depth") + 1))
    reached = reached.select(F.col("node").alias("_node"), F.col("depth").alias("_depth"))
    every = s.join(reached, F.col("summary_id") == F.col("_node"), "left")
    return every.select("summary_id", F.coalesce("_depth", F.lit(1)).alias("depth"), F.col("_depth").isNotNull().alias("resolved"))


def rollups(store: Store) -> DataFrame:
    """summary_id, earliest_at, latest_at, descendants, descendant_tokens, source_tokens, by the depths that summaries have.

    A parent counts if it stands before its summary in the order of depth, time and id, and in its conversation:
    so cycles end. Leaves have the times and tokens of their messages; what has nothing below has its own time.
    """
    s = store.summaries.select("summary_id", "conv_id", "kind", "depth", F.greatest(F.lit(0), F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"), "created_at")
    spans = store.sources.join(store.messages.select("message_id", F.col("created_at").alias("at"), F.col("tokens").alias("n")), "message_id")
    spans = spans.groupBy(F.col("summary_id").alias("of")).agg(F.min("at").alias("early"), F.max("at").alias("late"), F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = s.join(spans, (F.col("summary_id") == F.col("of")) & (F.col("kind") == "leaf"), "left").select(
        F.col("summary_id").alias("node"), F.coalesce("early", "created_at").alias("earliest_at"), F.coalesce("late", "created_at").alias("latest_at"),
        F.lit(0).cast("long").alias("descendants"), F.lit(0).cast("long").alias("descendant_tokens"), zero("n").alias("source_tokens"), "tokens", "created_at", "kind",
    )
    own = durable(own)
    place = F.struct("depth", "created_at", "summary_id")
    up = s.filter("kind <> 'leaf'").select(F.col("summary_id").alias("node"), F.col("conv_id").alias("conv"), place.alias("place"))
    down = s.select(F.col("summary_id").alias("parent"), "conv_id", place.alias("below"))
    edges = store.parents.select(F.col("summary_id").alias("node"), F.col("parent_id").alias("parent")).distinct().join(up, "node").join(down, "parent")
    edges = durable(edges.filter((F.col("conv") == F.col("conv_id")) & (F.col("below") < F.col("place"))).select("node", "parent"))
    first = own.join(edges.select("node").distinct(), "node", "left_anti")
    values = own.select(F.col("node").alias("_of"), "tokens", "created_at", "kind")

    def finish(df: DataFrame) -> DataFrame:
        return df.join(values, F.col("node") == F.col("_of")).drop("_of")

    give = {
        "earliest_at": (F.col("earliest_at"), F.min), "latest_at": (F.col("latest_at"), F.max), "descendants": (F.col("descendants") + 1, F.sum),
        "descendant_tokens": (F.col("tokens") + F.col("descendant_tokens"), F.sum), "source_tokens": (F.col("source_tokens"), F.sum),
    }
    done = climb(first, edges, give, finish)
    return done.select(F.col("node").alias("summary_id"), "earliest_at", "latest_at", "descendants", "descendant_tokens", "source_tokens")


def checks(store: Store, conversations: DataFrame) -> DataFrame:
    """rule, status, conv_id, item: what breaks one of eight rules; a store without rows here is sound.

    ``conversations`` has the conv_ids that exist. Ordinals and numbers of messages are compared with the ones
    before them; a conversation's number of context tokens is summed by item and as a whole.
    """
    c, s, m = store.context, store.summaries, store.messages
    used = c.select("conv_id").unionByName(s.select("conv_id")).unionByName(m.select("conv_id")).distinct()
    missing = used.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")
    said, folded = c.filter("item_type = 'message' AND message_id IS NOT NULL"), c.filter("item_type = 'summary' AND summary_id IS NOT NULL")
    text = lambda c: F.col(c).cast("string").alias("item")
    # equal ordinals are the only way in which rows in order do not rise
    unordered = c.groupBy("conv_id", "ordinal").agg(F.count("*").alias("n")).filter("n > 1")
    dangling = said.join(m.select("message_id").distinct(), "message_id", "left_anti").select("conv_id", text("message_id"))
    dangling = dangling.unionByName(folded.join(s.select("summary_id").distinct(), "summary_id", "left_anti").select("conv_id", text("summary_id")))
    unsourced = s.filter("kind = 'leaf'").join(store.sources.select("summary_id").distinct(), "summary_id", "left_anti")
    unfolded = s.filter("kind = 'condensed'").join(store.parents.select("summary_id").distinct(), "summary_id", "left_anti")
    lineage = unsourced.select("conv_id", text("summary_id")).unionByName(unfolded.select("conv_id", text("summary_id")))
    orphan = s.join(folded.select("conv_id", "summary_id").distinct(), ["conv_id", "summary_id"], "left_anti").join(store.parents.select(F.col("parent_id").alias("summary_id")).distinct(), "summary_id", "left_anti")
    token = lambda df, key, other: df.join(other.select(key, "tokens"), key).groupBy("conv_id").agg(F.sum("tokens").alias("n"))
    each = token(said, "message_id", m).unionByName(token(folded, "summary_id", s)).groupBy("conv_id").agg(F.sum("n").alias("by_item"))
    held = c.join(m.select("message_id", F.col("tokens").alias("mt")), "message_id", "left").join(s.select("summary_id", F.col("tokens").alias("st")), "summary_id", "left")
    whole = held.groupBy("conv_id").agg(F.sum(F.coalesce("mt", F.lit(0)) + F.coalesce("st", F.lit(0))).alias("whole"))
    unequal = whole.join(each, "conv_id", "left").filter(F.col("whole") != F.coalesce("by_item", F.lit(0)))
    span = m.groupBy("conv_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"), F.count_distinct("seq").alias("different"))
    gaps = span.filter((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("different") != F.col("n")))
    twice = said.groupBy("conv_id", "message_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id", text("message_id"))
    twice = twice.unionByName(folded.groupBy("conv_id", "summary_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id", text("summary_id")))
    found = {
        "conversation_exists": missing.select("conv_id", text("conv_id")), "context_items_ordered": unordered.select("conv_id", text("ordinal")), "context_items_valid_refs": dangling,
        "summaries_have_lineage": lineage, "no_orphan_summaries": orphan.select("conv_id", text("summary_id")), "context_token_consistency": unequal.select("conv_id", text("conv_id")),
        "message_seq_contiguous": gaps.select("conv_id", text("conv_id")), "no_duplicate_context_refs": twice,
    }
    rows = [df.select(F.lit(rule).alias("rule"), F.lit("warn" if rule == "no_orphan_summaries" else "fail").alias("status"), "conv_id", "item") for rule, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


def below(roots: DataFrame, parents: DataFrame) -> DataFrame:
    """key, summary_id: all that was folded into the roots (key, summary_id), themselves included, each once for a key."""
    edges = durable(parents.select("summary_id", "parent_id").distinct())
    new = durable(roots.select("key", "summary_id").distinct())
    seen = new
    while not new.isEmpty():
        deeper = new.join(edges, "summary_id").select("key", F.col("parent_id").alias("summary_id")).distinct()
        new = durable(deeper.join(seen, ["key", "summary_id"], "left_anti"))
        seen = durable(seen.unionByName(new))
    return seen


def running(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``running``: sums of ``value`` in order within ``by``, however long one group is.

    Rows are dealt to ranges of (by, order); sums within a range start from the sum of the ranges before, of which
    there are as many as partitions.
    """
    placed = durable(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("running", own).join(starts, [*by, "_part"]).withColumn("running", F.col("running") + F.col("_start")).drop("_part", "_start")


def expanded(requests: DataFrame, store: Store, depth: int = 3, with_messages: bool = False) -> DataFrame:
    """request, place, root, kind, item, tokens, running: what requests (request, place, summary_id, cap) unfold, in order, within one cap each.

    The roots of a request are unfolded in the order of ``place``, each depth first in the order of the ordinals, at most ``depth``
    levels; a leaf's messages come last of all levels. A root does not cost. The first item beyond the cap ends the request. A summary that is
    reached twice below one root is listed twice and unfolded at its first place.
    """
    name = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    s = store.summaries.select("summary_id", F.col("tokens").alias("n"))
    edges = store.parents.join(s.withColumnRenamed("summary_id", "parent_id"), "parent_id").select("summary_id", F.lit("summary").alias("kind"), F.col("parent_id").alias("item"), "ordinal", "n")
    if with_messages:
        m = store.messages.select("message_id", F.col("tokens").alias("n"))
        leaves = store.summaries.filter("kind = 'leaf'").select("summary_id")
        edges = edges.unionByName(store.sources.join(leaves, "summary_id").join(m, "message_id").select("summary_id", F.lit("message").alias("kind"), F.col("message_id").alias("item"), "ordinal", "n"))
    edges = durable(edges.select(F.col("summary_id").alias("from"), "kind", "item", "ordinal", "n"))
    level = requests.join(s.select("summary_id"), "summary_id").select("request", "place", F.col("summary_id").alias("root"), F.col("summary_id").alias("at"), F.lit("").alias("path"), F.lit("/").alias("seen"))
    found = []
    for _ in range(depth):
        step = level.join(edges, F.col("at") == F.col("from"))
        step = durable(step.select("request", "place", "root", "kind", "item", F.col("n").alias("tokens"), F.concat("path", F.lit("/"), name("ordinal"), F.lit(":"), "item").alias("path"), "seen", "at"))
        if step.isEmpty():
            break
        found.append(step)
        level = step.filter("kind = 'summary'").select("request", "place", "root", F.col("item").alias("at"), "path", F.concat("seen", "at", F.lit("/")).alias("seen")).filter(~F.contains("seen", F.concat(F.lit("/"), "at", F.lit("/"))))
    if not found:
        return requests.select("request", "place", F.col("summary_id").alias("root"), F.lit("").alias("kind"), F.lit("").alias("item"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("running")).limit(0)
    rows = reduce(DataFrame.unionByName, found).drop("seen", "at")
    # a row stays if every summary above it on its path stands at its own first path
    firsts = rows.filter("kind = 'summary'").groupBy("request", "place", "root", "item").agg(F.min("path").alias("first"))
    later = durable(rows.filter("kind = 'summary'").join(firsts, ["request", "place", "root", "item"]).filter("path <> first").select("request", "place", "path").distinct())
    above = rows.select("request", "place", "path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(2))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("up"))
    hidden = above.filter("up <> path").join(later.withColumnRenamed("path", "up"), ["request", "place", "up"], "left_semi").select("request", "place", "path").distinct()
    kept = rows.join(hidden, ["request", "place", "path"], "left_anti").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    summed = running(kept, ["request"], ["place", "path"], "tokens").join(requests.select("request", "cap").distinct(), "request")
    return summed.filter(F.col("cap").isNull() | (F.col("running") <= F.col("cap"))).select("request", "place", "root", "kind", "item", "tokens", "running", "path")


def dissolved(store: Store, targets: DataFrame, purge: bool = True) -> tuple[DataFrame, Store]:
    """The plan (conv_id, summary_id, ordinal, parents, tokens, items_to_shift, shift) and the store in which targets' parents stand in their place.

    ``targets``: conv_id, summary_id. What is no condensed summary of the conversation's context with parents is not in
    the plan and stays. Items behind targets move by as many as parents stand before them in their place, less the targets. With
    ``purge`` the summaries and their links go too.
    """
    parents = store.parents.join(store.summaries.select(F.col("summary_id").alias("parent_id"), F.col("tokens").alias("n")), "parent_id")
    folded = parents.groupBy("summary_id").agg(F.count("*").alias("parents"), F.sum("n").alias("tokens"), F.array_sort(F.collect_list(F.struct("ordinal", "parent_id"))).alias("list"))
    at = store.context.filter("item_type = 'summary'").select("conv_id", "summary_id", "ordinal")
    kept = store.summaries.filter("kind = 'condensed'").select("summary_id")
    plan = durable(targets.select("conv_id", "summary_id").distinct().join(at, ["conv_id", "summary_id"]).join(kept, "summary_id", "left_semi").join(folded, "summary_id"))
    shifts = plan.groupBy("conv_id").agg(F.collect_list(F.struct("ordinal", (F.col("parents") - 1).alias("by"))).alias("shifts"))  # a row a target
    moved = F.aggregate(F.filter("shifts", lambda t: t["ordinal"] < F.col("ordinal")), F.lit(0).cast("long"), lambda total, t: total + t["by"])
    rest = store.context.join(plan.select("conv_id", "summary_id").distinct(), ["conv_id", "summary_id"], "left_anti").join(shifts, "conv_id", "left")
    rest = rest.select("conv_id", (F.col("ordinal") + F.coalesce(moved, F.lit(0))).alias("ordinal"), "item_type", "message_id", "summary_id")
    placed = plan.join(shifts, "conv_id").select("conv_id", (F.col("ordinal") + moved).alias("start"), F.posexplode("list").alias("i", "p"))
    placed = placed.select("conv_id", (F.col("start") + F.col("i")).alias("ordinal"), F.lit("summary").alias("item_type"), F.lit(None).cast(dict(store.context.dtypes)["message_id"]).alias("message_id"), F.col("p.parent_id").alias("summary_id"))
    after = store.context.select(F.col("conv_id").alias("c"), F.col("ordinal").alias("o")).join(plan, (F.col("c") == F.col("conv_id")) & (F.col("o") > F.col("ordinal")))
    behind = after.groupBy("conv_id", "summary_id").agg(F.count("*").alias("items_to_shift"))
    shown = plan.join(behind, ["conv_id", "summary_id"], "left").select("conv_id", "summary_id", "ordinal", "parents", "tokens", F.coalesce("items_to_shift", F.lit(0)).alias("items_to_shift"), (F.col("parents") - 1).alias("shift"))
    gone = plan.select("summary_id").distinct()
    new = replace(store, context=rest.unionByName(placed))
    if purge:
        new = replace(new, summaries=store.summaries.join(gone, "summary_id", "left_anti"), parents=store.parents.join(gone, "summary_id", "left_anti"))
    return shown, new


def new_name(prefix: str, target: Column, old: Column) -> Column:
    """A copy's id, from the conversation that gets it and the id that it had: equal for equal ones, and no other's."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(target.cast("string"), F.lit(":"), old.cast("string")), 256), 1, 32))


def transplanted(store: Store, moves: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame, Store]:
    """Copies of sources' summaries, with all that was folded into them, in other conversations.

    ``moves``: source, target (one a target). Returns each move's state (``ok``, or why not: ``same``, ``missing``, ``empty``,
    ``foreign``, ``duplicate``) with its numbers, the copies (source, target, place, summary_id, new_id), and the store with them. A move is off if
    the target has a summary of equal content, or the graph leads out of the source. Copies come in the order of depth, time and id; messages
    of leaves are copied once, behind the target's, in the order of their seq. In the target's context summaries stand by depth (deepest
    first), time and id, and messages behind.
    """
    key = F.concat_ws(">", "source", "target").alias("key")
    moves = durable(moves.select("source", "target", key).distinct())
    s, context = store.summaries, store.context
    shown = context.filter("item_type = 'summary'").join(s.select("summary_id", F.col("tokens").alias("n")), "summary_id").select("conv_id", "summary_id", "n")
    roots = durable(moves.join(shown, F.col("source") == F.col("conv_id")).select("key", "summary_id", "n"))
    reach = below(roots, store.parents).join(s, "summary_id").join(moves, "key")
    held = reach.withColumn("hash", F.sha2("content", 256))
    there = s.select(F.col("conv_id").alias("target"), F.sha2("content", 256).alias("hash")).distinct().withColumn("again", F.lit(True))
    facts = held.join(there, ["target", "hash"], "left").groupBy("key").agg(
        F.count("*").alias("summaries"), F.count(F.when(F.col("conv_id") != F.col("source"), 1)).alias("foreign"), F.count("again").alias("duplicates")
    )
    top = roots.groupBy("key").agg(F.count("*").alias("context_items"), F.sum("n").alias("context_tokens"))
    known = conversations.select(F.col("conv_id").alias("c")).distinct()
    state = moves.join(known.select(F.col("c").alias("source"), F.lit(True).alias("has_source")), "source", "left").join(known.select(F.col("c").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    state = state.join(top, "key", "left").join(facts, "key", "left")
    why = (
        F.when(F.col("source") == F.col("target"), "same").when(F.col("has_source").isNull() | F.col("has_target").isNull(), "missing").when(F.col("context_items").isNull(), "empty")
        .when(F.col("foreign") > 0, "foreign").when(F.col("duplicates") > 0, "duplicate").otherwise("ok")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    state = durable(state.select("key", "source", "target", why.alias("state"), zero("context_items"), zero("context_tokens"), zero("summaries"), zero("duplicates")))
    fine = state.filter("state = 'ok'").select("key")
    place = F.row_number().over(Window.partitionBy("key").orderBy("depth", "created_at", "summary_id"))
    copies = durable(reach.join(fine, "key").withColumn("place", place).withColumn("new_id", new_name("sum_", F.col("target"), F.col("summary_id"))))
    names = copies.select("key", "summary_id", "new_id")
    added = copies.select(*(F.col("new_id").alias("summary_id") if c == "summary_id" else F.col("target").alias("conv_id") if c == "conv_id" else F.col(c) for c in s.columns))
    other = names.select("key", F.col("summary_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    links = store.parents.join(names, "summary_id").join(other, ["key", "parent_id"]).select(F.col("new_id").alias("summary_id"), F.col("new_parent").alias("parent_id"), "ordinal")
    rows = store.sources.join(copies.select("key", "target", "summary_id", "new_id"), "summary_id").join(store.messages, "message_id")
    rows = durable(rows.withColumn("new_message", new_name("msg_", F.col("target"), F.col("message_id"))))
    last = store.messages.groupBy(F.col("conv_id").alias("target")).agg(F.max("seq").alias("last"))
    fresh = rows.select("key", "target", "new_message", *store.messages.columns).distinct()
    seq = F.row_number().over(Window.partitionBy("target").orderBy("conv_id", "seq", "message_id")) + F.coalesce("last", F.lit(-1))
    fresh = fresh.join(last, "target", "left").withColumn("new_seq", seq)
    values = {"message_id": "new_message", "conv_id": "target", "seq": "new_seq"}
    fresh = fresh.select(*(F.col(values.get(c, c)).cast(t).alias(c) for c, t in store.messages.dtypes))
    sources = rows.select(F.col("new_id").alias("summary_id"), F.col("new_message").alias("message_id"), "ordinal")
    every = s.unionByName(added)
    items = roots.join(fine, "key").join(names, ["key", "summary_id"]).join(moves, "key").select(F.col("target").alias("conv_id"), F.col("new_id").alias("summary_id"))
    touched = items.select("conv_id").distinct()
    kept = context.join(touched, "conv_id", "left_semi")
    standing = kept.filter("item_type = 'summary'").select("conv_id", "summary_id").unionByName(items).join(every.select("summary_id", "depth", "created_at"), "summary_id")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("depth"), "created_at", "summary_id")) - 1
    message = dict(context.dtypes)["message_id"]
    first = standing.select("conv_id", order.alias("ordinal"), F.lit("summary").alias("item_type"), F.lit(None).cast(message).alias("message_id"), "summary_id")
    count = standing.groupBy("conv_id").agg(F.count("*").alias("n"))
    after = kept.filter("item_type = 'message'").join(count, "conv_id")
    behind = F.row_number().over(Window.partitionBy("conv_id").orderBy("ordinal")) - 1 + F.col("n")
    after = after.select("conv_id", behind.alias("ordinal"), "item_type", "message_id", "summary_id")
    ordinal = dict(context.dtypes)["ordinal"]
    merged = context.join(touched, "conv_id", "left_anti").unionByName(first.unionByName(after).withColumn("ordinal", F.col("ordinal").cast(ordinal)))
    new = Store(every, store.parents.unionByName(links), store.sources.unionByName(sources), store.messages.unionByName(fresh), merged)
    return state.drop("key"), copies.select("source", "target", "place", "summary_id", "new_id"), new


def repair_plan(store: Store, marker: str) -> DataFrame:
    """conv_id, place, summary_id, depth, ordinal: summaries whose content holds ``marker``, in the order in which to write them anew.

    Leaves of the context come first, in its order, as each is written with the one before in view; then other leaves by time,
    then condensed summaries from below, by depth and time.
    """
    bad = store.summaries.filter(F.contains("content", F.lit(marker)))
    at = store.context.filter("item_type = 'summary'").groupBy("conv_id", "summary_id").agg(F.min("ordinal").alias("ordinal"))
    bad = bad.join(at, ["conv_id", "summary_id"], "left")
    leaf = (F.col("depth") == 0) | (F.lower("kind") == "leaf")
    group = F.when(leaf & F.col("ordinal").isNotNull(), 0).when(leaf, 1).otherwise(2)
    first = F.when(group == 0, F.col("ordinal")).when(group == 2, F.col("depth")).otherwise(0)
    order = Window.partitionBy("conv_id").orderBy("group", "first", "created_at", "summary_id")
    ranked = bad.withColumn("group", group).withColumn("first", first).withColumn("place", F.row_number().over(order))
    return ranked.select("conv_id", "place", "summary_id", "depth", F.when(group < 2, F.col("ordinal")).alias("ordinal"))


def repaired(store: Store, written: DataFrame, per_token: float = 4.0) -> Store:
    """The store with new contents (summary_id, content), whose tokens are counted anew; empty ones change nothing."""
    new = written.filter(F.trim("content") != "").select("summary_id", F.col("content").alias("_new"))
    joined = store.summaries.join(new, "summary_id", "left")
    tokens = F.when(F.col("_new").isNotNull(), F.ceil(F.length("_new") / per_token)).otherwise(F.col("tokens"))
    kinds = dict(store.summaries.dtypes)
    columns = {"tokens": tokens.cast(kinds["tokens"]), "content": F.coalesce("_new", "content")}
    return replace(store, summaries=joined.select(*(columns.get(c, F.col(c)).alias(c) for c in store.summaries.columns)))

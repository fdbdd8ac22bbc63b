"""Reconciling candidates with what is known, and packing what is best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import text as T


#: Least confidence of a correction and of a conflict, and what a correction adds to its own.
LEAST_CORRECTION, LEAST_CONFLICT, CORRECTION_BONUS = 0.3, 0.3, 0.15


def best_existing(existing: DataFrame) -> DataFrame:
    """The most confident row of each key, the newest of equals; an aggregate, so copies combine before they move."""
    kept = [c for c in ("confidence", "id", "object", "provisional", "scope_id") if c in existing.columns]
    best = existing.groupBy("canonical_key").agg(F.max(F.struct(*kept)).alias("e"))
    return best.select(F.col("canonical_key").alias("of_key"), *(F.col(f"e.{c}").alias("existing_id" if c == "id" else f"e_{c}") for c in kept))


def reconcile(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, existing_id, action, confidence: what becomes of each candidate, and a further row for a conflict.

    A provisional candidate is but evidence against a firm row; else a correction
    (``corrects``, if the candidates have it) of the same scope with a confidence
    of 0.3 or more supersedes and gains 0.15; else a higher confidence supersedes;
    equal ones supersede if their values differ; lower ones are evidence.
    Independently, values that contradict each other at a confidence of 0.3 or
    more give a conflict, active if the row was superseded. All candidates of a
    batch are judged against the same state.
    """
    joined = candidates.join(best_existing(existing), F.col("canonical_key") == F.col("of_key"), "left")
    gap, known = F.col("confidence") - F.col("e_confidence"), F.col("existing_id").isNotNull()
    weak = F.col("provisional") & ~F.col("e_provisional")
    corrects = F.lit(False)
    if "corrects" in candidates.columns:
        same = F.col("scope_id") == F.col("e_scope_id") if {"scope_id", "e_scope_id"} <= set(joined.columns) else F.lit(True)
        corrects = F.coalesce(F.col("corrects") & same & known & ~weak & (F.col("confidence") >= LEAST_CORRECTION), F.lit(False))
    equal = F.when(F.col("object") == F.col("e_object"), "evidence").otherwise("supersede")
    action = (
        F.when(~known, "insert").when(weak, "evidence").when(corrects, "supersede").when(gap > 0.001, "supersede")
        .when(F.abs(gap) <= 0.001, equal).otherwise("evidence")
    )
    conflict = known & ~weak & (F.col("confidence") >= LEAST_CONFLICT) & T.values_contradict(F.col("object"), F.col("e_object"))
    state = F.when(F.col("action") == "supersede", "conflict:active").otherwise("conflict:needs_confirmation")
    gained = F.when(corrects, F.least(F.lit(1.0), F.col("confidence") + CORRECTION_BONUS)).otherwise(F.col("confidence"))
    judged = joined.withColumn("action", action).withColumn("gained", gained)
    actions = F.when(F.coalesce(conflict, F.lit(False)), F.array("action", state)).otherwise(F.array("action"))
    return judged.select("id", "existing_id", F.explode(actions).alias("action"), F.col("gained").alias("confidence"))


def believe(base: Column, pro: Column, con: Column) -> Column:
    """Confidence after evidence: both sides count up to 1, and what remains moves it."""
    net = F.least(F.lit(1.0), pro) - F.least(F.lit(1.0), con)
    return F.when(net > 0, F.least(F.lit(1.0), base + net * (1 - base) * 0.7)).when(net < 0, F.greatest(F.lit(0.05), base * (1 + net))).otherwise(base)


def knapsack(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """Rows of each group by score a token, while they fit; misfits are skipped. Groups may be of any size.

    Of rows of one cost those that are taken come first in that order, as what is left only shrinks: so of each
    cost no more than the budget holds can matter, and those ranks are limited before rows move. Rows that cost nothing are
    all taken.
    """
    cost = F.greatest(F.col("tokens"), F.lit(0))
    rate = F.col("score") / F.greatest(F.col("tokens"), F.lit(1))
    priced = rows.filter((cost > 0) & (cost <= budget)).withColumn("_rate", -rate)
    place = F.row_number().over(Window.partitionBy(by, "tokens").orderBy("_rate", "id"))
    near = priced.withColumn("_place", place).filter(F.col("_place") <= budget).filter(F.col("_place") * F.col("tokens") <= budget)
    row = F.struct(*rows.columns)
    each = near.groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list(F.struct("_rate", "id", row.alias("row")))).alias("all"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.slice("all", 1, 0).alias("kept"))
    fill = lambda s, x: F.when(x["row"]["tokens"] <= s["left"], F.struct((s["left"] - x["row"]["tokens"]).alias("left"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)
    taken = each.select(F.explode(F.aggregate("all", start, fill)["kept"]).alias("x")).select("x.row.*")
    return taken.unionByName(rows.filter(cost <= 0))

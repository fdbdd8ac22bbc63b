"""Compaction of conversations: rounds of set-based steps over all conversations at once."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import text as T


def target_tokens(tokens: Column, aggressive: bool = False) -> Column:
    """How long the summary of so many tokens may be."""
    if aggressive:
        return F.greatest(F.lit(96), F.least(F.lit(640), F.floor(tokens * F.lit(0.2)))).cast("long")
    return F.greatest(F.lit(192), F.least(F.lit(1200), F.floor(tokens * F.lit(0.35)))).cast("long")


def truncated(text: Column, tokens: Column) -> Column:
    """The summary of last resort: the last characters, four a token."""
    return F.substring(text, F.greatest(F.length(text) - tokens * 4 + 1, F.lit(1)).cast("int"), (tokens * 4).cast("int"))


def compact_round(items: DataFrame, tail: int, size: int, budget: int) -> DataFrame:
    """One round over (conv_id, ordinal, kind, text, tokens): in each conversation above its budget, the ``size``
    oldest items before the tail become one summary in their place."""
    by = Window.partitionBy("conv_id")
    ranked = (
        items.withColumn("total", F.sum("tokens").over(by))
        .withColumn("from_end", F.row_number().over(by.orderBy(F.desc("ordinal"))))
        .withColumn("place", F.row_number().over(by.orderBy("ordinal")))
        .withColumn("fold", (F.col("total") > budget) & (F.col("from_end") > tail) & (F.col("place") <= size))
    )
    old = ranked.filter("fold").groupBy("conv_id").agg(
        F.min("ordinal").alias("ordinal"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.sum("tokens").alias("before"),
    )
    # a summary never has more tokens than half of what it stands for
    room = F.greatest(F.lit(1), F.least(target_tokens(F.col("before")), F.floor(F.col("before") / 2).cast("long")))
    made = old.select("conv_id", "ordinal", F.lit("summary").alias("kind"), truncated(F.col("text"), room).alias("text"))
    made = made.withColumn("tokens", T.estimate_tokens(F.col("text"), 4.0))
    return ranked.filter("NOT fold").select("conv_id", "ordinal", "kind", "text", "tokens").unionByName(made)


def compact(items: DataFrame, tail: int = 8, size: int = 4, budget: int = 200) -> DataFrame:
    """Rounds as in ``compact_round`` until every conversation fits its budget or makes no progress.

    A conversation's rounds depend on its own items alone, so they run in one pass
    over it: a long conversation costs no more Spark jobs than a short one.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = [[k, o, kind, t if isinstance(t, str) else None, int(n) if n == n and n is not None else 0] for k, o, kind, t, n in group.sort_values("ordinal").itertuples(index=False)]
        total = sum(r[4] for r in rows)
        while total > budget and len(rows) > tail:
            old = rows[: min(size, len(rows) - tail)]
            before = sum(r[4] for r in old)
            room = max(1, min(max(192, min(1200, math.floor(before * 0.35))), before // 2))
            text = "\n".join(r[3] for r in old if r[3] is not None)[-room * 4 :]
            made = [old[0][0], old[0][1], "summary", text, math.ceil(len(text) / 4.0)]
            if len(old) == 1 and made[4] >= before:  # no progress
                break
            rows[: len(old)] = [made]
            total += made[4] - before
        return pd.DataFrame(rows, columns=["conv_id", "ordinal", "kind", "text", "tokens"])

    kinds = items.select("conv_id", "ordinal", "kind", "text", "tokens")
    return kinds.groupBy("conv_id").applyInPandas(fold, kinds.schema)

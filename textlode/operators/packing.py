"""Packing results into token budgets, where a fold and not a window decides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.operators import search
from textlode.operators.chunking import sentences, tokens_of
from textlode.sources.shared import durable


def pack_context(ranked: DataFrame, budget: int) -> DataFrame:
    """query_id, source, item, place of what fits.

    Sources come in the order of their first hit and cost a header; a source ends
    at its first chunk that does not fit, all end at the first header that does
    not. A query has as many rows as its ranking is long, so groups are small.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group, left, kept = group.sort_values("rank"), budget, []
        for source, rows in group.groupby("source", sort=False):
            header = tokens_of(f"[{source}]")
            if header > left:
                break
            left -= header
            for r in rows.itertuples():
                if r.tokens > left:
                    break
                left -= r.tokens
                kept.append((r.query_id, source, r.item))
        return pd.DataFrame([(*k, i + 1) for i, k in enumerate(kept)], columns=["query_id", "source", "item", "place"])

    return ranked.select("query_id", "source", "item", "rank", "tokens").groupBy("query_id").applyInPandas(pack, "query_id long, source string, item long, place long")


def brief(ranked: DataFrame, budget: int, per_chunk: int = 3) -> DataFrame:
    """query_id, item, sentence, score: the best sentences of the ranked texts within the budget.

    A sentence scores by its text's relevance and the terms it holds, more at the
    start and end of the text, less if it is very short or long.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        top, rows = max(group["score"].max(), 1e-9), []
        for r in group.itertuples():
            found = [s for s in sentences(r.text or "") if len(s) >= 10]
            terms = r.query.lower().split()
            for i, s in enumerate(found):
                n, low = len(s.split()), s.lower()
                hits = sum(t in low for t in terms) / max(1, len(terms))
                place = 1.1 if i == 0 else 1.05 if i == len(found) - 1 else 1.0
                rows.append(((0.7 * r.score / top + 0.3 * hits) * place * (0.3 if n < 5 else 0.6 if n > 50 else 1.0), r.query_id, r.item, i, s))
        rows.sort(key=lambda x: (-x[0], x[2], x[3]))
        used, seen, left = [], {}, budget
        for score, query_id, item, i, s in rows:
            if seen.get(item, 0) >= per_chunk:
                continue
            if tokens_of(s) > left:
                break
            seen[item], left = seen.get(item, 0) + 1, left - tokens_of(s)
            used.append((query_id, item, i, s, score))
        return pd.DataFrame(sorted(used, key=lambda x: x[1:3]), columns=["query_id", "item", "sentence_no", "sentence", "score"])

    schema = "query_id long, item long, sentence_no long, sentence string, score double"
    return ranked.select("query_id", "query", "item", "text", "score").groupBy("query_id").applyInPandas(choose, schema)


def close_pairs(vectors: DataFrame, by: str, least_cosine: float) -> DataFrame:
    """a, b: pairs of one group, a before b (by id), whose cosine reaches the least one; blocks of a group meet blocks, each pair once.

    Vectors of different lengths are no pairs.
    """
    import numpy as np

    def run(left: search.Side, right: search.Side, same: bool) -> dict[str, np.ndarray]:
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (left.vectors, right.vectors))
        i, j = np.nonzero(x @ y.T >= least_cosine)
        a, b = left.ids[i], right.ids[j]
        kept = a < b if same else a != b
        return {"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept]}

    v = vectors.select(by, F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.blocked(v, None, by, run, "a long, b long")


def nearest_before(new: DataFrame, old: DataFrame | None, by: str) -> DataFrame:
    """vec_id, distance: of each new vector, the nearest earlier one of its group in each block of the old ones.

    Without ``old``, vectors are held against their own table, and each pair of blocks meets once for both.
    """
    import numpy as np

    one_table = old is None

    def before(left: search.Side, right: search.Side) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for start in range(0, len(left.ids), search.AT_ONCE):
            ids, vectors = left.ids[start : start + search.AT_ONCE], left.vectors[start : start + search.AT_ONCE]
            near, off = search.near_squares(vectors, right.vectors)
            near[right.ids[None, :] >= ids[:, None]] = np.inf
            least = near.min(axis=1)
            rows, at = np.nonzero((near <= least[:, None] + 2 * off) & np.isfinite(least)[:, None])
            best = np.full(len(ids), np.inf)
            np.minimum.at(best, rows, search.paired_distances(vectors[rows], right.vectors[at]))
            out.append((ids[np.isfinite(best)], best[np.isfinite(best)]))
        return out

    def run(left: search.Side, right: search.Side, same: bool) -> dict[str, np.ndarray]:
        found = before(left, right) + (before(right, left) if one_table and not same else [])
        return dict(zip(("vec_id", "distance"), map(np.concatenate, zip(*found, strict=True)), strict=True))

    new, other = (v if v is None else v.select(by, F.col("vec_id").alias("id"), F.col("embedding").alias("vector")) for v in (new, old))
    return search.blocked(new, other, by, run, "vec_id long, distance double")


def greedy_distinct(vectors: DataFrame, by: str, least_cosine: float = 0.95) -> DataFrame:
    """Rows of each group without those too close to one kept before them, whatever the group's size.

    A row is kept once all earlier rows close to it are dropped, and dropped once
    one of them is kept. Each round settles at least the first open row of every
    chain; what is settled leaves the pairs, until no pair is left.
    """
    pairs = durable(close_pairs(vectors, by, least_cosine))
    dropped = pairs.select(F.col("b").alias("vec_id")).limit(0)
    while not pairs.isEmpty():
        firsts = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")  # no earlier row left: kept
        gone = durable(pairs.join(firsts, "a", "left_semi").select(F.col("b").alias("vec_id")).distinct())
        dropped = durable(dropped.union(gone))
        left = pairs.join(gone.select(F.col("vec_id").alias("a")), "a", "left_anti")
        pairs = durable(left.join(gone.select(F.col("vec_id").alias("b")), "b", "left_anti").select("a", "b"))
    return vectors.select("vec_id").join(dropped, "vec_id", "left_anti")

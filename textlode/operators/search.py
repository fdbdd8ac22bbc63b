"""Retrieval for batches of queries: BM25, exact nearest neighbours, rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.sources.shared import durable

#: Vectors of a block, and rows beyond k that a block sends so that rounding at its edge costs nothing.
BLOCK = 2048
TIES = 8

#: Queries up to which their terms or vectors are broadcast: beyond it, joins shuffle.
BROADCAST_QUERIES = 10_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a side whose number of rows the caller knows."""
    return F.broadcast(df) if rows <= BROADCAST_QUERIES else df


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, n_terms of (query_id, query). A word of several tokens, as with a hyphen, is one term: its tokens in a row, joined by spaces."""
    words = F.transform(F.split("query", "\\s+"), lambda w: F.array_join(T.tokens(w), " "))
    terms = F.array_distinct(F.filter(words, lambda w: w != ""))
    return queries.select("query_id", F.size(terms).alias("n_terms"), F.explode(terms).alias("term"))


def query_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    return query_terms(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))


#: Distinct terms up to which a text's tokens are looked up in its row, in a hash set; beyond it tokens are joined.
ROW_TERMS = 5_000


def copies(words: Column, phrase: Column) -> Column:
    """How often the tokens of ``phrase`` (with spaces between) stand in a row in ``words``."""
    # each token stands between its own two spaces, so that places of a phrase do not overlap
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.replace(phrase, F.lit(" "), F.lit("  ")), F.lit(" "))
    return ((F.length(spaced) - F.length(F.replace(spaced, wanted, F.lit("")))) / F.length(wanted)).cast("long")


def counted(docs: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, length and found (term, tf) of every text: one scan gives sizes and hits, and only they are kept, in the shared folder.

    Terms are looked up in a hash set inside the row, so that no other token leaves it;
    phrases are counted only where there are any. More than ROW_TERMS terms are joined
    to tokens that are counted before they move, phrases to texts that hold their first token.
    """
    split = docs.select(F.col(key).alias("doc_id"), T.tokens(F.col(text)).alias("words"))
    names = [r.term for r in queries.select("term").distinct().limit(ROW_TERMS + 1).collect()]
    pair = lambda term, tf: F.struct(term.alias("term"), tf.alias("tf"))
    if len(names) <= ROW_TERMS:
        single, phrases = [n for n in names if " " not in n], [n for n in names if " " in n]
        held = F.filter("words", lambda w: w.isin(single)) if single else F.array().cast("array<string>")
        # equal tokens of a sorted array are runs; their number is the distance of their ends
        held = split.withColumn("held", F.array_sort(held))
        runs = F.filter(F.transform("held", lambda w, i: F.struct(w.alias("w"), i.alias("i"), F.try_element_at(F.col("held"), i + 2).alias("after"))), lambda x: x["after"].isNull() | (x["after"] != x["w"]))
        runs = held.withColumn("runs", runs)
        found = F.transform("runs", lambda x, i: pair(x["w"], (x["i"] - F.when(i == 0, -1).otherwise(F.try_element_at(F.col("runs"), i)["i"])).cast("long")))
        if phrases:
            stand = F.transform(F.array(*map(F.lit, phrases)), lambda p: pair(p, copies(F.col("words"), p)))
            found = F.concat(found, F.filter(stand, lambda x: x["tf"] > 0))
        return durable(runs.select("doc_id", F.size("words").alias("length"), found.alias("found")))
    terms = queries.select("term").distinct()
    split = durable(split)
    single, several = (terms.filter(F.contains("term", F.lit(" ")) == several) for several in (False, True))
    words = split.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).join(single, "term", "left_semi").select("doc_id", "term", "tf")
    first = several.select(F.col("term").alias("phrase"), F.split("term", " ")[0].alias("token"))
    holders = split.withColumn("token", F.explode(F.array_distinct("words"))).join(first, "token")
    stand = holders.select("doc_id", F.col("phrase").alias("term"), copies(F.col("words"), F.col("phrase")).alias("tf")).filter("tf > 0")
    found = words.unionByName(stand).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(pair(F.col("term"), F.col("tf"))).alias("found"))
    sized = split.select("doc_id", F.size("words").alias("length")).join(found, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return durable(sized.select("doc_id", "length", F.coalesce("found", F.array().cast("array<struct<term:string,tf:bigint>>")).alias("found")))


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf)


def term_score(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return idf * tf * 2.2 / (tf + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * length / mean_length))


def bm25(docs: DataFrame, queries: DataFrame, n_queries: int, key: str = "doc_id", text: str = "text", every: bool | None = True) -> DataFrame:
    """query_id, doc_id, score of the texts that hold every term of a query (or any, or with None either: strict tells which)."""
    texts = counted(docs, queries, key, text)
    totals = texts.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    hits = texts.select("doc_id", "length", F.explode("found").alias("f")).select("doc_id", "length", "f.*")
    frequencies = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = queries.join(frequencies, "term").crossJoin(F.broadcast(totals))  # one row
    weighed = weighed.withColumn("idf", inverse_frequency(F.col("n_docs"), F.col("df")))
    scored = hits.join(small(weighed, n_queries), "term").withColumn("part", term_score(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean_length")))
    summed = scored.groupBy("query_id", "doc_id", "n_terms").agg(F.sum("part").alias("score"), F.count("*").alias("hits"))
    if every is None:
        return summed.select("query_id", "doc_id", "score", (F.col("hits") == F.col("n_terms")).alias("strict"))
    return (summed.filter("hits = n_terms") if every else summed).select("query_id", "doc_id", "score")


def top(df: DataFrame, order: list[Column], k: int, by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with their rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


class Side:
    """Rows of a block: ids, and vectors as a matrix."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.vectors = rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype("f8")


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, summed by component, so that equal vectors have distance 0."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += np.square(x[:, k, None] - y[None, :, k])
    return out


#: Rows of a block that are held against the other block at a time.
AT_ONCE = 256


def near_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one product of matrices, and what they may be off; as by ``squares`` where that is not finite."""
    xx, yy = np.square(x).sum(axis=1), np.square(y).sum(axis=1)
    out = x @ y.T
    out *= -2
    out += xx[:, None]
    out += yy
    if np.isfinite(out).all():
        return out, 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx.max() + yy.max())
    return squares(x, y), 0.0


def paired_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of row and row, added up in the order of ``squares``."""
    return np.sqrt(np.add.accumulate(np.square(x - y), axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def blocked(left: DataFrame, right: DataFrame | None, same: str | None, run: Callable[[Side, Side, bool], dict], schema: str) -> DataFrame:
    """Rows (id, vector) of ``left`` meet those of ``right`` (of equal ``same``) block by block; without ``right``, pairs of ``left``'s blocks meet once.

    A group (of ``same`` and of the vectors' length, which must agree) is dealt to blocks of
    about BLOCK rows by a hash of the ids: as many as the group's own size asks for, so small groups move once and a
    hot one is many tasks. ``run`` gets both blocks and whether they are one, and must reduce
    them: pairs of rows never leave it. Groups without a partner, and null vectors, give nothing.
    """

    def sized(df: DataFrame) -> DataFrame:
        group = F.lit(0) if same is None else F.col(same)
        df = df.select("id", "vector", group.alias("_group"), F.size("vector").alias("_size")).filter("vector IS NOT NULL AND _group IS NOT NULL")
        return df.select(*(F.col(c).alias(c) for c in df.columns))  # columns of its own, as both sides may be one table

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("_group", "_size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    a, b = sized(left), sized(left if right is None else right)
    sizes = blocks(a, "_na").join(blocks(b, "_nb"), ["_group", "_size"])
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    dealt_a, dealt_b = a.join(sizes, ["_group", "_size"]).withColumn("_a", block("_na")), b.join(sizes, ["_group", "_size"]).withColumn("_b", block("_nb"))
    if right is None:
        dealt_a = dealt_a.withColumn("_b", F.explode(F.sequence(F.col("_a"), F.col("_nb") - 1)))
        dealt_b = dealt_b.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_b"))))
    else:
        dealt_a = dealt_a.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        dealt_b = dealt_b.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
    sides = dealt_a.select("_group", "_size", "_a", "_b", F.lit(0).alias("_side"), "id", "vector").union(dealt_b.select("_group", "_size", "_a", "_b", F.lit(1).alias("_side"), "id", "vector"))
    placed = sides.repartition("_group", "_size", "_a", "_b").sortWithinPartitions("_group", "_size", "_a", "_b", "_side")
    mirrored = right is None

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Many small groups make one call: rows come sorted, and a group ends where its key changes."""
        for group in _groups(parts):
            one, two = group[group["_side"] == 0], group[group["_side"] == 1]
            if len(one) and len(two):
                yield pd.DataFrame(run(Side(one), Side(two), mirrored and group["_a"].iat[0] == group["_b"].iat[0]))

    return placed.mapInPandas(meet, schema)


def _groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of (_group, _size, _a, _b) out of sorted parts; a group has at most two blocks."""
    held, key = [], None
    for part in parts:
        if not len(part):
            continue
        keys = list(zip(part["_group"], part["_size"], part["_a"], part["_b"], strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if held and keys[start] != key:
                yield pd.concat(held)
                held = []
            key = keys[start]
            held.append(part.iloc[start:stop])
    if held:
        yield pd.concat(held)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest vectors of each query, exactly.

    ``corpus`` has (vec_id, embedding), ``queries`` (query_id, vector). Blocks of
    queries meet blocks of the corpus, and each pair of blocks keeps the nearest
    of each query; ``same`` names a column in which both must agree first, so that
    a filter never costs neighbours. Rows without a vector have no distance, and
    vectors of another length than the query's are no neighbours.
    """

    def run(c: Side, q: Side, _: bool) -> dict[str, np.ndarray]:
        out = []
        for start in range(0, len(q.ids), AT_ONCE):
            ids, vectors = q.ids[start : start + AT_ONCE], q.vectors[start : start + AT_ONCE]
            near, off = near_squares(vectors, c.vectors)
            if len(c.ids) > k:
                # no row whose rounded distance may be the k-th's is left out
                kth = np.maximum(np.partition(near, k - 1, axis=1)[:, k - 1], 0)[:, None]
                rows, at = np.nonzero(near <= kth + 2 * off + 1e-8 * np.sqrt(kth + off) + 1e-16)
            else:
                rows, at = (i.ravel() for i in np.indices(near.shape))
            d = paired_distances(vectors[rows], c.vectors[at])
            # a little more than k: the final order is by rounded distance, then id
            order = np.lexsort((c.ids[at], np.round(d, 9), rows))
            rows, at, d = rows[order], at[order], d[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            out.append((ids[rows][place < k + TIES], c.ids[at][place < k + TIES], d[place < k + TIES]))
        return dict(zip(("query_id", "vec_id", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    kept = [same] if same else []
    left = corpus.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *kept)
    right = queries.select(F.col("query_id").alias("id"), "vector", *kept)
    found = blocked(left, right, same, run, "query_id long, vec_id long, distance double")
    return top(found, [F.round("distance", 9), F.col("vec_id")], k)


def fuse(lists: dict[str, DataFrame], weights: dict[str, float], constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, item, rank) lists; ties go to the smaller item."""
    parts = [df.select("query_id", "item", (F.lit(weights[name]) / (constant + F.col("rank"))).alias("part")) for name, df in lists.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "item").agg(F.sum("part").alias("score"))


def best_per_source(ranked: DataFrame, source: str = "source") -> DataFrame:
    """The best row of each source; the first wins ties."""
    rank = F.row_number().over(Window.partitionBy("query_id", source).orderBy(F.desc("score"), F.col("item")))
    return ranked.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: Column | int, least: int = 0) -> DataFrame:
    """The front of each group while the running sum of ``cost`` fits; the first ``least`` rows in any case."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("running", run).withColumn("place", F.row_number().over(w)).filter((F.col("running") <= budget) | (F.col("place") <= least))

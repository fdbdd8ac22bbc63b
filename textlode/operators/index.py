"""An inverted index of texts, written once and asked by batches of queries.

Three Parquet tables in one folder: ``postings`` (term, doc, length, positions), in
folders by a hash of the term and sorted by term inside, a frequent term in several
files; ``terms`` (term, df), sorted over the whole, so that a prefix is a range; ``totals`` (one row).

A query reads the folders of its terms only. Postings are dealt by text and meet all queries in cells of bounded
size, each of which sends the first k of its texts for a query: what moves grows with postings and queries, not with
their product. In a cell, an AND query starts from its rarest term's texts. Of an OR query's most frequent term only the
k first texts are scored beside all texts of its other terms: a text that holds that term alone cannot be better.

An index for one batch of queries holds the postings of that batch's terms alone (``build`` with ``asked``): all texts
are read and counted, and what nobody asks does not move.

Terms are folded tokens; ``a b`` is a phrase of neighbours, and a star at the end makes the
last token a prefix. Null texts have no tokens; a key that occurs twice is two texts
of one name, whose scores add up. An index without texts answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators.search import inverse_frequency, small, term_score, top
from textlode.sources.shared import durable, stored

BUCKETS = 64
#: The folder of the texts' sizes, whose rows have no term, so that texts are split once.
SIZES = -1
#: Files of one bucket, to which the texts of a term are dealt.
SPREAD = 8
#: Query terms up to which their buckets are named to the reader, and up to which they are broadcast.
NAMED_TERMS, BROADCAST_TERMS = 10_000, 500_000


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    key: str  # type of the texts' keys

    def read(self, name: str) -> DataFrame:
        schemas = {
            "postings": f"term string, doc {self.key}, length int, positions array<int>, bucket int", "terms": "term string, df bigint",
            "totals": "n_docs bigint, mean_length double",
        }
        return self.spark.read.schema(schemas[name]).parquet(f"{self.folder}/{name}")


def opened(spark: SparkSession, folder: str) -> Index:
    """An index that was built before."""
    return Index(spark, folder, spark.read.parquet(f"{folder}/totals").schema["doc"].dataType.simpleString())


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", asked: DataFrame | None = None) -> Index:
    """Postings move once, to their bucket's files; each file is written in the order of its terms.

    With ``asked`` (term: tokens, phrases, prefixes) the index is for these terms alone, and answers them as a whole one does; above
    BROADCAST_TERMS of their tokens it is a whole one.
    """
    kind = docs.schema[key].dataType.simpleString()
    index = Index(docs.sparkSession, folder, kind)
    split = docs.select(F.col(key).alias("doc"), T.tokens(F.col(text)).alias("words"))
    schema = f"term string, doc {kind}, length int, positions array<int>"
    wanted = None
    if asked is not None:
        parts = asked.select(F.explode(F.split("term", " ")).alias("token")).filter("token <> ''").distinct().limit(BROADCAST_TERMS + 1)
        names = [r.token for r in parts.collect()]
        wanted = index.spark.sparkContext.broadcast(names) if len(names) <= BROADCAST_TERMS else None
    postings_ = split.select("doc", "words").mapInArrow(lambda batches: _places(batches, None if wanted is None else wanted.value), schema)
    bucket = F.when(F.col("term").isNull(), SIZES).otherwise(bucket_of(F.col("term")))
    postings_ = postings_.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(SPREAD)).cast("int"))
    dealt = postings_.repartition("bucket", "part").drop("part").sortWithinPartitions("bucket", "term", "doc")
    dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
    written = index.read("postings")
    tokens = F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda n, x: n + x))
    totals = written.filter(F.col("bucket") == SIZES).agg(F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("n_docs"), tokens.alias("tokens"))
    mean_length = F.when(F.col("n_docs") > 0, F.col("tokens") / F.col("n_docs")).otherwise(0.0)
    totals.select("n_docs", mean_length.alias("mean_length"), F.lit(None).cast(kind).alias("doc")).write.parquet(f"{folder}/totals")
    terms = written.filter(F.col("bucket") != SIZES).groupBy("term").agg(F.count("*").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    return index


#: Texts whose tokens are gathered at a time.
TEXTS = 100


def _places(batches: Iterator[pa.RecordBatch], wanted: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """A text's tokens (of those wanted, a star at the end for all that begin so) as one row a term, with its places, so that less moves; the sizes of all texts come as rows without a term."""
    names = pa.array([w for w in wanted or () if not w.endswith("*")], "string")
    fronts = [w[:-1] for w in wanted or () if w.endswith("*")]
    fronts = {n: pa.array([f for f in fronts if len(f) == n], "string") for n in {len(f) for f in fronts}}
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            words = part.column(1)
            tokens, rows = words.flatten(), pc.list_parent_indices(words).to_numpy()
            lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            places = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if wanted is not None:
                kept = pc.is_in(tokens, value_set=names)
                for n, front in fronts.items():
                    kept = pc.or_(kept, pc.is_in(pc.utf8_slice_codeunits(tokens, 0, n), value_set=front))
                kept = np.flatnonzero(kept.to_numpy(zero_copy_only=False))
                tokens, rows, places = tokens.take(pa.array(kept)), rows[kept], places[kept]
            sizes = pa.ListArray.from_arrays(pa.array([0, len(lengths)], "int32"), pa.array(lengths, "int32"))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, "string"), pa.nulls(1, part.column(0).type), pa.array([0], "int32"), sizes], names=["term", "doc", "length", "positions"])
            coded = tokens.dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.lexsort((codes, rows))  # stable: places stay in order
            rows, codes, places = rows[order], codes[order], places[order]
            starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])]) if len(rows) else np.zeros(0, "int64")
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(rows)], "int32"), pa.array(places, "int32"))
            of = pa.array(rows[starts], "int64")
            columns = [coded.dictionary.take(pa.array(codes[starts])), part.column(0).take(of), pa.array(lengths[rows[starts]], "int32"), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "doc", "length", "positions"])


def postings(index: Index, tokens: DataFrame) -> DataFrame:
    """term, doc, length, positions of the tokens (term), which a query's size bounds; only their buckets are read."""
    held, tokens = index.read("postings"), tokens.select("term").distinct()
    names = [r.term for r in tokens.limit(NAMED_TERMS + 1).collect()]
    if len(names) <= NAMED_TERMS:
        rows = index.spark.createDataFrame([(n,) for n in names], "term string").withColumn("bucket", bucket_of(F.col("term")))
        buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]
        held = held.filter(F.col("bucket").isin(buckets))
        if 0 < len(names) <= 100:
            held = held.filter(F.col("term").isin(names))
        tokens = F.broadcast(rows.select("term"))
    elif tokens.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        tokens = F.broadcast(tokens)
    return held.join(tokens, "term").select("term", "doc", "length", "positions")


def expanded(index: Index, prefixes: DataFrame) -> DataFrame:
    """prefix, term: the dictionary's terms that begin with each prefix (of a query: few)."""
    known = index.read("terms").select("term")
    return known.join(F.broadcast(prefixes.select("prefix").distinct()), F.col("term").startswith(F.col("prefix")))


def hits(index: Index, terms: DataFrame) -> DataFrame:
    """term, doc, length, tf of tokens, phrases (``a b``) and prefixes (``a*``, ``a b*``) alike."""
    terms = durable(terms.select("term").distinct())
    single = terms.filter(~F.contains("term", F.lit(" ")) & ~F.endswith("term", F.lit("*")))
    found = postings(index, single).select("term", "doc", "length", F.size("positions").cast("long").alias("tf"))
    several = terms.join(single, "term", "left_anti").select("term", F.posexplode(F.split("term", " ")).alias("place", "token"), F.size(F.split("term", " ")).alias("n"))
    several = durable(several)
    if several.isEmpty():
        return found
    prefix = several.filter(F.endswith("token", F.lit("*"))).withColumn("prefix", F.regexp_replace("token", "\\*$", ""))
    spelled = prefix.join(expanded(index, prefix).withColumnRenamed("term", "word"), "prefix").select("term", "place", "n", "word")
    spelled = durable(spelled.unionByName(several.filter(~F.endswith("token", F.lit("*"))).select("term", "place", "n", F.col("token").alias("word"))))
    held = postings(index, spelled.select(F.col("word").alias("term"))).withColumnRenamed("term", "word")
    starts = F.transform("positions", lambda p: p - F.col("place"))
    held = held.join(spelled, "word").select("term", "n", "doc", "length", "place", starts.alias("starts"))
    # a place that several words can take has the union of their starts
    by_place = held.groupBy("term", "n", "doc", "length", "place").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    whole = by_place.groupBy("term", "n", "doc", "length").agg(F.collect_list("starts").alias("all")).filter(F.size("all") == F.col("n"))
    common = F.aggregate(F.slice("all", 2, 1_000), F.array_distinct(F.element_at("all", 1)), lambda a, b: F.array_intersect(a, b))
    phrases = whole.select("term", "doc", "length", F.size(common).cast("long").alias("tf")).filter("tf > 0")
    return found.unionByName(stored(phrases))  # read several times, and narrower than what makes them


#: Postings and terms of queries that a cell holds on average, and its least number of parts by text.
CELL_POSTINGS, CELL_TERMS, CELLS = 2_000_000, 200_000, 8


class Lists:
    """The postings of a cell as one sorted list of texts for each term, and texts by number in their own order."""

    def __init__(self, postings: pa.Table, terms: pa.Array):
        docs = postings["doc"].combine_chunks()
        self.docs = docs.unique()
        self.docs = self.docs.take(pc.sort_indices(self.docs))
        n = max(1, len(self.docs))
        keys = pc.index_in(postings["term"], value_set=terms).to_numpy().astype("i8") * n + pc.index_in(docs, value_set=self.docs).to_numpy().astype("i8")
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], postings["weight"].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, "i8")
        self.weights = np.add.reduceat(weights, first) if len(first) else weights  # texts of one key add up
        of, self.numbers = keys[first] // n, keys[first] % n
        self.ends = np.searchsorted(of, np.arange(len(terms) + 1))
        self.sizes = np.diff(self.ends)
        self.firsts: dict[int, np.ndarray] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[term], self.ends[term + 1])
        return self.numbers[at], self.weights[at]

    def first(self, term: int, idf: float, k: int) -> np.ndarray:
        """The first ``k`` texts by this term alone; its idf is the same in all queries."""
        if term not in self.firsts:
            numbers, weights = self.of(term)
            self.firsts[term] = np.sort(numbers[foremost(numbers, idf * weights, k)])
        return self.firsts[term]

    def add(self, term: int, idf: float, numbers: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Adds the term's part to the scores of the texts that hold it; which they are."""
        own, weights = self.of(term)
        if not len(own):
            return np.zeros(len(numbers), bool)
        at = np.minimum(np.searchsorted(own, numbers), len(own) - 1)
        held = own[at] == numbers
        scores[held] += idf * weights[at[held]]
        return held


def levels(scores: np.ndarray) -> np.ndarray:
    """Scores to nine places, as whole numbers: below that sums differ by their order."""
    return np.rint(scores * 1e9).astype("i8")


def foremost(numbers: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by level (descending) and number."""
    level, at = levels(scores), np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(level >= np.partition(level, len(level) - k)[len(level) - k])
    return at[np.lexsort((numbers[at], -level[at]))][:k]


def _cell(postings: pa.Table, queries: pa.Table, k: int, every: bool) -> pa.Table:
    """query_id, doc, score, level: the first ``k`` texts of each query among those of (term, doc, weight); queries are (query_id, term, idf)."""
    terms = queries["term"].combine_chunks().unique()
    lists = Lists(postings.filter(pc.is_in(postings["term"], value_set=terms)), terms)
    ids = queries["query_id"].combine_chunks().dictionary_encode()
    of, term, idf = ids.indices.to_numpy(), pc.index_in(queries["term"], value_set=terms).to_numpy(), queries["idf"].to_numpy()
    order = np.lexsort((term, lists.sizes[term], of))  # a query's rarest term first
    of, term, idf = of[order], term[order], idf[order]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    ends = np.r_[starts[1:], len(of)]
    able = lists.sizes[term[starts if every else ends - 1]] > 0
    found: list[list[np.ndarray]] = [[np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]]
    for a, b in zip(starts[able].tolist(), ends[able].tolist(), strict=True):
        last = lists.first(int(term[b - 1]), idf[b - 1], k)
        if b - a == 1:
            numbers = last
        elif every:
            numbers = lists.of(term[a])[0]
        else:
            numbers = np.unique(np.concatenate([last, *(lists.of(t)[0] for t in term[a : b - 1])]))
        scores = np.zeros(len(numbers))
        for t, w in zip(term[a:b], idf[a:b], strict=True):
            held = lists.add(t, w, numbers, scores)
            if every:
                numbers, scores = numbers[held], scores[held]
        at = foremost(numbers, scores, k)
        for column, values in zip(found, (np.full(len(at), of[a]), numbers[at], scores[at]), strict=True):
            column.append(values)
    query, number, score = map(np.concatenate, found)
    return pa.table({"query_id": ids.dictionary.take(pa.array(query)), "doc": lists.docs.take(pa.array(number)), "score": score, "level": levels(score)})


def search(index: Index, queries: DataFrame, k: int, every: bool = True) -> DataFrame:
    """query_id, doc, score, rank: the first ``k`` texts that hold every term of a query (or any), by BM25 and the text's key.

    ``queries``: query_id, term (distinct for a query), n_terms.
    """
    totals = F.broadcast(index.read("totals").select("n_docs", "mean_length"))  # one row
    queries = durable(queries.select("query_id", "term", "n_terms"))
    n_queries = queries.count()
    asked = lambda df: small(df, n_queries)
    held = hits(index, queries)
    plain = queries.select("term").distinct().filter(~F.contains("term", F.lit(" ")) & ~F.endswith("term", F.lit("*")))
    known = index.read("terms").join(asked(plain), "term").select("term", "df")
    known = known.unionByName(held.join(asked(plain), "term", "left_anti").groupBy("term").agg(F.count("*").alias("df")))
    weighed = queries.join(known, "term").crossJoin(totals).withColumn("idf", inverse_frequency(F.col("n_docs"), F.col("df")))
    weighed = durable(weighed.select("query_id", "term", "n_terms", "df", "idf"))
    if every:
        whole = weighed.groupBy("query_id", "n_terms").agg(F.count("*").alias("n")).filter("n = n_terms").select("query_id")
        weighed = durable(weighed.join(asked(whole), "query_id", "left_semi"))
    rows = weighed.count()
    n_postings = weighed.groupBy("term").agg(F.max("df").alias("df")).agg(F.sum("df")).first()[0] or 0
    parts, shares = max(CELLS, -(-n_postings // CELL_POSTINGS)), max(1, -(-rows // CELL_TERMS))
    weight = term_score(F.lit(1.0), F.col("tf"), F.col("length"), F.col("mean_length"))
    # what no whole query asks need not move
    left = held.filter("doc IS NOT NULL").join(asked(weighed.select("term").distinct()), "term", "left_semi").crossJoin(totals)
    left = left.select(F.pmod(F.xxhash64("doc"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "term", "doc", weight.alias("weight"))
    right = weighed.select(F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share"), F.explode(F.sequence(*(F.lit(n).cast("long") for n in (0, parts - 1)))).alias("part"), "query_id", "term", "idf")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, doc {index.key}, score double, level long"
    found = left.groupBy("part", "share").cogroup(right.groupBy("part", "share")).applyInArrow(lambda x, y: _cell(x, y, k, every), schema)
    return top(found, [F.desc("level"), F.col("doc")], k).drop("level")


#: What a word of a query is, what its edges lose where texts are searched as they are, and the shortest prefix.
NO_WORD = r"[^\p{L}\p{N}\s_-]"
RAW_TERM = r'"([^"]+)"|(\S+)'
EDGES = r"^[`'\"()\[\]{}<>.,:;!?*_+=|\\/-]+|[`'\"()\[\]{}<>.,:;!?*_+=|\\/-]+$"
SHORTEST_PREFIX = 3


def words_of(query: Column) -> Column:
    """The words of a query, signs apart."""
    return F.filter(F.split(F.regexp_replace(query, NO_WORD, " "), r"\s+"), lambda w: w != "")


def phrase(word: Column) -> Column:
    """A word's tokens as a phrase."""
    return F.array_join(T.tokens(word), " ")


def like_terms(query: Column) -> Column:
    """Distinct parts of a query, quoted ones whole, without signs at their edges; if there are none, the query itself."""
    bare = lambda c: F.lower(F.regexp_replace(F.trim(c), EDGES, ""))
    parts = F.transform(F.regexp_extract_all(query, F.lit(RAW_TERM), F.lit(0)), lambda m: bare(F.when(F.startswith(m, F.lit('"')) & (F.length(m) > 2) & F.endswith(m, F.lit('"')), F.substring(m, F.lit(2), F.greatest(F.length(m) - 2, F.lit(0)))).otherwise(m)))
    kept = F.array_distinct(F.filter(parts, lambda t: t != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(F.array(bare(query)), lambda t: t != ""))


def _phrases(query: Column) -> Column:
    return F.transform(words_of(query), phrase)


def _starred(query: Column) -> Column:
    """The terms of a query whose last word is a prefix."""
    words = words_of(query)
    last = F.try_element_at(words, F.lit(-1))
    return F.concat(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), phrase), F.array(F.concat(phrase(last), F.lit("*"))))


def _by_prefix(query: Column) -> Column:
    """Whether a query is one word that is long enough to be a prefix."""
    words, n_raw = words_of(query), F.size(F.split(F.regexp_replace(query, r"^\s+|\s+$", ""), r"\s+"))
    return (n_raw == 1) & (F.size(words) > 0) & (F.length(F.try_element_at(words, F.lit(-1))) >= SHORTEST_PREFIX)


def asked(queries: DataFrame) -> DataFrame:
    """term: all that the ladder may look for in an index, for queries (query_id, query)."""
    query = F.col("query")
    starred = F.when(_by_prefix(query) & ~F.contains(F.try_element_at(words_of(query), F.lit(-1)), F.lit("-")), _starred(query)).otherwise(F.array().cast("array<string>"))
    return queries.select(F.explode(F.concat(_phrases(query), starred)).alias("term")).filter("term NOT IN ('', '*')").distinct()


def _terms(queries: DataFrame, terms: Column) -> DataFrame:
    """query_id, term, n_terms; queries without terms drop out."""
    distinct = queries.select("query_id", F.array_distinct(F.filter(terms, lambda t: t != "")).alias("terms"))
    return distinct.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def ladder(index: Index, docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", newest: str | None = None) -> DataFrame:
    """query_id, step, doc, rank: for each query (query_id, query) what its first step with results finds.

    Steps: every word (``and``); for queries of two words or more any word (``or``); for one
    word its texts by prefix, of three characters or more (``prefix``). A prefix with a hyphen is no query of
    the index: its parts are looked for inside the texts, whatever their place (``like``), the first by ``newest``
    (descending) or the key.
    """
    queries = durable(queries.select("query_id", "query"))
    query = F.col("query")
    n_raw = F.size(F.split(F.regexp_replace(query, r"^\s+|\s+$", ""), r"\s+"))
    without = lambda found, asked: asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
    strict = durable(search(index, _terms(queries, _phrases(query)), k).withColumn("step", F.lit("and")))
    left = durable(without(strict, queries))
    several, single = left.filter(n_raw >= 2), left.filter(n_raw == 1)
    any_word = search(index, _terms(several, _phrases(query)), k, every=False).withColumn("step", F.lit("or"))
    last, long = F.try_element_at(words_of(query), F.lit(-1)), single.filter(_by_prefix(query))
    by_prefix = search(index, _terms(long.filter(~F.contains(last, F.lit("-"))), _starred(query)), k).withColumn("step", F.lit("prefix"))
    found = strict.unionByName(any_word).unionByName(by_prefix).select("query_id", "step", "doc", F.col("rank").cast("long").alias("rank"))
    inside = durable(long.filter(F.contains(last, F.lit("-"))).select("query_id", like_terms(F.col("query")).alias("terms")))
    if inside.isEmpty():
        return found
    parts = F.broadcast(inside.agg(F.collect_list(F.struct("query_id", "terms")).alias("asked")))  # one row: queries of this kind
    held = F.filter("asked", lambda q: (F.size(q["terms"]) > 0) & F.forall(q["terms"], lambda t: F.contains("low", t)))
    # lowered before the join: inside the filter it would be done anew for each term
    low = docs.select(F.col(key).alias("doc"), F.col(key if newest is None else newest).alias("newest"), F.lower(F.col(text)).alias("low"))
    hit = low.crossJoin(parts).select("doc", "newest", F.explode(held).alias("q")).select("q.query_id", "doc", "newest")
    like = top(hit, [F.desc("newest"), F.col("doc")], k).select("query_id", F.lit("like").alias("step"), "doc", F.col("rank").cast("long").alias("rank"))
    return found.unionByName(like)


def snippet(text: str | None, phrases: list[str], size: int = 32) -> str | None:
    """The window of ``size`` tokens that holds most of the phrases, then most places; ``...`` where it cuts.

    Windows begin where their places lie in the middle, or at the sentence of a place,
    which counts for more: ``120`` at the text's front, ``100`` elsewhere.
    """
    import regex

    if text is None:
        return None
    spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    table = str.maketrans(T.MARKED, T.PLAIN)
    tokens = [text[a:b].lower().translate(table) for a, b in spans]
    places = []
    for number, wanted in enumerate(phrases):
        parts, prefix = wanted.rstrip("*").split(" "), wanted.endswith("*")
        for at in range(len(tokens) - len(parts) + 1):
            held = tokens[at : at + len(parts)]
            if held[:-1] == parts[:-1] and (held[-1].startswith(parts[-1]) if prefix else held[-1] == parts[-1]):
                places.append((at, number, len(parts)))
    places.sort()
    sentences = [0]
    for i, (start, _) in enumerate(spans[1:], 1):
        before = text[:start].rstrip(" \t\n\r")
        if len(before) < start and before[-1:] in (".", ":"):
            sentences.append(i)

    def value(start: int) -> tuple[int, int]:
        """Score of a window, and the start that centres its places."""
        inside = [p for p in places if start <= p[0] < start + size]
        score = sum(1 if any(q[1] == p[1] for q in inside[:i]) else 1000 for i, p in enumerate(inside))
        first, end = inside[0][0], inside[-1][0] + inside[-1][2]
        return score, max(0, min(first - (size - (end - first)) // 2, len(tokens) - size))

    best, start = 0, 0
    for at, _, _ in places:
        score, centred = value(at)
        if score > best:
            best, start = score, centred
        if len(tokens) > size:
            opening = max(s for s in sentences if s <= at)
            if opening < at:
                score = value(opening)[0] if any(opening <= p[0] < opening + size for p in places) else 0
                score += 120 if opening == 0 else 100
                if score > best:
                    best, start = score, opening
    stop = start + size
    front = "..." + text[spans[start][0] :] if start > 0 else text
    cut = 0 if start == 0 else spans[start][0] - 3
    return front if stop >= len(tokens) else front[: spans[stop - 1][1] - cut] + "..."


def snippets(found: DataFrame, docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``found`` with the snippet of each row: the best window of what the index finds, else what stands around the first part."""
    words = words_of(F.col("query"))
    said = queries.select("query_id", F.filter(F.transform(words, phrase), lambda p: p != "").alias("phrases"), like_terms(F.col("query")).alias("parts"))
    rows = found.join(said, "query_id").join(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc")
    star = F.concat(F.slice("phrases", F.lit(1), F.greatest(F.size("phrases") - 1, F.lit(0))), F.array(F.concat(F.try_element_at("phrases", F.lit(-1)), F.lit("*"))))
    rows = rows.withColumn("phrases", F.when(F.col("step") == "prefix", star).when(F.col("step") == "like", F.array().cast("array<string>")).otherwise(F.col("phrases")))

    @F.pandas_udf("string")
    def window(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, list(p)) for t, p in zip(texts, phrases, strict=True)], dtype="object")

    around = T.snippet_around(F.col("text"), F.col("parts"))
    return rows.select(*found.columns, F.when(F.col("step") == "like", around).otherwise(window("text", "phrases")).alias("snippet"))

"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated 8-word
windows. The verdict is a hashed n-gram log-likelihood ratio: words and pairs of
neighbouring words fall into ``buckets`` hash buckets; two multinomials over the
buckets, of trusted rows and of the whole corpus (add-one), give a log ratio for
each bucket; a document's score is the mean over its n-grams, so length does not
matter. The trusted multinomial has the corpus' own as its prior, with the mass of
``prior`` n-grams a bucket: where few rows are trusted the ratios shrink towards
0 instead of rejecting all that the few do not show. Every document is held against one fixed threshold.

The corpus is counted whole. Counting explodes n-grams and sums map-side, so at
most ``buckets`` rows a task are shuffled; the table of ratios has ``buckets``
entries whatever the data. The trusted model is fitted on at most
``trusted_rows`` labelled rows, the first in the order of a hash of their ids;
their ids are what is broadcast, and nothing else.

Null or blank text has no words and fails the base rules. Texts without n-grams
score 0. Without any trusted row every ratio is 0 and only base rules reject.
Repeated rows get repeated results. A table without rows gives none. ``judge``
reads doc_id and text only; ``keep`` returns the columns of its input whatever
their names are. Hashes have 64 bits: two different windows
count as equal with a probability of 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import WORD, words_of

BUCKETS = 1 << 14
TRUSTED_ROWS = 50_000
PRIOR = 8
LEAST_SCORE = -0.08
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def grams(hashes: Column, buckets: int) -> Column:
    """Bucket numbers of words and neighbouring pairs, from the words' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_words(hashes: Column) -> Column:
    """Words covered by a window that stands twice or more in the text."""
    n = F.size(hashes)
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        again = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda e, i: (F.when(i > 0, F.get(s, i - 1)["h"] == e["h"]).otherwise(False))
                | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
            ),
        )
        places = F.sort_array(F.transform(again, lambda e: e["at"]))
        steps = let(
            places,
            lambda p: F.transform(
                p, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, F.greatest(i - 1, F.lit(0)))))
            ),
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def measured(text: Column, hashes: Column, ratios: Column, buckets: int) -> dict[str, Column]:
    """The base measures and the score of a text, from it and its words' hashes."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    gathered = F.aggregate(grams(hashes, buckets), F.lit(0.0), lambda total, b: total + F.get(ratios, b))
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(hashes).cast("long"),
        "score": gathered / F.greatest(2 * F.size(hashes) - 1, F.lit(1)),
    }


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids of rows labelled good."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, prior: float = PRIOR) -> Column:
    """The array of log ratios by bucket, as a constant: ``buckets`` numbers pass the driver, whatever the data."""
    trusted = F.broadcast(trusted_ids(labels, trusted_rows).select(F.col("doc_id").alias("trusted_id")))
    flagged = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    hashed = flagged.select(F.col("trusted_id").isNotNull().cast("long").alias("good"), word_hashes(words_of(F.col("text"))).alias("hashes"))
    exploded = hashed.select("good", F.explode(grams(F.col("hashes"), buckets)).alias("bucket"))
    counts = exploded.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "good")))
    table = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("rows"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    corpus = lambda x: (x["raw"] + 1) / (F.col("raw") + buckets)
    trusted_part = lambda x: (x["good"] + prior * buckets * corpus(x)) / (F.col("good") + prior * buckets)
    ratio = F.transform("rows", lambda x: F.log(trusted_part(x)) - F.log(corpus(x)))
    ratios = table.select(ratio.alias("ratios")).first()["ratios"]
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def judge(
    docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS
) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and score of every document."""
    ratios = log_ratios(docs, labels, buckets, trusted_rows)

    def verdict(hashes: Column) -> Column:
        m = measured(F.col("text"), hashes, ratios, buckets)
        base_failed = failed(m["n_words"], m["n_repeat_words"])
        return F.struct(*(c.alias(n) for n, c in m.items()), base_failed.alias("base_failed"))

    # bound by let: the optimiser would copy a column of hashes into each place of a later filter that names it
    found = docs.select("doc_id", let(word_hashes(words_of(F.col("text"))), verdict).alias("m")).select("doc_id", "m.*")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= least_score)).alias("kept"), F.round("score", 9).alias("score"),
    )


def keep(
    docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS
) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, in one pass and without a join."""
    ratios = log_ratios(docs, labels, buckets, trusted_rows)

    def kept(hashes: Column) -> Column:
        m = measured(F.col("text"), hashes, ratios, buckets)
        return ~failed(m["n_words"], m["n_repeat_words"]) & (m["score"] >= least_score)

    return docs.filter(let(word_hashes(words_of(F.col("text"))), kept))

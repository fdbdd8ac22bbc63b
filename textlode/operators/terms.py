"""Known terms in texts, all in one pass.

An Aho-Corasick automaton finds thousands of terms of one or several words while it
reads a text once. It is built from a broadcast list in each Python worker. The
list's size is counted first: up to ``SHARD`` terms or ``SHARD_CHARS`` characters make
one shard; larger lists are dealt to several by hash, and each shard reads the texts
on its own, so that no worker holds more than one shard.

Case does not count. Terms that are empty, above 100 characters, or hold other signs
than letters, digits, spaces and ``-_.'"`` are none. Null texts hold nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = 50_000
SHARD_CHARS = 2_000_000
#: What a term may be.
LONGEST, VALID = 100, r"^[\p{L}\p{N}\s\-_.'" + '"]+$'
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def listed(known: DataFrame, column: str = "term", any_sign: bool = False) -> DataFrame:
    """Valid terms, trimmed; of those that differ by case the first. With ``any_sign`` all that are not empty are valid."""
    term = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    fits = F.length("term") > 0 if any_sign else F.length("term").between(1, LONGEST) & F.col("term").rlike(VALID)
    valid = known.select(term.alias("term")).filter(fits)
    return valid.groupBy(F.lower("term").alias("low")).agg(F.min("term").alias("term")).select("term")


class Finder:
    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in terms:
            self.automaton.add_word(term.lower(), (term, len(term.lower())))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[str, tuple[int, bool]]:
        """Of each term its first place between word boundaries, else its first place at all."""
        low, found = text.lower(), {}
        n = len(low)
        for end, (term, length) in self.automaton.iter(low):
            known = found.get(term)
            if known is not None and known[1]:  # the first place between boundaries stays
                continue
            start = end - length + 1
            left = start > 0 and low[start - 1] in WORD
            right = end + 1 < n and low[end + 1] in WORD
            bounded = left != (low[start] in WORD) and right != (low[end] in WORD)
            if known is None or bounded:
                found[term] = start, bounded
        return found


def find(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", column: str = "term", any_sign: bool = False) -> DataFrame:
    """key, term, at (from 0) and bounded, for each term that a text holds."""
    spark, terms = docs.sparkSession, listed(known, column, any_sign)
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD), -(-chars // SHARD_CHARS))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, term string, at int, bounded boolean"
    found = None
    for shard in range(shards):
        part: Column = F.pmod(F.xxhash64("term"), F.lit(shards)) == shard
        shared = spark.sparkContext.broadcast({"terms": [r.term for r in terms.filter(part).collect()]})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            stored = shared.value
            if "finder" not in stored:
                stored["finder"] = Finder(stored["terms"]) if stored["terms"] else None
            finder = stored["finder"]
            for batch in batches if finder else ():
                for at in range(0, batch.num_rows, 1000):
                    piece = batch.slice(at, 1000)
                    held = [finder.find(t) if t else {} for t in piece.column(1).to_pylist()]
                    place = pa.array([i for i, h in enumerate(held) for _ in h], "int32")
                    values = [(t, *v) for h in held for t, v in h.items()]
                    columns = [pa.array([v[k] for v in values], t) for k, t in enumerate(("string", "int32", "bool"))]
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(place), *columns], names=[key, "term", "at", "bounded"])

        here = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        found = here if found is None else found.unionByName(here)
    return found

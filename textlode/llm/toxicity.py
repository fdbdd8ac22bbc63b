"""Toxicity: FTRL-proximal logistic regression over hashed n-grams.

Features are lower-case words, neighbouring pairs, pairs with one word between,
and the fronts of longer words (which join the forms of a word), hashed to 2 ** ``bits`` places; a text's value at a place is 1 if any
of its n-grams falls there. FTRL-proximal keeps a rate for each coordinate, and
its L1 term leaves most weights exactly 0, so that the weights are a short list
of at most 2 ** ``bits`` numbers: that bound, not the data, sizes what passes
the driver and is broadcast.

The model is fitted on at most ``rows`` labelled rows, the first in the order of
a hash of their ids, in ``epochs`` passes in that order by one task; scoring
covers every text whole. Scores use nothing but the text.

Null text counts as empty and scores as the bias does. Labels of ids that
``documents`` lacks do nothing; an id with several labels counts as toxic if any
is; null ids and null labels are no training rows. Without training rows every
score is 0.5. Repeated rows get repeated scores. A table without rows gives none.
A very long text is one array of at most 2 ** ``bits`` places. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import ascii_lower, map_rows


#: Bytes of a word's front that stand for its forms.
STEMS = (6, 7)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 4
    rows: int = 20_000


class Features:
    """Places of a text's n-grams, with a bounded cache of word hashes."""

    def __init__(self, bits: int):
        self.shift, self.cache = np.uint64(64 - bits), {}

    def hash(self, word: bytes) -> int:
        if len(self.cache) > 500_000:
            self.cache.clear()
        found = self.cache[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def places(self, text: str | None) -> np.ndarray:
        """Place 0 is the bias."""
        cache, words = self.cache, ascii_lower((text or "").encode()).split()
        words = [w.strip(b".,;:!?\"'()") or w for w in words]
        h = np.array([cache.get(w) or self.hash(w) for w in words], "u8")
        odd = np.uint64(0x9E3779B97F4A7C15)
        near = h[:-1] * odd + h[1:] if len(h) > 1 else h[:0]
        skip = h[:-2] * odd + h[2:] + np.uint64(1) if len(h) > 2 else h[:0]
        stems = [self.cache.get(w[:n]) or self.hash(w[:n]) for n in STEMS for w in words if len(w) > n]
        every = np.concatenate([h, near, skip, np.array(stems, "u8") + np.uint64(2)]) * odd
        return np.unique(np.concatenate([np.zeros(1, "u8"), every >> self.shift])).astype("i8")


def fit_rows(rows: list[tuple[np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights after ``epochs`` passes over (places, label) in order."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - np.where(i == 0, 0.0, s.l1), 0.0)
        return -shrunk / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for i, y in rows:
            w = weights(i)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(1 << s.bits))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings) -> dict[int, float]:
    """Nonzero weights by place, from labelled rows whose doc_id meets ``usable``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("labelled"), "toxic"))
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("labelled"))
    texts = texts.select("text", "toxic", F.xxhash64("doc_id").alias("place"), "doc_id").repartition(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Features(settings.bits), []
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((features.places(text), int(toxic == 1)))
        w = fit_rows(rows, settings) if rows else np.zeros(1 << settings.bits)
        (used,) = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i8")), pa.array(w[used])], names=["place", "weight"])

    ordered = texts.sortWithinPartitions("place", "doc_id", "text").select("text", "toxic")
    return {r.place: r.weight for r in ordered.mapInArrow(train, "place long, weight double").collect()}


def score(docs: DataFrame, weights: dict[int, float], settings: Settings) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((list(weights), list(weights.values())))

    def make():
        places, values = shared.value
        w = np.zeros(1 << settings.bits)
        w[np.array(places, "i8")] = values
        features = Features(settings.bits)
        return lambda k, t: (k, 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[features.places(t)].sum()))))))

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double")

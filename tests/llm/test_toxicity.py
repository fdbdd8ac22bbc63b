import math
import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from textlode.llm import toxicity

SF = "/root/testdata/sf0.01"


def rows(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), "dolt" if i % 2 else "blockhead")
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_rerun(spark):
    data = rows(600)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(9999, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    settings = toxicity.Settings(l1=1.0)
    weights = toxicity.fit(docs, labels, F.col("doc_id") < 400, settings)
    assert weights == toxicity.fit(docs, labels, F.col("doc_id") < 400, settings)
    dense = toxicity.fit(docs, labels, F.col("doc_id") < 400, toxicity.Settings(l1=0.0, epochs=1))
    assert len(weights) < 0.1 * len(dense)
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights, settings).collect()}
    hits = [(got[i] >= 0.3) == bool(y) for i, _, y in data if i >= 400]
    assert np.mean(hits) > 0.97


def ftrl(rows, s):
    """FTRL-proximal one coordinate at a time, over sets of places."""
    z, n = {}, {}

    def weight(i):
        least = 0.0 if i == 0 else s.l1
        if abs(z.get(i, 0.0)) <= least:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * least) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for places, y in rows:
            w = {i: weight(i) for i in places}
            p = 1 / (1 + math.exp(-sum(w.values())))
            for i in places:
                g, before = p - y, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i) != 0.0}


def test_against_scalar_ftrl(spark):
    data = rows(150, seed=4) + [(150, None, 0), (151, "", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    settings = toxicity.Settings(bits=12, l1=0.5, epochs=3)
    order = [r.doc_id for r in labels.filter("doc_id < 120").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    features, by_id = toxicity.Features(12), {i: (t, y) for i, t, y in data}
    want = ftrl([(features.places(by_id[i][0]).tolist(), by_id[i][1]) for i in order], settings)
    got = toxicity.fit(docs, labels, F.col("doc_id") < 120, settings)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    for r in toxicity.score(docs, got, settings).collect():
        total = sum(want.get(i, 0.0) for i in features.places(by_id[r.doc_id][0]).tolist())
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_places_are_hashed_grams_and_skip_grams():
    """Words, fronts of words, neighbours and words with one between, each by its own hash."""
    odd, wide = 0x9E3779B97F4A7C15, 1 << 64
    name = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    text = "Some of, THE unreadable unreadably x"
    words = ["some", "of", "the", "unreadable", "unreadably", "x"]
    every = [name(w) for w in words] + [(name(a) * odd + name(b)) % wide for a, b in zip(words, words[1:], strict=False)]
    every += [(name(a) * odd + name(b) + 1) % wide for a, b in zip(words, words[2:], strict=False)]
    every += [(name(w[:n]) + 2) % wide for n in toxicity.STEMS for w in words if len(w) > n]
    want = {0} | {(x * odd % wide) >> (64 - 18) for x in every}
    assert set(toxicity.Features(18).places(text).tolist()) == want


def test_bound_on_rows(spark):
    data = rows(100)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    few = toxicity.fit(docs, labels, F.lit(True), toxicity.Settings(rows=5, l1=0.0))
    assert len(few) <= 5 * 60 * 5


def test_edge_rows(spark):
    settings = toxicity.Settings()
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = toxicity.fit(docs, labels, F.lit(True), settings)
    got = toxicity.score(docs, weights, settings).collect()
    assert weights == {} and len(got) == 5 and {r.score for r in got} == {0.5}
    assert toxicity.score(docs.limit(0), weights, settings).count() == 0


def test_real_labels(spark):
    from textlode.llm.queries import op6_toxicity

    got = {r.doc_id: r for r in op6_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert np.mean([p == y for p, y in held]) > 0.85

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlode.operators import packing, search


def vectors(n, labels, size=4, seed=1):
    rng = random.Random(seed)
    return [(i, i % labels if labels else 0, [rng.gauss(0, 1) for _ in range(size)]) for i in range(n)]


SCHEMA = "vec_id long, label long, embedding array<double>"


def test_small_groups_move_once_to_each_side(spark, monkeypatch):
    """Rows that blocks see grow with the rows, however many small labels there are; a hot label is many blocks."""
    monkeypatch.setattr(search, "BLOCK", 50)

    def seen(rows):
        df = spark.createDataFrame(rows, SCHEMA).select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        run = lambda a, b, same: {"n": np.array([len(a.ids) + len(b.ids)])}
        return [r.n for r in search.blocked(df, None, "label", run, "n long").collect()]

    for n in (200, 800):
        assert sum(seen(vectors(n, n // 10))) == 2 * n
    hot = seen(vectors(400, 0))
    assert len(hot) == 8 * 9 // 2 and max(hot) < 200


def test_close_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rows = vectors(120, 3, size=2)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and cosine(a[2], b[2]) >= 0.95}
    got = packing.close_pairs(spark.createDataFrame(rows, SCHEMA), "label", 0.95).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_odd_vectors_are_no_neighbours(spark):
    rows = [(0, 1, [0.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0]), (3, 1, None), (4, None, [0.0, 1.0]), (5, 1, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    got = {(r.query_id, r.vec_id): r.distance for r in search.nearest(df, asked, 5).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, 4): 1, (1, 0): 1, (1, 1): 0, (1, 4): math.sqrt(2), (2, 2): 0, (4, 0): 1, (4, 1): math.sqrt(2), (4, 4): 0, (5, 5): 0}
    same = {(r.query_id, r.vec_id) for r in search.nearest(df, asked, 5, "label").collect()}
    assert same == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (5, 5)}
    assert search.nearest(df.limit(0), asked, 5).count() == 0


def plain_bm25(texts, queries):
    split = {k: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split()] for k, t in texts}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    count = lambda words, term: sum(words[i : i + len(term)] == term for i in range(len(words)))
    out = {}
    for q, text in enumerate(queries):
        terms = [t for t in dict.fromkeys(" ".join("".join(c.lower() if c.isalnum() else " " for c in w).split()) for w in text.split()) if t]
        tf = {k: [count(words, t.split()) for t in terms] for k, words in split.items()}
        df = [sum(tf[k][j] > 0 for k in tf) for j in range(len(terms))]
        for k, words in split.items():
            if terms and all(tf[k]):
                idf = [math.log((n - d + 0.5) / (d + 0.5)) for d in df]
                idf = [1e-6 if i <= 0 else i for i in idf]
                out[q, k] = sum(i * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean)) for i, f in zip(idf, tf[k], strict=True))
    return out


@pytest.mark.parametrize("row_terms", [5_000, 2])
def test_bm25_by_lookup_and_by_join(spark, monkeypatch, row_terms):
    monkeypatch.setattr(search, "ROW_TERMS", row_terms)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("a b c d sub-agent agent sub e f g h".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    queries = ["a b", "sub-agent", "agent", "zzz a", "c", "", "a a"]
    want = plain_bm25(texts, queries)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in search.bm25(df, search.query_table(spark, queries), len(queries)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

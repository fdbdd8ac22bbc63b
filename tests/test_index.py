"""The index, its ladder and its snippets against SQLite's full-text search."""

import random
import sqlite3

import pytest

from textlode.functions import text as T
from textlode.operators import index as ix
from textlode.operators import search
from pyspark.sql import functions as F

WORDS = "red blue bolt ring gear box sub agent sub-agent café the the the of and running runner run".split()


def corpus(seed, n):
    rng = random.Random(seed)
    sign = lambda: rng.choice([" ", " ", " ", ", ", ". ", ": ", "\n"])
    return [(i, "".join(rng.choice(WORDS) + sign() for _ in range(rng.randint(0, 120)))) for i in range(n)]


ROWS = corpus(1, 80) + [(80, None), (81, ""), (82, "lonely runabout"), (83, "xx sub-marine yy"), (84, "Well-known. foo bar_baz qux")]
QUERIES = [
    "red bolt", "sub-agent", "cafe", "zzz lonely", "runa", "ru", "sub-mar", "nothing here", "the of", "", "  ", "bar_ba", "bar_baz qux", "!!", "red", "lonely!", "runab", "qu.qux",
    "RING", "the red agent box", "well-known",
]


@pytest.fixture(scope="module")
def lite():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    c.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", [(k, t or "") for k, t in ROWS])
    return c


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs, folder = spark.createDataFrame(ROWS, "doc_id long, text string"), str(tmp_path_factory.mktemp("index") / "i")
    ix.build(docs.repartition(3), folder)
    return docs, ix.opened(spark, folder)


def ask(lite, match, k=50):
    rows = lite.execute("SELECT rowid, rank, snippet(t, 0, '', '', '...', 32) FROM t WHERE t MATCH ?", (match,))
    return sorted(((key, round(-r, 9), s) for key, r, s in rows), key=lambda x: (-x[1], x[0]))[:k]


def expected(lite, query):
    """The ladder, by hand: step, and (doc, score or None, snippet) in order."""
    import regex

    words = [w for w in regex.split(r"\s+", regex.sub(r"[^\p{L}\p{N}\s_-]", " ", query)) if w]
    n = len(query.strip().split())
    if not words:
        return "and", []
    found = ask(lite, " ".join(f'"{w}"' for w in words))
    if found:
        return "and", found
    if n >= 2:
        return "or", ask(lite, " OR ".join(f'"{w}"' for w in words))
    if len(words[-1]) < 3:
        return "and", []
    try:
        return "prefix", ask(lite, " ".join([f'"{w}"' for w in words[:-1]] + [words[-1] + "*"]))
    except sqlite3.OperationalError:
        part = query.strip().lower()
        return "like", [(k, None, None) for k, t in sorted(ROWS, reverse=True) if part in (t or "").lower()]


def test_ladder_and_snippets(spark, lite, built):
    docs, index = built
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    found = ix.ladder(index, docs, queries)
    rows = ix.snippets(found, docs, queries).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    for q, query in enumerate(QUERIES):
        step, want = expected(lite, query)
        have = got.get(q, [])
        assert [(r.step, r.doc) for r in have] == [(step, k) for k, *_ in want], query
        for r, (_, _, text) in zip(have, want, strict=True):
            assert text is None or r.snippet == text, query
    (like,) = (r for r in rows if r.step == "like")
    assert like.snippet == "xx sub-marine yy"


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_search_equals_the_scan(spark, built, every, k):
    docs, index = built
    texts = ["red bolt", "the of and", "café the", "sub-agent red", "lonely the", "the", "ring zzz"]
    queries = search.query_table(spark, texts)
    want = search.top(search.bm25(docs, queries, len(texts), every=every), [F.desc(F.round("score", 9)), F.col("doc_id")], k)
    got = ix.search(index, queries, k, every).collect()
    assert sorted((r.query_id, r.doc, round(r.score, 6), r["rank"]) for r in got) == sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in want.collect())


@pytest.mark.parametrize("every", [True, False])
def test_what_moves_does_not_grow_with_queries_times_texts(spark, tmp_path, monkeypatch, every):
    """Frequent words of many texts: only the first k of each cell leave it."""
    docs = spark.createDataFrame([(i, f"red bolt{' red' * (i % 5)} {'ring ' * (i % 7)}u{i}") for i in range(600)], "doc_id long, text string")
    index = ix.build(docs, str(tmp_path / "i"))
    queries = search.query_table(spark, ["red bolt", "bolt red", "red", "red ring", "bolt ring", "red bolt ring", "red u5"])
    moved, top = [], search.top
    monkeypatch.setattr(ix, "top", lambda df, order, k, *more: moved.append(df.count()) or top(df, order, k, *more))
    got = ix.search(index, queries, 3, every)
    want = top(search.bm25(docs, queries, 7, every=every), [F.desc(F.round("score", 9)), F.col("doc_id")], 3)
    assert sorted((r.query_id, r.doc, round(r.score, 6), r["rank"]) for r in got.collect()) == sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in want.collect())
    assert 0 < sum(moved) <= 7 * 3 * 8


def test_a_query_reads_its_buckets_only(spark, built):
    _, index = built
    held = ix.postings(index, spark.createDataFrame([("lonely",)], "term string"))
    files = {f.rsplit("/", 2)[-2] for f in held.inputFiles()}
    assert held.count() == 1 and len(files) >= 1
    assert "bucket" in held._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = ix.build(docs, str(tmp_path / "e"))
    queries = spark.createDataFrame([(0, "a b"), (1, "abc"), (2, "a-bc")], "query_id long, query string")
    assert ix.ladder(index, docs, queries).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("x" * 30 + " needle " + "y" * 60, "..." + "x" * 23 + " needle " + "y" * 39 + "..."), ("no such", "no such"), (" " + "a b " * 40, ("a b " * 40)[:77].rstrip() + "..."), ("needle", "needle")],
)
def test_snippet_around_a_part(spark, text, want):
    df = spark.createDataFrame([(text, ["zz", "needle"])], "text string, terms array<string>")
    assert df.select(T.snippet_around(F.col("text"), F.col("terms")).alias("s")).first().s == want


def test_an_index_for_a_batch_holds_what_it_asks(spark, built, tmp_path):
    """Answers are those of the whole index, and postings of other terms are not written."""
    docs, whole = built
    queries = spark.createDataFrame(list(enumerate(["red bolt", "sub-mar", "runa", "zzz lonely", "nothing here", "café", "", "!!"])), "query_id long, query string")
    index = ix.build(docs.repartition(3), str(tmp_path / "i"), asked=ix.asked(queries))
    rows = lambda found: sorted(map(tuple, found.collect()))
    assert rows(ix.ladder(index, docs, queries)) == rows(ix.ladder(whole, docs, queries))
    assert rows(index.read("totals")) == rows(whole.read("totals"))
    held, every = ({(r.term, r.doc): (r.length, r.positions) for r in i.read("postings").filter("term IS NOT NULL").collect()} for i in (index, whole))
    assert held == {k: v for k, v in every.items() if k[0] in {"red", "bolt", "sub", "mar", "zzz", "lonely"} or k[0].startswith(("runa", "cafe"))}
    assert 0 < len(held) < len(every)

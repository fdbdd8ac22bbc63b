"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from textlode.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


#: Queries whose rows show nothing unless every branch occurs: the column that must vary, and its least number of values.
VARIED = {
    "neighbor_join": ("parts", 2), "neardup_vectors": ("a", 5), "invariant_check": ("term", 4), "word_jaccard": ("a", 5), "metadata_division": ("p_partkey", 2),
    "rerank_skip_flag": ("skip", 2), "signals": ("priority", 4), "script_language": ("script", 5), "snapshot_diff": ("change", 4), "url_safety": ("safe", 2),
    "relevance_label": ("label", 4), "canonical_keys": ("claim_key", 6), "bm25_or_fallback": ("strict", 2),
}


@pytest.mark.parametrize("name", sorted(VARIED))
def test_query_has_content(spark, name):
    column, least = VARIED[name]
    assert QUERIES[name](spark, SF).select(column).distinct().count() >= least


def test_near_copies_are_dropped(spark):
    from textlode.plans.retrieval import vectors_with_copies

    kept = {r.vec_id for r in QUERIES["distinct_vectors"](spark, SF).collect()}
    every = {r.vec_id for r in vectors_with_copies(spark, SF).collect()}
    assert {v for v in every - kept} >= {1_000_000_000 + i for i in range(0, 500, 25)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

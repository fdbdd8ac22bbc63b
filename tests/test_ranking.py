import json
import random

import pytest
from pyspark.sql import functions as F

from textlode.functions import ranking as R
from textlode.operators import shapes


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "broad", "hops"),
    [
        ("What changed over the past months?", True, False), ("history", True, False), ("long-term plans", True, False), ("between May 1 and June 2", True, False), ("from 2019 to 2021", True, False),
        ("2020 and 2021", False, False), ("how did A lead to B", False, True), ("root  cause", False, True), ("multi hop", False, True), ("hello", False, False), ("", False, False), (None, False, False),
    ],
)
def test_indicators(spark, query, broad, hops):
    q = F.col("q")
    assert one(spark, R.broad_time(q), q=query) is broad
    assert one(spark, R.several_hops(q, F.lit(1), F.lit(1)), q=query) is hops


@pytest.mark.parametrize(
    ("query", "depth", "n", "cap", "messages", "probe", "want"),
    [
        ("hello", 1, 0, 100, False, False, ("answer_directly", 0, "low")), ("hello", 2, 1, 4000, False, True, ("answer_directly", 363, "low")), ("hello", 2, 1, 4000, False, False, ("expand_shallow", 363, "low")),
        ("hello", 2, 2, 4000, False, True, ("expand_shallow", 726, "low")), ("hello", 1, 1, 400, False, True, ("expand_shallow", 220, "moderate")), ("hello", 1, 1, 300, False, True, ("delegate_traversal", 220, "high")),
        ("timeline of the root cause", 1, 1, 10_000, False, True, ("delegate_traversal", 372, "low")), ("hello", None, 1, None, True, True, ("expand_shallow", 1202, "low")), ("hello", 99, 1, 10_000, False, True, ("expand_shallow", 1884, "low")),
    ],
)
def test_routes(spark, query, depth, n, cap, messages, probe, want):
    number = lambda v: F.lit(v) if v is not None else F.lit(None).cast("int")
    r = one(spark, R.routed(F.col("q"), number(depth), F.lit(n), number(cap), F.lit(messages), F.lit(probe)), q=query)
    assert (r.action, r.tokens, r.risk) == want


def test_search_terms(spark):
    assert one(spark, R.search_terms(F.col("q")), q="What IS the API key, of Nova; a b c: one.two three four five!") == ["api", "key", "nova", "one", "two"]
    assert one(spark, R.search_terms(F.col("q")), q="x" * 300) == ["x" * 100] and one(spark, R.search_terms(F.col("q")), q="the of") == []


def test_relevance(spark):
    parts = [F.lit(x) for x in (0.6, 1.0, 0.9, 1.0, 0.8)]
    for mode, status, share in (("coding", "active", 1.0), ("recall", "needs_confirmation", 0.9), ("odd", "superseded", 0.0), ("planning", "draft", 0.5)):
        w = R.MODES.get(mode, R.MODES["default"])
        want = (0.6 * w["semantic"] + w["recency"] + 0.9 * w["trust"] + w["conflict"] + 0.8 * w["influence"]) * share
        assert abs(one(spark, R.relevance(mode, *parts, F.lit(status)), a="x") - want) < 1e-12
    assert [one(spark, R.influence_score(F.col("i")), i=i) for i in ("critical", "high", "standard", "low", "odd", None)] == [1.0, 0.8, 0.5, 0.2, 0.5, 0.5]


def test_shapes_on_any_partitioning(spark):
    rng = random.Random(3)
    rows = [json.dumps({"a": rng.choice([1, 2.5, "x", None, True]), "b": [rng.randrange(99) for _ in range(rng.randrange(4))], "c": {"d": f"v{i}"}}) for i in range(300)] + ["[1, 2]", "null", "5", "{bad", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    whole = shapes.described(shapes.sketch(df, "j")).orderBy("path").collect()
    for n in (1, 7):
        assert shapes.described(shapes.sketch(df.repartition(n), "j")).orderBy("path").collect() == whole
    parts = [shapes.sketch(spark.createDataFrame([(r,) for r in rows[k::3]], "j string"), "j") for k in range(3)]
    assert shapes.described(shapes.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))).orderBy("path").collect() == whole
    by = {r.path: r for r in whole}
    assert by["$"].n == 303 and by["$"].types == "array|null|number|object" and by["!"].n == 1
    assert by["$.a"].types == "boolean|null|number|text" and by["$.b"].longest == 3 and abs(by["$.c.d"].different - 300) < 15 and by["$.c.d"].least == "v0"
    assert shapes.sketch(df.limit(0), "j").count() == 0

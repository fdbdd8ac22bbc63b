import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlode.llm import negatives, queries
from textlode.llm.sql import ORACLES

SMALL = negatives.Mining(pivots=4, pilot=12, group=5, chunk=13)
SCHEMA = "vec_id long, label int, embedding array<double>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(rows, is_anchor, m=SMALL):
    kept = [(i, lab, [math.floor(m.scale * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for a, (anchor, label, vector) in enumerate(kept):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(sum(x * y for x, y in zip(vector, w)), i, lab) for b, (i, lab, w) in enumerate(kept) if b != a]  # noqa: B905
        for score, positive, _ in sorted((p for p in scored if p[2] == label), key=order)[: m.positives]:
            fit = [p for p in scored if p[2] != label and m.low * score <= 100 * p[0] <= m.high * score]
            for rank, (found, negative, _) in enumerate(sorted(fit, key=order)[: m.negatives], 1):
                out[anchor, positive, rank, negative, score, found] += 1
    return out


def mined(spark, rows, m=SMALL, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return Counter(tuple(r[c] for c in COLUMNS) for r in negatives.mine(df, F.col("vec_id") % 3 == 0, m).collect())


def clustered(seed, n, size=6, centers=5):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(centers)]
    return [(i, rng.randrange(3), [c + rng.gauss(0, 0.2) for c in rng.choice(middle)]) for i in range(n)]


def check(spark, rows, m=SMALL):
    want = expected(rows, lambda i: i % 3 == 0, m)
    assert mined(spark, rows, m) == want
    return want


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, seed):
    assert check(spark, clustered(seed, 90))


def test_no_pilot_bounds(spark):
    check(spark, clustered(5, 60), negatives.Mining(pivots=1, pilot=1, group=5, chunk=13))


def test_odd_rows(spark):
    rows = clustered(7, 50)
    rows += [(51, None, [1.0] * 6), (54, 1, None), (57, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (60, 1, [math.nan] * 6), (63, 1, [math.inf] * 6)]
    rows += [(66, 1, []), (69, 2, [1.0, -2.0]), (None, 1, rows[0][2]), (None, 2, rows[1][2]), (72, 0, [0.0] * 6), (-3, 0, [-x for x in rows[0][2]])]
    rows += rows[:9] + [(3, rows[3][1], [2 * x for x in rows[3][2]])]
    check(spark, rows)


def test_ties(spark):
    rows = [(i, i % 2, [1.0, 0.0] if i < 20 else [0.8, 0.1]) for i in range(40)]
    assert check(spark, rows)


def test_a_third_is_one_vector(spark):
    rows = clustered(9, 120)
    rows = [(i, lab, rows[0][2] if i % 3 == 1 else v) for i, lab, v in rows]
    check(spark, rows)


def test_large_integers_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.uniform(0.5, 1) * 2e5, rng.uniform(0, 1) * 2e5]) for i in range(40)]
    assert max(k[4] for k in check(spark, rows)) > 2**50
    a, b = (np.array([[float(2**30 + 1), 3.0]]) for _ in range(2))
    assert negatives.integers(a, b)[0, 0] == (2**30 + 1) ** 2 + 9


def test_one_row_no_anchor_and_empty(spark):
    assert mined(spark, [(0, 1, [1.0])]) == Counter()
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == Counter()
    assert mined(spark, []) == Counter()


def test_clashing_columns(spark):
    rows = clustered(2, 30)
    extra = [(*r, 1, 2, 3) for r in rows]
    assert mined(spark, extra, schema=SCHEMA + ", row int, `group` int, score int") == expected(rows, lambda i: i % 3 == 0)


def test_groups_share_small_cells_and_split_large_ones(spark):
    pilot = pa.table({"vec_id": list(range(4)), "label": [0] * 4, "embedding": [[0.0, 0.0], [10.0, 0.0], [0.1, 0.0], [0.2, 0.1]]})
    space = negatives.Space(**negatives.parts_of(pilot, 1e7, negatives.Mining(pivots=4)))
    cells = [{"cell": c, "n": n} for c, n in enumerate([3, 25, 4, 4])]
    first, last = negatives.groups_of(cells, space, 10)
    assert first[0] == last[0] == first[2] == last[2] != first[3]
    assert last[1] - first[1] == 2
    assert not set(range(first[1], last[1] + 1)) & {first[0], first[3]}


def test_far_clusters_are_not_replicated(spark):
    """Bounds cut: of two clusters apart, a candidate goes to the groups of its own only."""
    rng = random.Random(1)
    rows = [(i, i % 2, [(1 if i % 4 < 2 else -1) * 5 + rng.gauss(0, 0.05), rng.gauss(0, 0.05)]) for i in range(200)]
    m = negatives.Mining(pivots=8, pilot=40, group=20, chunk=50)
    df = spark.createDataFrame(rows, SCHEMA)
    counted = []
    whole = negatives.local_join
    sent = spark.sparkContext.accumulator(0)

    def counting(m):
        run = whole(m)

        def over(batches):
            def seen(batches):
                for b in batches:
                    sent.add(b["row"].null_count)
                    yield b

            yield from run(seen(batches))

        return over

    negatives.local_join = counting
    try:
        got = Counter(tuple(r[c] for c in COLUMNS) for r in negatives.mine(df, F.col("vec_id") % 3 == 0, m).collect())
    finally:
        negatives.local_join = whole
    counted.append(sent.value)
    assert got == expected(rows, lambda i: i % 3 == 0, m)
    groups = -(-67 // 20) + 1
    assert counted[0] < 2 * 200 * groups * 0.7


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op12_hard_negatives(spark, sf).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_hard_negatives']})").fetchall())

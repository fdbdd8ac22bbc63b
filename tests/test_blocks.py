import numpy as np
import pandas as pd

from textlode.operators import packing, search


def vectors(n, seed, size=8):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    x[n // 2 :: 3] = x[: len(x[n // 2 :: 3])]  # copies
    x[1::5] = x[0] + np.round(r.normal(size=(len(x[1::5]), size))) * 1e-10  # closer than what is rounded
    return x


def test_nearest_equals_all_distances_and_holds_few_at_once(spark):
    x = vectors(700, 1)
    rows = [(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(900, 0, None), (901, 0, [float("nan")] * 8), (902, 1, [float("inf")] * 8), (903, 1, [0.5])]
    table = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    asked = table.filter("vec_id < 60").selectExpr("vec_id AS query_id", "embedding AS vector", "label")
    for same in (None, "label"):
        got = {(r.query_id, r["rank"]): (r.vec_id, round(r.distance, 9)) for r in search.nearest(table.filter("vec_id < 900 OR vec_id = 902"), asked, 7, same).collect()}
        want = {}
        for q in range(60):
            of = [i for i in range(700) if same is None or i % 3 == q % 3]
            d = sorted((round(float(np.sqrt(search.squares(x[q : q + 1], x[i : i + 1])[0, 0])), 9), i) for i in of)[:7]
            want |= {(q, place): (i, v) for place, (v, i) in enumerate(d, 1)}
        assert got == want


def test_block_kernels_do_not_hold_all_pairs():
    """Of two blocks of 2,048 rows all pairs are 34 MB; what is held at once is a few slices."""
    import tracemalloc

    captured = {}

    class Frame:
        def select(self, *_):
            return self

    def blocked(left, right, same, run, schema):
        captured["run"] = run
        raise StopIteration

    sides = [search.Side(pd.DataFrame({"id": range(a, a + 2048), "vector": list(vectors(2048, a, 64))})) for a in (0, 5000)]
    original = search.blocked
    for make in (lambda: search.nearest(Frame(), Frame(), 10), lambda: packing.nearest_before(Frame(), None, "label")):
        search.blocked = blocked
        try:
            make()
        except StopIteration:
            pass
        finally:
            search.blocked = original
        tracemalloc.start()
        captured["run"](*sides, False)
        assert tracemalloc.get_traced_memory()[1] < 30e6
        tracemalloc.stop()


def test_nearest_before_meets_its_own_table_once(spark):
    x = vectors(5000, 3)
    table = spark.createDataFrame([(i, i % 2, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, label long, embedding array<double>")
    best = lambda df: {r.vec_id: r.d for r in df.groupBy("vec_id").agg({"distance": "min"}).toDF("vec_id", "d").collect()}
    once = best(packing.nearest_before(table, None, "label"))
    assert once == best(packing.nearest_before(table, table, "label"))
    assert len(once) == 4998
    for i in range(4000, 4100):
        assert once[i] == np.sqrt(search.squares(x[i : i + 1], x[i % 2 : i : 2])).min()

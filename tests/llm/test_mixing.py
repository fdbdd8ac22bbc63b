import random
from collections import Counter, defaultdict

import pytest

from textlode.llm import mixing


def filled(sizes, weights, share=1.5, cap=2.0):
    """Clamp, reshare, again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets, open_ = {}, set(sizes)
    wanted = share * sum(sizes.values())
    while open_:
        level = (wanted - sum(targets.values())) / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not above:
            return targets | {s: level * w[s] for s in open_}
        targets |= {s: cap * sizes[s] for s in above}
        open_ -= above
    return targets


def corpus(seed, n=400):
    rnd = random.Random(seed)
    sources = ["a", "b", "é", "Z", "zz", None, "hot"]
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 50, 200])) or rnd.choice(["", None, " \n"]), rnd.choice(sources + ["hot"] * 5)) for i in range(n)]
    return rows + rows[:3] + [(None, "x y", "a"), (None, None, None), (n, "only", "tiny"), (n + 1, "", "empty")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_takes(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, s, 7) for k, t, s in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = filled(sizes, mixing.WEIGHTS)
    source = defaultdict(list)
    for k, t, s in rows:
        source[k].append(s)
    taken, largest = Counter(), Counter()
    for r in got:
        s = next(x for x in source[r.doc_id] if abs(want[x] - r.target) < 1e-6 and sizes[x] == r.source_size)
        assert r.taken == r.size * r.copies <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert len(got) == len(rows)


def test_take_gives_what_the_mix_says(spark):
    rows = [r for r in corpus(3) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame([(k, t, s, "x") for k, t, s in rows], "doc_id long, text string, source string, target string")
    plan = {r.doc_id: r.copies if r.size else 0 for r in mixing.mix(docs).collect()}
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    found = Counter(r.doc_id for r in taken.collect())
    assert found == Counter({k: n for k, n in plan.items() if n})


def test_take_with_clashing_names(spark):
    names = ["whole", "last", "of_source", "_copy", "passes", "front", "copy", "place", "size", "part", "Copy_", "running"]
    docs = spark.createDataFrame([(i, "a b c " * i, "ab"[i % 2]) for i in range(30)], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", *(f"'{n}' AS `{n}`" for n in names))
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == Counter(r.doc_id for r in mixing.take(docs.select("doc_id", "text", "source")).collect())
    assert all(r[n] == n for r in taken.collect() for n in names)


@pytest.mark.parametrize("rows", [1, 10])
def test_number_of_ranges_changes_nothing(spark, rows):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mix(docs, range_rows=rows).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.take(docs).count() == 0

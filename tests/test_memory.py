import datetime as dt
import random

from pyspark.sql import functions as F

from textlode.operators import memory, reconcile

EXISTING = "row long, composite_id string, canonical_key string, kind string, scope_id long, status string, confidence double, content string"
CANDIDATE = "composite_id string, canonical_key string, kind string, scope_id long, status string, confidence double, content string, arrived long, supersedes boolean, violates boolean"


def fold(existing, candidates):
    """One by one, as rows are found by their ids, then by the keys of open rows, then among new ones."""
    rows = {("row", r[0]): list(r) + [0, False] for r in existing}
    by_id, by_key = {}, {}
    for r in sorted(existing):
        by_id.setdefault(r[1], r[0])
        if r[2] is not None and r[5] != "superseded":
            by_key.setdefault((r[4], r[3], r[2]), r[0])
    for cid, key, kind, scope, status, conf, content, _, resets, violates in sorted(candidates, key=lambda c: c[7]):
        conf = min(1.0, max(0.0, 0.5 if conf is None else conf))
        row = by_id.get(cid, by_key.get((scope, kind, key)) if key is not None else None)
        name = ("row", row) if row is not None else ("key", scope, kind, key) if key is not None else ("id", cid)
        old = rows.get(name)
        if old is not None and not resets:
            conf = conf * 0.7 + min(1.0, max(0.0, 0.5 if old[6] is None else old[6])) * 0.3
        rows[name] = [old[0] if old else None, cid, key, kind, scope, "needs_confirmation" if violates else status or "active", conf, content, (old[8] if old else 0) + 1, old[9] if old else True]
    return sorted((tuple(v[:6]) + (round(v[6], 9) if v[6] is not None else None,) + tuple(v[7:]) for v in rows.values()), key=repr)


def test_upserts_against_a_plain_fold(spark):
    for seed in range(3):
        rng = random.Random(seed)
        existing = [(i, f"c{i}", rng.choice([None, "a", "b", "c"]), rng.choice(["claim", "loop"]), rng.randrange(2), rng.choice(["active", "superseded"]), rng.choice([None, rng.random(), 1.7]), f"old {i}") for i in range(8)]
        candidates = []
        for t in range(300):
            cid = f"c{rng.randrange(8)}" if rng.random() < 0.1 else f"n{t % 250}"
            candidates.append((cid, rng.choice([None, "a", "b", "c", "d"]) if rng.random() < 0.5 else "hot", rng.choice(["claim", "loop"]), rng.randrange(2), rng.choice([None, "active"]), rng.choice([None, rng.random(), -1.0]), f"new {t}", t, rng.random() < 0.02, rng.random() < 0.1))
        got = memory.upserted(spark.createDataFrame(existing, EXISTING), spark.createDataFrame(candidates, CANDIDATE).repartition(3)).collect()
        have = sorted(((r.row, r.composite_id, r.canonical_key, r.kind, r.scope_id, r.status, None if r.confidence is None else round(r.confidence, 9), r.content, r.updates, r.is_new) for r in got), key=repr)
        assert have == fold(existing, candidates)


def test_no_candidates(spark):
    existing = spark.createDataFrame([(1, "c", "k", "claim", 1, "active", 0.5, "x")], EXISTING)
    assert [r.confidence for r in memory.upserted(existing, spark.createDataFrame([], CANDIDATE)).collect()] == [0.5]


def test_heads_of_chains_trees_and_circles(spark):
    rng = random.Random(4)
    after = {i: i + 1 for i in range(500)} | {1000 + i: rng.randrange(1000 + i, 1200) for i in range(200)}
    after |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000, 3000: 3000}
    got = {r.node: (r.head, r.steps, r.cyclic) for r in memory.heads(spark.createDataFrame(list(after.items()), "node long, next long")).collect()}
    want = {}
    for node in after:
        at, seen = node, []
        while at in after and at not in seen:
            seen.append(at)
            at = after[at]
        want[node] = (None, None, True) if at in seen else (at, len(seen), False)
    assert got == want
    assert memory.heads(spark.createDataFrame([], "node long, next long")).count() == 0


def test_heads_of_a_long_chain_keep_the_planner_s_estimates_small(spark):
    chain = memory.heads(spark.range(5000).selectExpr("id AS node", "id + 1 AS next"))
    assert int(str(chain._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 500
    assert {(r.head, r.node + r.steps) for r in chain.collect()} == {(5000, 5000)}


def test_knapsack_of_a_large_group(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.random(), rng.choice([0, 1, 3, 7, 20, 200])) for i in range(3000)] + [(2, 9000, 1.0, 500)]
    want, left = set(), 100
    for _, i, _, tokens in sorted((r for r in rows if r[0] == 1), key=lambda r: (-(r[2] / max(1, r[3])), r[1])):
        if tokens <= left:
            left -= tokens
            want.add(i)
    got = reconcile.knapsack(spark.createDataFrame(rows, "g int, id int, score double, tokens long"), "g", 100).collect()
    assert {r.id for r in got} == want and {r.g for r in got} == {1}


OBJECTS = (
    "id long, scope_id long, kind string, subject string, predicate string, object string, event_type string, confidence double, status string, "
    "created_at timestamp_ntz, priority long, severity string, failures long, content string, successes long, updated_at timestamp_ntz"
)
NOW = dt.datetime(2024, 6, 1)


def thing(i, kind, confidence, days=1, status="active", **more):
    row = {"subject": f"s{i}", "predicate": "is", "object": "o", "event_type": "tool", "priority": 5, "severity": "error", "failures": 0, "content": f"c{i}", "successes": 0} | more
    at = NOW - dt.timedelta(days=days)
    return (i, 1, kind, row["subject"], row["predicate"], row["object"], row["event_type"], confidence, status, at, row["priority"], row["severity"], row["failures"], row["content"], row["successes"], None)


def test_decay_in_order(spark):
    rows = [
        thing(1, "anti_runbook", 0.5, 200, event_type="works"), thing(2, "anti_runbook", 0.3, 200, event_type="works"), thing(3, "anti_runbook", 0.25, 1), thing(4, "anti_runbook", 0.2, 1),
        thing(5, "runbook", 0.8, 100, failures=3, successes=1), thing(6, "runbook", 0.8, 200, failures=3, successes=1), thing(7, "runbook", 0.8, 200, failures=1, successes=3), thing(8, "runbook", 0.8, 200),
        thing(9, "loop", 0.8, 2), thing(10, "loop", 0.8, 4), thing(11, "relation", 0.8, 179), thing(12, "relation", 0.8, 181), thing(13, "loop", 0.8, 9, "stale"), thing(14, "claim", 0.1, 999),
    ]
    worked = spark.createDataFrame([(1, "works", NOW - dt.timedelta(days=5)), (1, "tool", NOW - dt.timedelta(days=100))], "scope_id long, tool string, at timestamp_ntz")
    got = {r.id: (round(r.confidence, 6), r.status) for r in memory.decayed(spark.createDataFrame(rows, OBJECTS), worked, F.lit(NOW)).collect()}
    assert got == {
        1: (0.35, "active"), 2: (0.24, "active"), 3: (0.25, "active"), 4: (0.2, "stale"), 5: (0.4, "active"), 6: (0.4, "active"), 7: (0.8, "stale"), 8: (0.8, "stale"),
        9: (0.8, "active"), 10: (0.8, "stale"), 11: (0.8, "active"), 12: (0.8, "stale"),
    }


def test_capsules(spark):
    rows = [
        thing(20, "anti_runbook", 0.5, failures=2), thing(21, "invariant", 0.7), thing(22, "decision", 0.95), thing(23, "loop", 0.5), thing(24, "runbook", 0.4, successes=3, failures=1),
        thing(25, "relation", 0.6), thing(26, "claim", 0.99, predicate="was"), thing(28, "claim", 0.99, status="superseded"), thing(29, "decision", 0.6, subject="s22", content="c22"), thing(30, "claim", 0.8),
    ]
    conflicts = spark.createDataFrame([(1, 1, "30", "x", "active", 0.5, NOW), (2, 1, "y", "z", "resolved", 0.5, NOW)], "id long, scope_id long, a string, b string, status string, confidence double, created_at timestamp_ntz")
    deltas = spark.createDataFrame([(1, 1, "e", None, "new", NOW)], "id long, scope_id long, entity string, old string, new string, created_at timestamp_ntz")
    run = lambda **more: {r.scope_id: r for r in memory.capsules(spark.createDataFrame(rows, OBJECTS), conflicts, deltas, F.lit(NOW), **more).collect()}
    (r,) = run(budget=500).values()
    assert r.text.split("\n") == [
        "[Evidence]", "[anti-runbook] AVOID: c20 (tool, 2 failures)", "[INVARIANT: STRICT/error] c21", "[conflict] 30 vs x (unresolved)", "[decision] s22: c22 [FIRM]", "[claim] s30 is: o [CONTESTED]",
        "[loop] c23", "[delta] e: ? → new", "[runbook] tool: c24 (75% success) [PROVISIONAL]", "[relation] s25 is o",
    ]
    assert r.tokens == 3 + sum(-(-len(x) // 4) for x in r.text.split("\n")[1:])
    (small,) = run(budget=3 + 4 + 6).values()
    assert small.kinds == "decision,loop"  # the best a token that fit
    asked = spark.createDataFrame([(1, "s25")], "scope_id long, query string")
    (led,) = run(budget=3 + 5, asked=asked).values()
    assert led.kinds == "relation"
    assert run(budget=3) == {}

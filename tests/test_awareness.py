import datetime as dt
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from textlode.operators import awareness

SCHEMA = "id long, entity string, source string, created_at timestamp_ntz, terms array<string>"
NOW = dt.datetime(2024, 2, 1)


def mentions(seed, n, entities=4, sources=5, hot=0.4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        entity = "e0" if rng.random() < hot else f"e{rng.randrange(entities)}"
        rows.append((i, entity, f"s{rng.randrange(sources)}", NOW - dt.timedelta(days=rng.randrange(120)), sorted(rng.sample("abcd", 2))))
    return rows + [(n, None, "s0", NOW, []), (n + 1, "e1", None, NOW, [])]


def pairs_of(rows, since):
    kept = [r for r in rows if r[1] and r[2] and r[3] > since]
    found = {}
    for b, a in itertools.permutations(kept, 2):
        if a[1] == b[1] and a[0] < b[0] and a[2] != b[2]:
            found.setdefault(a[1], []).append((-(b[3] - dt.datetime(2020, 1, 1)).days, -b[0], -a[0], b, a))
    return {e: sorted(p, key=lambda x: x[:3]) for e, p in found.items()}


def test_mismatches_against_all_pairs(spark):
    since = NOW - dt.timedelta(days=90)
    for seed, n, sources in ((1, 60, 3), (2, 60, 1), (3, 90, 40), (4, 5, 2)):
        rows = mentions(seed, n, sources=sources)
        got = awareness.mismatches(spark.createDataFrame(rows, SCHEMA), 4, F.lit(since)).collect()
        want = {(e, k, p[4][0], p[3][0]) for e, ps in pairs_of(rows, since).items() for k, p in enumerate(ps[:4], 1)}
        assert {(r.entity, r.place, r.id_a, r.id_b) for r in got} == want


def test_connections_against_all_pairs(spark):
    rows = mentions(5, 80)
    by = {}
    for _, e, s, *_ in rows:
        if e and s:
            by.setdefault(s, set()).add(e)
    want = Counter(p for es in by.values() for p in itertools.combinations(sorted(es), 2))
    got = awareness.connections(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.a, r.b): r.sources for r in got} == want
    assert all(r.first_source == min(s for s, es in by.items() if {r.a, r.b} <= es) for r in got)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    # few sources with many pairs: tasks follow the pairs, also within one source
    rng = random.Random(7)
    by = {f"s{i}": set(rng.sample(range(300), 150)) for i in range(10)} | {"all": set(range(300)), "one": {4}}
    rows = [(i, f"e{e:03}", s, NOW, []) for i, (s, e) in enumerate((s, e) for s, es in by.items() for e in es)]
    want = Counter(p for es in by.values() for p in itertools.combinations(sorted(es), 2))
    monkeypatch.setattr(awareness, "PAIRS", 5_000, raising=False)
    context, group = spark.sparkContext, "pairs are dealt"
    context.setJobGroup(group, group)
    try:
        got = awareness.connections(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        context._jsc.clearJobGroup()
    assert {(int(r.a[1:]), int(r.b[1:])): r.sources for r in got} == want
    assert all(r.first_source == min(s for s, es in by.items() if {int(r.a[1:]), int(r.b[1:])} <= es) for r in got)
    stages = {k for j in context.statusTracker().getJobIdsForGroup(group) for k in context.statusTracker().getJobInfo(j).stageIds}
    assert max(info.numTasks for k in stages if (info := context.statusTracker().getStageInfo(k))) >= sum(len(e) * (len(e) - 1) // 2 for e in by.values()) // 5_000


def named(spark, *rows):
    return spark.createDataFrame(list(rows), "key long, entity string")


def test_notes_stay_within_lines_and_tokens(spark):
    old, new = NOW - dt.timedelta(days=50), NOW - dt.timedelta(days=1)
    rows = [(1, "nova", "s1", old, ["x"]), (2, "nova", "s2", old, ["y"]), (3, "orion", "s1", new, ["x"]), (4, "orion", "s2", new, ["y"]), (5, "rare", "s1", new, [])]
    m = spark.createDataFrame(rows, SCHEMA)
    asked = named(spark, (1, "nova"), (1, "orion"), (2, "rare"), (3, None), (4, "unknown"))
    got = {r.key: r for r in awareness.notes(asked, m, F.lit(NOW), most_notes=4, most_tokens=200).collect()}
    assert got[1].notes.split("\n") == [
        "[Awareness]",
        'Possible mismatch: "orion" — s1 mentions [x] but s2 mentions [y]',
        'Possible mismatch: "nova" — s1 mentions [x] but s2 mentions [y]',
        'Stale reference: "nova" last seen 50 days ago (2023-12-13 00:00:00)',
        'Connection: "nova" and "orion" co-occur in s1',
    ]
    assert got[1].kinds == "mismatch,mismatch,staleness,connection"
    assert got[1].tokens == 3 + sum(-(-len(x) // 4) for x in got[1].notes.split("\n")[1:])
    background = 'Background: "{}" (2 mentions) — high-activity entity'
    assert [r.notes.split("\n")[1:] for r in (got[2], got[3], got[4])] == [[background.format(e) for e in ("nova", "orion")]] * 3
    tight = {r.key: r for r in awareness.notes(asked, m, F.lit(NOW), most_notes=4, most_tokens=15).collect()}
    assert tight[1].notes == '[Awareness]\nConnection: "nova" and "orion" co-occur in s1'  # what does not fit is passed over
    assert awareness.notes(asked, m, F.lit(NOW), most_tokens=5).count() == 0


def test_no_mentions(spark):
    assert awareness.notes(named(spark, (1, "nova"), (2, None)), spark.createDataFrame([], SCHEMA), F.lit(NOW)).count() == 0


def test_sources_of_the_same_entities_make_their_pairs_once(spark):
    rows = [(f"s{i:03}", e) for i in range(200) for e in ("x", "y", *(("z",) if i % 50 == 7 else ()))] + [("one", "x"), ("one", None), (None, "y")]
    found = awareness.connections(spark.createDataFrame(rows, "source string, entity string"))
    assert {tuple(r) for r in found.collect()} == {("x", "y", 200, "s000"), ("x", "z", 4, "s007"), ("y", "z", 4, "s007")}
    plan = found._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    stages, seen = [plan], 0
    while stages:
        node = stages.pop()
        if "QueryStage" in node.nodeName():
            stages.append(node.plan())
        if "Generate" in node.nodeName():
            seen += int(str(node.metrics().get("numOutputRows").get().value()))
        stages += [node.children().apply(i) for i in range(node.children().size())]
    assert seen == 4


def test_mentions_that_are_read_again_are_stored_by_text(spark):
    """A text's terms are one stored row, however many mentions it makes."""
    from textlode.plans import registry  # noqa: F401
    from textlode.plans.aware import mention_rows

    sf = "/root/testdata/sf0.001"
    once = mention_rows(spark, sf, once=True)
    folders = {f.rsplit("/", 1)[0] for f in once.inputFiles()}
    assert len(folders) == 1 and "/table-" in folders.copy().pop()
    stored = spark.read.parquet(*folders)
    assert stored.count() == once.select("id").distinct().count() < once.count()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(once) == rows(mention_rows(spark, sf))

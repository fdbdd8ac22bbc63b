"""Facts that texts state, as written down here; each row is a text and what must come out of it."""

import re

import pytest
from pyspark.sql import functions as F

from textlode.operators import extract, terms


def texts(spark, *said):
    return spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")


def run(f, spark, text, *columns):
    return [tuple(r[c] for c in columns) for r in f(texts(spark, text)).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Remember: the staging DB uses Postgres", [("the staging db", "is", "Postgres")]),
        ("Remember this: the VPN is slow", [("the vpn", "is", "slow")]),
        ("Note: API gateway expires on Friday. Then more", [("api gateway", "is", "on Friday")]),
        ("Important: never deploy on Fridays", [("constraint", "states", "never deploy on Fridays")]),
        ("FYI: the CI pipeline needs about 20 minutes", [("the ci pipeline", "is", "about 20 minutes")]),
        ("Don't forget: I have brown hair", [("brown hair", "user_i", "I have brown hair")]),
        ("Keep in mind: region: eu west", [("region", "is", "eu west")]),
        ("Remember: port 8080 is for the API\nNote: port 3000 is for the frontend", [("port 8080", "is", "for the API"), ("port 3000", "is", "for the frontend")]),
        ("Remember: ok", []),
        ("Note: don't store this as it is a joke", []),
        ("Note: the password is hunter2", []),
        ("Fact: just some words", []),  # a note of the user's own, which is meta
        ("## Auth System\n- Owner: Bob Smith\n* Framework: OAuth2\n\n- Late: no", [("auth system", "owner", "Bob Smith"), ("auth system", "framework", "OAuth2")]),
        ("---\nauthor: Wesley\nstatus: draft\n---\nText", []),  # the document is meta
        ("Redis is a fast cache.", [("redis", "is", "fast cache")]),
        ("Nova Team depends on Orion Core for billing.", [("nova team", "depends on", "Orion Core for billing")]),
        ("Billing Service manages Invoice Flow.", [("billing service", "manage", "Invoice Flow")]),
        ("The owner is Kim Lee.", [("kim lee", "is", "The owner is Kim Lee.")]),
        ("Gateway handles the incoming traffic.", [("gateway", "handle", "incoming traffic")]),
        ("Postgres on port 5432", [("postgres", "is", "5432")]),
        ("`Remember: the code is old`\n```\nNote: the fence is new\n```", []),
        ("", []),
    ],
)
def test_claims(spark, text, want):
    assert sorted(run(extract.claims, spark, text, "subject", "predicate", "object")) == sorted(want)


def test_of_one_key_the_most_trusted_claim_stays(spark):
    text = "Redis is a fast cache.\nRemember: redis is gone"
    assert run(extract.claims, spark, text, "subject", "object", "confidence", "source_type") == [("redis", "gone", 0.9, "user_explicit")]


def test_names_of_the_installation_are_no_subjects(spark):
    df = texts(spark, "Remember: Hal is a computer")
    assert extract.claims(df).count() == 1 and extract.claims(df, names=("Hal",)).count() == 0


def test_front_matter_before_the_filters(spark):
    df = texts(spark, "---\nauthor: Wesley\ntitle: no\ntags: memory, ai\n---\nText")
    facts = df.select(F.explode(extract.front_claims(F.col("text"))).alias("f")).select("f.*").collect()
    assert [(r.subject, r.predicate, r.object) for r in facts] == [("document", "author", "Wesley"), ("document", "tags", "memory, ai")]


def test_long_lists_need_no_stack(spark):
    text = "# Big\n" + "".join(f"- key {i}: v\n" for i in range(20_000))
    assert extract.claims(texts(spark, text)).count() == 20_000


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We decided to use Postgres for the staging database.", [("staging database.", "use Postgres for the staging database.")]),
        ("We've decided to adopt Rust", [("rust", "adopt Rust")]),
        ("We're going with TypeScript for the backend rewrite", [("typescript backend rewrite", "TypeScript for the backend rewrite")]),
        ("Going with plan B of March", [("plan march", "plan B of March")]),
        ("We chose to migrate to Kafka", [("kafka", "migrate to Kafka")]),
        ("Decision: switch to ARM instances by Q3", [("arm instances by q3", "switch to ARM instances by Q3")]),
        ("we agreed to freeze merges after Thursday. And more", [("freeze merges after", "freeze merges after Thursday")]),
        ("Choosing: blue over red", [("blue over red", "blue over red")]),
        ("The weather is nice today. I had coffee this morning.", []),
        ("Decided: ok", []),
    ],
)
def test_decisions(spark, text, want):
    assert run(extract.decisions, spark, text, "topic", "decision") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Task: rotate the API key by Friday", [("task", "rotate the API key by Friday", 4)]),
        ("Todo: update the docs", [("task", "update the docs", 4)]),
        ("Reminder: check deployment status", [("follow_up", "check deployment status", 2)]),
        ("Remind me: call Kim", [("follow_up", "call Kim", 2)]),
        ("Action item: urgent fix of the build", [("task", "urgent fix of the build", 7)]),
        ("Next step: write the plan", [("follow_up", "write the plan", 2)]),
        ("Need to: clean the cache", [("task", "clean the cache", 4)]),
        ("Blocker: waiting on auth team", [("dependency", "waiting on auth team", 8)]),
        ("Question: Redis or Memcached?", [("question", "Redis or Memcached?", 3)]),
        ("Open question: who pays", [("question", "who pays", 3)]),
        ("Follow-up: verify the migration", [("follow_up", "verify the migration", 2)]),
        ("pending: review of blocker list", [("dependency", "review of blocker list", 8)]),
        ("I finished the task", []),
        ("Todo: abc", []),
    ],
)
def test_loops(spark, text, want):
    assert run(extract.loops, spark, text, "kind", "text", "priority") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Never push to main. Ever", [("push_to_main", "push to main", "critical", "strict")]),
        ("You must run the tests!", [("run_the_tests_", "run the tests!", "error", "strict")]),
        ("Avoid global state", [("global_state", "global state", "warning", "advisory")]),
        ("you should always write docs", [("write_docs", "write docs", "info", "advisory")]),
        ("Rule: two reviews a change", [("two_reviews_a_change", "two reviews a change", "error", "strict")]),
        ("never use tabs\navoid use tabs", [("use_tabs", "use tabs", "critical", "strict")]),
        ("Prefer to", []),
    ],
)
def test_invariants(spark, text, want):
    assert run(extract.invariants, spark, text, "invariant", "description", "severity", "enforcement") == want


def test_tool_results(spark):
    rows = [
        (1, "Git_Status ", '{"branch": "main", "clean": true, "ahead": 0, "none": null, "empty": ""}'),
        (2, "system_info", '{"os": {"name": "Windows", "version": "11"}, "cpu": {"cores": 8.0, "load": 0.50}}'),
        (3, "deep", '{"a": {"b": {"c": {"d": {"e": "too deep"}, "kept": 1}}}}'),
        (4, "lists", '{"xs": [1, 2, {"k": "v"}], "many": [' + ", ".join(f'{{"i": {i}}}' for i in range(12)) + "]}"),
        (5, "no", "no json"), (6, "scalar", "5"), (7, "top", '[{"a": 1}, "leaf"]'), (8, None, None), (9, "long", '{"t": "' + "x" * 500 + '"}'),
    ]
    got = extract.tool_claims(spark.createDataFrame(rows, "id int, tool string, result string")).collect()
    facts = {(r.id, r.subject, r.predicate, r.object, r.value_type) for r in got}
    assert {f for f in facts if f[0] == 1} == {(1, "git_status", "branch", "main", "text"), (1, "git_status", "clean", "true", "boolean"), (1, "git_status", "ahead", "0", "number")}
    assert {f[2:] for f in facts if f[0] == 2} == {("os.name", "Windows", "text"), ("os.version", "11", "text"), ("cpu.cores", "8", "number"), ("cpu.load", "0.5", "number")}
    assert {f[2:4] for f in facts if f[0] == 3} == {("a.b.c.kept", "1")}
    assert {f[2:4] for f in facts if f[0] == 4} == {("xs.2.k", "v"), *((f"many.{i}.i", str(i)) for i in range(10))}
    assert {f[2:4] for f in facts if f[0] == 7} == {("0.a", "1"), ("1", "leaf")}
    assert not [f for f in facts if f[0] in (5, 6, 8, 9)]
    assert all(r.trust == 1.0 and r.confidence == 0.8 for r in got)


def test_tool_results_are_walked_in_one_pass(spark):
    """However deep they are nested, results are read and parsed once, and dealt to all tasks."""
    rows = [(i, "t", '{"a": {"b": {"c": %d}}, "xs": [{"k": [{"z": 1}]}, [2], {}], "e": {}, "n": []}' % i) for i in range(50)]
    calls = spark.createDataFrame(rows, "id int, tool string, result string").coalesce(1)
    found = extract.tool_claims(calls)
    assert sorted((r.id, r.predicate, r.object) for r in found.collect()) == sorted(x for i in range(50) for x in ((i, "a.b.c", str(i)), (i, "xs.0.k.0.z", "1")))
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Wesley Brady discussed the project with Alex Morgan.", {("wesley brady", 0.6), ("alex morgan", 0.6)}),
        ("We signed with Acme Corporation last week.", {("acme corporation", 0.6)}),
        ("The Quick brown fox", set()),
        ("January Report is late", set()),
        ("It is called \"blue bolt\" and “red ring”", {("blue bolt", 0.5), ("red ring", 0.5)}),
        ('see "src/a.py" and "https://x.y" and "camelCase" and "snake_case" and "x"', set()),
        ("`Not Me` ```\nNor Me\n``` Cy Dee", {("cy dee", 0.6)}),
        ('Ann Lee, or "Ann Lee"', {("ann lee", 0.6)}),
        ("xAnn Lee", set()),
    ],
)
def test_entities(spark, text, want):
    assert set(run(extract.entities, spark, text, "name", "confidence")) == want


def test_known_terms_have_their_confidence(spark):
    known = spark.createDataFrame([("Blue Bolt",), ("ring",), ("gear box",), ("",), ("a|b",), (None,)], "term string")
    got = {r.name: r for r in extract.entities(texts(spark, 'A "blue bolt" in a gear box, not boring. Ann Lee'), known=known).collect()}
    assert {n: r.confidence for n, r in got.items()} == {"blue bolt": 0.9, "gear box": 0.9, "ann lee": 0.6}
    assert got["blue bolt"].entity_type == "user_defined" and got["ann lee"].context_terms == ["Blue Bolt", "gear box", "ring"]


def brute(text, term):
    low, t = text.lower(), term.lower()
    if t not in low:
        return None
    found = re.search(r"(?a)\b" + re.escape(t) + r"\b", low)
    return (found.start(), True) if found else (low.index(t), False)


@pytest.mark.parametrize("shard", [50_000, 3])
def test_terms_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(terms, "SHARD", shard)
    words = ["red", "red ring", "ring", "in", "é", "über", "ed r", "-x", "o'neil", "a.b", "ring in", "日本"]
    said = ["Red ring in a scored-red RING", "über é -x a-x", "O'Neil's a.b a.bc", "", None, "日本 x日本x", "boring", "red  ring", "redring red ring ing" * 40]
    got = {(r.doc_id, r.term): (r.at, r.bounded) for r in terms.find(texts(spark, *said), spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    want = {(i, w): brute(t, w) for i, t in enumerate(said) if t for w in words}
    assert got == {k: v for k, v in want.items() if v}


def test_no_terms_and_no_texts(spark):
    none, some = spark.createDataFrame([], "term string"), spark.createDataFrame([("a",)], "term string")
    assert terms.find(texts(spark, "a b"), none).count() == 0
    assert terms.find(spark.createDataFrame([], "doc_id int, text string"), some).count() == 0
    assert extract.claims(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_known_relations(spark):
    known = spark.createDataFrame([("Nova",), ("Orion",), ("Orion Core",), ("Kim",)], "term string")
    df = texts(spark, "Nova depends on Orion Core. Kim owns the Nova", "Orion and Nova", "Kim leads the Nova\nNova depends on Orion; nova requires orion")
    got = {tuple(r) for r in extract.known_relations(df, known).collect()}
    assert got == {
        (0, "nova", "depends_on", "orion core"), (0, "nova", "depends_on", "orion"), (0, "kim", "owns", "nova"), (2, "kim", "leads", "nova"), (2, "nova", "depends_on", "orion"),
    }


def test_understood_messages(spark):
    rows = [
        (1, "user", "Decision: ship the blue one\nTask: call Ann Lee"), (2, "user", "I think maybe\nNote: the cache is cold"), (3, "assistant", "Decision: nothing here\nAnn Lee agreed"),
        (4, "user", "Testing\nNote: the cache is cold"), (5, "user", "Actually, scratch that.\nRemember: the disk is full"), (6, "user", "We prefer tea.\nNote: tea is green"),
        (7, "user", "Note: what if the disk is full"), (8, "user", "Starting Monday\nReminder: move the desk"), (9, "user", "ok"), (10, "user", None),
        (11, "user", "Note: clearly this is a magic box"),
    ]
    got = extract.understood(spark.createDataFrame(rows, "msg_id int, role string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.msg_id, []).append(r)
    assert {(r.kind, r.content, r.confidence, r.event_type) for r in by[1]} == {
        ("decision", "ship the blue one", 0.9, "decision"), ("loop", "call Ann Lee", 0.8, "task"), ("entity", "Ann Lee", 0.6, None),
    }
    (claim,) = by[2]
    assert (claim.content, claim.confidence, claim.provisional, claim.canonical_key) == ("the cache is: cold", 0.45, True, "claim::the cache::is")
    assert [(r.kind, r.content) for r in by[3]] == [("entity", "Ann Lee")]
    (claim,) = by[5]
    assert (claim.event_type, claim.detail) == ("correction", "correction_signal: Actually,")
    (claim,) = by[6]
    assert (claim.event_type, claim.influence) == ("preference", "high")
    (loop,) = (r for r in by[8] if r.kind == "loop")
    assert (loop.content, loop.event_type) == ("move the desk [temporal_effective: Starting Monday]", "reminder")
    assert set(by) == {1, 2, 3, 5, 6, 8}

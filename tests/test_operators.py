"""Operators on small cases."""

import pytest
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators import chunking, graph, reconcile, search
from textlode.sources import parsers, snapshots
from textlode.streaming import streams


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_bm25_of_a_known_index(spark):
    texts = ["the quick brown fox", "the lazy dog sleeps", "quick quick fox jumps over lazy dog again", "sub-agent restrict café", "agent sub reversed", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, search.query_table(spark, ["quick fox"]), 1).collect()}
    assert got.keys() == {1, 3}
    assert got[1] == pytest.approx(1.2647820985, abs=1e-9) and got[3] == pytest.approx(1.1459979272, abs=1e-9)
    assert [r.doc_id for r in search.bm25(docs, search.query_table(spark, ["cafe"]), 1).collect()] == [4]


@pytest.mark.parametrize("row_terms", [1_000, 0])
def test_bm25_phrases(spark, monkeypatch, row_terms):
    """A word with a hyphen is a phrase, in the row and by a join."""
    monkeypatch.setattr(search, "ROW_TERMS", row_terms)
    texts = ["sub-agent restrict café", "agent sub reversed", "sub agent sub-agent", "subagent", "a sub, agent", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts, 4)), "doc_id long, text string")
    asked = search.query_table(spark, ["sub-agent", "sub-agent restrict", "agent sub"])
    got = {}
    for r in search.bm25(docs, asked, 3).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {0: {4, 6, 8}, 1: {4}, 2: {4, 5, 6, 8}}
    both = search.bm25(docs, asked, 3, every=None)
    assert {r.doc_id for r in both.filter("query_id = 1 AND strict").collect()} == {4} and both.filter("query_id = 1").count() == 3


def test_fusion(spark):
    rows = lambda *ids: spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "query_id long, item long, rank int")
    got = {r.item: r.score for r in search.fuse({"a": rows(1, 2), "b": rows(2, 3)}, {"a": 1.0, "b": 0.5}).collect()}
    assert got[1] == pytest.approx(1 / 61) and got[2] == pytest.approx(1 / 62 + 0.5 / 61) and got[3] == pytest.approx(0.5 / 62)


CASES = [
    (None, (0.5, "a", False), {"insert"}),
    ((0.6, "a", False), (0.9, "a", False), {"supersede"}),
    ((0.8, "a", False), (0.8, "a", False), {"evidence"}),
    ((0.8, "MySQL", False), (0.8, "Postgres", False), {"supersede", "conflict:active"}),
    ((0.95, "a", False), (0.5, "a", False), {"evidence"}),
    ((0.9, "MySQL", False), (0.5, "Postgres", False), {"evidence", "conflict:needs_confirmation"}),
    ((0.5, "MySQL", False), (0.9, "Postgres", False), {"supersede", "conflict:active"}),
    ((0.9, "MySQL", False), (0.2, "Postgres", False), {"evidence"}),
    ((0.5, "MySQL", False), (0.9, "Postgres", True), {"evidence"}),
]


def test_reconcile_rules(spark):
    schema = "id long, canonical_key string, confidence double, object string, provisional boolean"
    existing = [(i, f"k{i}", c, o, p) for i, (e, _, _) in enumerate(CASES) if e for c, o, p in [e]]
    candidates = [(100 + i, f"k{i}", c, o, p) for i, (_, (c, o, p), _) in enumerate(CASES)]
    got = reconcile.reconcile(spark.createDataFrame(existing, schema), spark.createDataFrame(candidates, schema)).collect()
    for i, (_, _, want) in enumerate(CASES):
        assert {r.action for r in got if r.id == 100 + i} == want


def test_corrections_supersede_within_their_scope(spark):
    schema = "id long, canonical_key string, confidence double, object string, provisional boolean, scope_id long"
    existing = [(1, "k", 0.7, "a", False, 1)]
    candidates = [(10, "k", 0.6, "a", False, 1), (11, "k", 0.6, "a", False, 2), (12, "k", 0.2, "a", False, 1), (13, "k", 0.6, "a", True, 1), (14, "k", 0.95, "a", False, 1), (15, "new", 0.6, "a", False, 1)]
    firm = spark.createDataFrame(candidates, schema).withColumn("corrects", F.lit(True))
    got = {r.id: (r.action, round(r.confidence, 6)) for r in reconcile.reconcile(spark.createDataFrame(existing, schema), firm).collect()}
    assert got == {10: ("supersede", 0.75), 11: ("evidence", 0.6), 12: ("evidence", 0.2), 13: ("evidence", 0.6), 14: ("supersede", 1.0), 15: ("insert", 0.6)}


def test_canonical_keys(spark):
    key = lambda kind, *parts: one(spark, T.canonical_key(F.lit(kind), *(F.lit(p) for p in parts)), a="x")
    assert one(spark, T.normalize(F.col("a")), a="  Hello   World  ") == "hello world"
    assert key("claim", "API Key", "expires", "v") == "claim::api key::expires"
    assert key("entity", "Wesley Brady", None, None) == "entity::unknown::wesley brady"
    assert key("procedure", "git_push", "retry_on_fail", None) == "proc::git_push::retry_on_fail"
    assert key("invariant", "no_friday_deploys", None, None) == "inv::no_friday_deploys"
    assert key("claim", " ", "expires", "v") is None and key("other", "a", "b", "c") is None
    assert len(one(spark, T.hash_prefix(F.lit("Abc"), 100), a="x")) == 16


def test_text_helpers(spark):
    assert one(spark, T.quoted_query(F.col("a")), a="sub-agent restrict") == '"sub-agent" "restrict"'
    assert one(spark, T.quoted_query(F.col("a")), a="agent:foo bar").count('"') == 6
    assert one(spark, T.quoted_query(F.col("a")), a="  ") is None
    assert one(spark, T.values_contradict(F.col("a"), F.col("b")), a="Postgres", b="MySQL")
    assert not one(spark, T.values_contradict(F.col("a"), F.col("b")), a="Postgres", b="postgres 16")
    assert one(spark, T.strip_sensitive(F.col("a")), a="password: hunter2 ok") == "password=[redacted] ok"
    assert one(spark, T.strip_boilerplate(F.col("a")), a="text Page 3 of 9 www.example.com") == "text  "
    assert one(spark, T.file_name(F.col("a")), a="a\\b/c.txt") == "c.txt"
    assert one(spark, T.normalize_predicate(F.col("a")), a="Built  with") == "uses" and one(spark, T.normalize_predicate(F.col("a")), a="uses") == "uses"
    assert one(spark, T.normalize_topic(F.col("a")), a="DB Technology") == "database" and one(spark, T.normalize_topic(F.col("a")), a="Colour") == "colour"
    claim = lambda topic: one(spark, T.canonical_key(F.lit("claim"), F.lit("API Key"), F.lit("Runs on"), F.lit("v"), F.lit(topic)), a="x")
    assert claim("cfg") == "claim::api key::configuration" and claim(" ") == claim(None) == "claim::api key::uses"
    assert one(spark, T.cut_words(F.col("a"), 2), a="one two three") == "one two"
    assert one(spark, T.query_terms(F.col("a")), a="How to use it: the Index the") == ["how", "use", "the", "index"]


def test_chunking():
    assert len(chunking.prose("One here.\n\nTwo here.\n\nThree here.", 5, 100)) >= 2
    assert chunking.prose("A.\n\nB.\n\nC.", 1000) == ["A.\n\nB.\n\nC."]
    assert chunking.prose("") == chunking.prose(" \n ") == chunking.prose(None) == []
    assert chunking.sentences("Dr. Smith came. He left at 3.5 p.m! J. Doe stayed") == ["Dr. Smith came.", "He left at 3.5 p.m!", "J. Doe stayed"]
    assert all(len(c) <= 400 for c in chunking.prose("x" * 5000, 50, 100))


def test_parsers(spark):
    assert parsers.flatten_json({"a": {"b": [1, {"c": None}]}}) == ["a.b[0]: 1", "a.b[1].c: None"]
    assert parsers.parse_json_lines('{"a": 1}\nbad\n') == "a: 1\n\nbad"
    assert parsers.parse_email("Subject: Hi\nFrom: a@b.c\n\nBody\n")["body"] == "Body"
    assert one(spark, parsers.markdown_headings(F.col("a")), a="# A\n```\n# no\n```\n## B ##\n") == ["A", "B"]
    assert one(spark, parsers.frontmatter(F.col("a")), a="---\ntitle: T\nauthor: A B\n---\nx") == {"title": "T", "author": "A B"}
    assert one(spark, parsers.wikilinks(F.col("a")), a="[[Note|x]] and [[Other#h]]") == ["Note", "Other"]
    assert one(spark, parsers.code_definitions(F.col("a")), a="def f(x):\nclass C:\n  async def g():") == ["f", "C", "g"]
    assert not one(spark, parsers.magic_matches(F.col("a"), F.col("b").cast("binary")), a="x.pdf", b="no")
    assert one(spark, parsers.magic_matches(F.col("a"), F.col("b").cast("binary")), a="x.pdf", b="%PDF-1")
    pages = spark.createDataFrame([(1, "<title>T</title><h1>H</h1><script>x</script><p>a  b</p>"), (2, None)], "page_id long, html string")
    got = {r.page_id: r for r in parsers.parse_html(pages).collect()}
    assert (got[1].title, got[1].text, got[1].headings) == ("T", "H\na b", ["1 H"]) and got[2].text == ""


def test_snapshot_and_upsert(spark):
    schema = "k long, v long"
    old, new = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], schema), spark.createDataFrame([(2, 1), (3, 2), (4, 1)], schema)
    assert {r.k: r.change for r in snapshots.changes(old, new, "k", "v").collect()} == {1: "removed", 2: "same", 3: "modified", 4: "added"}
    assert sorted(map(tuple, snapshots.upsert(old, new, "k").collect())) == [(1, 1), (2, 1), (3, 2), (4, 1)]


def test_descend_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "parent long, child long")
    got = graph.descend(spark.createDataFrame([(1,)], "id long"), edges, 10).collect()
    assert sorted((r.node, r.depth) for r in got) == [(1, 0), (2, 1), (3, 1), (3, 2)]


def test_knapsack_skips_misfits(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, 50), (0, 2, 0.8, 80), (0, 3, 0.1, 40), (1, 4, 0.1, 200)], "scope_id long, id long, score double, tokens long")
    assert sorted(r.id for r in reconcile.knapsack(rows, "scope_id", 100).collect()) == [1, 3]


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    (rows.unionByName(rows.limit(20))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: streams.file_events(spark, str(tmp_path / "in"), rows.schema)
    assert drained(streams.idempotent(stream(), "event_id", "60 days"), "once").count() == 300
    assert drained(streams.tumbling(stream()), "days", "complete").agg(F.sum("n")).first()[0] == 320
    assert drained(streams.sessions(stream()), "sessions", "append").count() >= 0
    assert set(r.outcome for r in drained(streams.last_outcomes(stream()), "outcomes", "update").collect()) <= {"runbook", "anti_runbook"}
    streams.sync(stream().select("user_id", "event_id"), str(tmp_path / "manifest"), str(tmp_path / "cp"), "user_id", "event_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "manifest/0")).count() == rows.select("user_id").distinct().count()


@pytest.mark.parametrize("same", [None, "label"])
def test_every_twentieth_vector_is_asked_in_blocks(spark, monkeypatch, same):
    from textlode.plans import registry

    monkeypatch.setattr(search, "BLOCK", 64)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    gap = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5, 9)
    want = {}
    for q in rows[::20]:
        near = sorted((gap(c.embedding, q.embedding), c.vec_id) for c in rows if same is None or c.label == q.label)
        want[q.vec_id] = [v for _, v in near[: 5 if same else 10]]
    assert all(q % 20 == 0 for q in want) and len(want) == 25
    got = {}
    for r in registry.QUERIES["knn_filtered_topk" if same else "knn_topk"](spark, "/root/testdata/sf0.001").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def test_every_vector_is_judged_against_earlier_ones(spark, monkeypatch):
    from textlode.plans import registry

    monkeypatch.setattr(search, "BLOCK", 100)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    near = {r.vec_id: [gap(r.embedding, o.embedding) for o in rows if o.label == r.label and o.vec_id < r.vec_id] for r in rows}
    want = {k: min(d) <= 0.1**0.5 for k, d in near.items() if d}
    got = {r.vec_id: r.duplicate for r in registry.QUERIES["existing_dups"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and min(got) < 400


def test_distinct_vectors_of_a_large_group(spark, monkeypatch):
    import random

    from textlode.operators import packing

    monkeypatch.setattr(search, "BLOCK", 200)
    rnd, rows = random.Random(4), []
    for i in range(600):  # one group of over 500 rows, a third of them near copies
        if i % 3 == 2:
            rows.append((i, [x + rnd.gauss(0, 0.05) for x in rows[rnd.randrange(i)][1]], 1))
        else:
            rows.append((i, [rnd.gauss(0, 1) for _ in range(8)], 1))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    kept = []
    for i, x, _ in rows:
        if all(cosine(x, rows[k][1]) < 0.8 for k in kept):
            kept.append(i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(r.vec_id for r in packing.greedy_distinct(df, "label", 0.8).collect()) == kept and len(kept) < 500


def test_texts_are_marked_normalised_and_quoted_whole(spark, tmp_path):
    from textlode.plans import registry

    long = "x " * 150 + "the  End, und der Schluß"
    spark.createDataFrame([(1, long, "de", "s", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", "b" * 50), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert run("highlight")[0].marked == "x " * 150 + "**the**  End, und **der** Schluß"
    assert run("text_functions")[0].normal == "x " * 150 + "the end, und der schluß"
    assert {r.turn: r.context for r in run("prior_context")} == {1: long, 2: long + " / " + "b" * 50}


def test_long_conversations_are_compacted_to_the_end(spark):
    from textlode.operators import compaction

    schema = "conv_id long, ordinal long, kind string, text string, tokens long"
    rows = [(1, i, "message", f"{i:03d}" + "x" * 37, 10) for i in range(100)] + [(2, i, "message", "y" * 40, 10) for i in range(6)]
    got = compaction.compact(spark.createDataFrame(rows, schema), tail=3, size=3, budget=100).collect()
    long = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.ordinal)
    assert sum(r.tokens for r in long) <= 100 and [r.kind for r in long[-3:]] == ["message"] * 3 and long[-1].text.startswith("099")
    assert sum(r.conv_id == 2 for r in got) == 6
    by_rounds = spark.createDataFrame(rows[:12], schema)
    for _ in range(4):  # fits after four rounds
        by_rounds = compaction.compact_round(by_rounds, 3, 3, 60)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(compaction.compact(spark.createDataFrame(rows[:12], schema), tail=3, size=3, budget=60)) == same(by_rounds)


def test_quoted_and_coded_texts_have_names_and_null_texts_digests(spark, tmp_path):
    from textlode.plans import registry

    rows = [(1, 'Ann Lee said "blue bolt" to Bo Ray'), (2, "see `Not Me` and\n```\nNor Me\n```\nCy Dee"), (3, None), (4, None), (5, "Ann Lee"), (6, "Ann Lee")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    spark.createDataFrame([(1, "the ann lee of red")], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "blue bolt")], "p_partkey int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = registry.QUERIES["entity_mentions"](spark, str(tmp_path)).collect()
    want = {(1, "ann lee", 0.9), (1, "blue bolt", 0.9), (1, "bo ray", 0.6), (2, "cy dee", 0.6), (5, "ann lee", 0.9), (6, "ann lee", 0.9)}
    assert {(r.doc_id, r.name, r.confidence) for r in got} == want and {r.context_terms for r in got if r.doc_id == 1} == {"ann lee|blue bolt"}
    copies = sorted(map(tuple, registry.QUERIES["exact_dedup"](spark, str(tmp_path)).select("doc_id", "first_id", "duplicate").collect()))
    assert copies == [(1, 1, False), (2, 2, False), (3, 3, False), (4, 3, True), (5, 5, False), (6, 5, True)]

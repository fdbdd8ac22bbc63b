from pyspark.sql import functions as F

from textlode.operators import ingest

FILES = "path string, text string, mtime long, size long"


def files(spark, *rows):
    return spark.createDataFrame([(p, t, m, len(t or "")) for p, t, m in rows], FILES)


def actions(outcome):
    return {r.path: r.action for r in outcome.collect()}


def test_two_batches(spark):
    note = "---\ntitle: One\naliases: [uno]\ntags: [x]\n---\nWords of one. [[Two]] [[UNO]] [[gone]]"
    outcome, counters, store = ingest.ingested(
        files(spark, ("v/one.md", note, 1), ("v/two.txt", "Words of two.", 1), ("v/copy.txt", "Words of two.", 1), ("v/blank.txt", " \n", 1), ("v/a.pdf", "%PDF", 1), ("v/null.txt", None, 1), ("v/bad.txt", "[PDF: x — parse failed]", 1)),
        ingest.empty(spark), tags=("mine",),
    )
    # of equal contents the first path stays
    assert actions(outcome) == {"v/one.md": "add", "v/two.txt": "duplicate", "v/copy.txt": "add", "v/blank.txt": "empty", "v/a.pdf": "failed", "v/null.txt": "unreadable", "v/bad.txt": "failed"}
    assert tuple(counters.first()) == (2, 0, 2, 1)
    meta = {(r.key, r.value) for r in store.metadata.join(store.documents.filter("path = 'v/one.md'").select("document_id"), "document_id", "left_semi").collect()}
    assert meta == {("fileType", "markdown"), ("title", "One"), ("tag:x", "x"), ("tag:mine", "mine"), ("tag:md", "md")}
    two = files(spark, ("v/one.md", note + " Two.", 2), ("v/copy.txt", "Other.", 1), ("w/new.md", "See [[one]], [[uno]] and [[copy]]", 1), ("w/again.txt", "Words of two.", 3))
    outcome, counters, after = ingest.ingested(two, store)
    assert actions(outcome) == {"v/one.md": "update", "v/copy.txt": "duplicate", "w/new.md": "add", "w/again.txt": "duplicate"}  # an equal time is not read on
    assert tuple(counters.first()) == (1, 1, 2, 2)
    paths = {r.document_id: r.path for r in after.documents.collect()}
    assert sorted(paths.values()) == ["v/copy.txt", "v/one.md", "w/new.md"]
    assert {r.document_id for t in (after.chunks, after.metadata, after.links) for r in t.collect()} <= set(paths)
    assert {(paths[r.source], paths[r.target]) for r in ingest.references(after).collect()} == {("w/new.md", "v/one.md"), ("w/new.md", "v/copy.txt")}
    forced = ingest.ingested(two, after, force=True)[0]
    assert actions(forced) == {"v/one.md": "update", "v/copy.txt": "update", "w/new.md": "update", "w/again.txt": "add"}


def test_near_copies_of_chunks(spark):
    near = lambda chunks: chunks.filter(F.contains("text", F.lit("copy")))
    long = "\n\n".join(f"Paragraph {i} " + "word " * 700 for i in range(3))
    mixed = long.replace("Paragraph 1", "copy 1")
    outcome, counters, store = ingest.ingested(files(spark, ("a.txt", "all copy", 1), ("b.txt", mixed, 1), ("c.txt", "plain", 1)), ingest.empty(spark), near=near)
    got = {r.path: (r.action, r.chunks, r.dropped) for r in outcome.collect()}
    assert got["a.txt"] == ("duplicate", 0, 1) and got["c.txt"] == ("add", 1, 0)
    action, chunks, dropped = got["b.txt"]
    assert action == "add" and chunks > 0 and dropped > 0
    assert tuple(counters.first()) == (2, 0, chunks + 1, dropped + 1)
    outcome, _, after = ingest.ingested(files(spark, ("c.txt", "now copy", 2)), store, near=near)
    assert [(r.action, r.chunks) for r in outcome.collect()] == [("update", 1)]  # an update keeps its first chunk
    assert after.documents.count() == 2


def test_stale_files(spark):
    store = ingest.ingested(files(spark, ("a.txt", "a", 5), ("b.txt", "b", 5), ("c.txt", "c", 5)), ingest.empty(spark))[2]
    now = files(spark, ("a.txt", "a", 9), ("b.txt", "b", 5), ("c.txt", "c", 7), ("d.txt", "d", 99))
    assert [r.path for r in ingest.stale(now, store).collect()] == ["a.txt", "c.txt"] and [r.path for r in ingest.stale(now, store, 1).collect()] == ["a.txt"]


def test_empty_batch(spark):
    outcome, counters, store = ingest.ingested(spark.createDataFrame([], FILES), ingest.empty(spark))
    assert outcome.count() == 0 and tuple(counters.first()) == (0, 0, 0, 0) and ingest.references(store).count() == 0


def test_texts_move_and_are_stored_once(spark):
    """No join of the verdicts carries texts, and a batch leaves one table: chunks beside their documents."""
    from pathlib import Path

    from textlode.sources import shared

    rows = files(spark, ("a.txt", "some words", 1), ("b.txt", "some words", 1), ("c.txt", None, 1))

    def joined(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        here = [c.output().apply(i).name() for c in below for i in range(c.output().size())] if node.nodeName() == "Join" else []
        return here + [name for c in below for name in joined(c)]

    plan = ingest.judged(rows, ingest.empty(spark)).drop("text")._jdf.queryExecution().optimizedPlan()
    assert "content_hash" in joined(plan) and "text" not in joined(plan)
    tables = lambda: set(Path(shared.folder(spark).removeprefix("file:")).glob("**/table-*"))
    before = tables()
    outcome, _, store = ingest.ingested(rows, ingest.empty(spark))
    assert {tuple(r) for r in outcome.select("path", "action", "chunks").collect()} == {("a.txt", "add", 1), ("b.txt", "duplicate", 0), ("c.txt", "unreadable", 0)}
    assert [tuple(r) for r in store.chunks.select("position", "text", "parent").collect()] == [(0, "some words", None)]
    assert len(tables() - before) == 1

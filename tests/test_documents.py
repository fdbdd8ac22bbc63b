import pytest

from textlode.sources import documents as D

NOTE = """---
title: "My Note"
author: Kim
date: 2024-01-05
tags: [a, "b c"]
aliases:
  - first
  - 'second one'
---
# Head
See [[Other Note|there]], [[Third#part]] and ![[image.png]] #tag/sub
Line ^ref-1
```python
# not a head
[[not a link]] #no
```
```dataview
LIST
```
## Two
"""


def test_markdown():
    d = D.markdown("x/n.md", NOTE)
    assert (d["title"], d["author"], d["date"], d["aliases"]) == ("My Note", "Kim", "2024-01-05T00:00:00.000Z", ["first", "second one"])
    assert d["tags"] == ["a", "b c", "tag/sub"] and d["links"] == [("Other Note", "there"), ("Third", None)] and d["block_refs"] == ["ref-1"]
    assert "dataview" not in d["text"] and not d["text"].startswith("---")
    cut = lambda kind: [d["text"][s:e] for t, _, _, s, e in d["structure"] if t == kind]
    assert cut("heading") == ["# Head", "## Two"] and cut("code_block")[0].startswith("```python") and [x[2] for x in d["structure"] if x[0] == "code_block"] == ["python"]
    assert D.markdown("a/b.c.md", "no heading")["title"] == "b.c" and D.markdown("a.md", "text\n## Late  one")["title"] == "Late  one"


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ("title: 5\ntags: x, y\naliases: solo", {"title": "5", "author": None, "date": None, "tags": ["x", "y"], "aliases": ["solo"]}),
        ("title: 'T'\n???\ntags: ['p', q]", {"title": "T", "author": None, "date": None, "tags": ["p", "q"], "aliases": None}),
        ("tags:\n- one\n- two\nnested:\n  a: 1", {"title": None, "author": None, "date": None, "tags": ["one", "two"], "aliases": None}),
    ],
)
def test_front_matter(block, want):
    assert D.described(block) == want


def test_json():
    assert D.records("a.json", '{"a": {"b": 1.0, "c": [1, null, "x"]}, "d": [{"e": true}, {"e": null}], "f": []}')["text"] == "a.b: 1\na.c: 1, , x\nd[0].e: true\nd[1].e: null\nf: "
    assert D.records("a.json", '[{"a": 1}, 5]')["text"] == "a: 1\n\n5" and D.records("a.json", "{bad")["text"] == "{bad"
    assert D.records("a.jsonl", '{"a": 1}\n\nbad\n{"b": 2}')["text"] == "a: 1\n\nbad\n\nb: 2"
    deep = '{"k": ' * 20 + "1" + "}" * 20
    assert D.records("a.json", deep)["text"].endswith(": [nested object]")


def test_mail():
    text = "Subject: Hi\nFrom: Ann <a@x.y>\nTo: b@x.y\nCc: c@x.y\nBcc: d@x.y\nDate: Fri, 05 Jan 2024 10:00:00 +0100\n\nBody\n"
    d = D.mail("m.eml", text)
    assert d["text"] == "Subject: Hi\nFrom: Ann <a@x.y>\nTo: b@x.y\nCC: c@x.y\nBCC: d@x.y\nDate: 2024-01-05T09:00:00.000Z\n\nBody"
    assert (d["title"], d["author"], d["tags"]) == ("Hi", "Ann <a@x.y>", None)
    rich = 'MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>One</p><p>Two</p>\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename="f.txt"\n\nx\n--b--\n'
    d = D.mail("m.eml", rich)
    assert d["title"] == "Untitled Email" and d["tags"] == ["has-attachments"] and d["text"].endswith("\n\nOne Two\n\nAttachments: f.txt")


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.py", "async def f():\n  def g(): pass\nclass C: pass", [("async def f", 2), ("class C", 1)]), ("a.ts", "export abstract class A {}\nconst f = async (x) => 1\ninterface I {}", [("export abstract class A", 1), ("const f = async (", 2), ("interface I", 1)]),
        ("a.go", "func (s *T) Do() {}", [("func (s *T) Do", 2)]), ("a.rs", "pub struct S;\nimpl S {}", [("pub struct S", 1), ("impl ", 1)]), ("a.sql", "create table t (a int)", [("create table t", 2)]),
        ("A.SH", "go() {\n}", [("go()", 2)]), ("a.r", "f <- function(x) x", [("f <- function", 2)]),
    ],
)
def test_code(path, text, want):
    d = D.code(path, text)
    assert [(text[s:e], level) for _, level, _, s, e in d["structure"]] == want and d["tags"] == [D.LANGUAGES[path.rsplit(".", 1)[1].lower()]]


def test_registry_over_a_table(spark, tmp_path):
    page = '<html><head><title>T</title><meta name="author" content="Kim"><meta property="article:published_time" content="2024"></head><body><h1>Head</h1><p>Words</p></body></html>'
    files = [
        ("x/n.md", NOTE), ("a.TXT", "plain"), ("p.html", page), ("t.tsv", "a\tb\n1\t2"), ("c.canvas", '{"nodes": [{"type": "file", "file": "z.md"}]}'), ("b.pdf", "%PDF"), ("noext", "x"), ("e.md", None), (None, "x"), ("q.csv", ""),
    ]
    got = {r.path: r for r in D.parsed(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["x/n.md"].title == "My Note" and got["x/n.md"].links[0].target == "Other Note" and got["x/n.md"].structure[0].type == "code_block"
    assert (got["a.TXT"].kind, got["a.TXT"].text) == ("plaintext", "plain")
    assert (got["p.html"].title, got["p.html"].author, got["p.html"].date, got["p.html"].text) == ("T", "Kim", "2024", "Head\nWords")
    assert got["t.tsv"].kind == "tsv" and got["t.tsv"].structure[0].type == "table" and got["c.canvas"].links[0].target == "z.md"
    assert got["b.pdf"].problem == "no parser for .pdf" and got["noext"].problem == got[""].problem == "no parser for ." and got["e.md"].problem == "no text" and got["q.csv"].text == ""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Äh")
    (tmp_path / "in" / "b.png").write_bytes(b"no png")
    read = {r.path.rsplit("/", 1)[1]: r.text for r in D.read(spark, str(tmp_path / "in")).collect()}
    assert read == {"a.md": "# Äh", "b.png": None}


def test_sessions_as_lines_and_as_arrays(spark):
    rows = [
        ("lines", '{"role": "user", "content": "hi"}\r\n\r\nbroken\n{"id": 1, "message": {"role": "assistant", "content": "yes"}}\n{"type": "x"}'),
        ("array", ' [{"role": "user", "content": "one"}, 5, {"no": 1}, {"role": "tool", "command": "ls", "output": "a"}]'), ("bad", "[broken"), ("empty", " "), ("null", None),
    ]
    got = sorted(tuple(r) for r in D.session_messages(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("array", 0, "user", "one"), ("array", 3, "tool", "ls\na"), ("lines", 0, "user", "hi"), ("lines", 3, "assistant", "yes")]


def test_titles_of_pages_keep_the_escapes_that_sql_keeps(spark, tmp_path):
    import os

    from textlode.plans.registry import QUERIES

    for name in ("documents", "events", "part", "nation"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    pages = [(1, "<title>a&amp;&amp</title><p>x"), (2, "<title> b  &quot;&lt;&amp;gt;\n</title>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.path: r.title for r in QUERIES["parsed_documents"](spark, str(tmp_path)).filter("kind = 'html'").collect()}
    assert got == {"p1.html": "a&&amp", "p2.html": "b &quot;<&gt;"}

"""Parsers of tables, canvases, blocks and sessions."""

import json

import pytest

from textlode.sources import parsers as P


def test_csv_and_tsv():
    assert P.parse_csv('name, age\n"Doe, J", 3\n\nx\n', "a.csv") == "name | age\n----------\nDoe, J | 3\nx | "
    assert P.parse_csv("a\tb\n1,5\t2\n") == P.parse_csv("a\tb\n1,5\t2\n", "x.TSV") == "a | b\n-----\n1,5 | 2"
    assert P.parse_csv("") == P.parse_csv("only,header\n", "a.csv") == ""


def test_canvas():
    nodes = [{"type": "text", "text": " hello "}, {"type": "file", "file": "a/b.md"}, {"type": "link", "url": "https://x.y"}, {"type": "group", "label": "G"}, {"type": "text"}, {"type": "odd"}]
    found = P.parse_canvas(json.dumps({"nodes": nodes, "edges": [{"label": "leads to"}, {}]}))
    assert found == {"text": "hello\n\n[Linked file: a/b.md]\n\n[Link: https://x.y]\n\n--- G ---\n\n[Connection: leads to]", "links": ["a/b.md"]}
    assert P.parse_canvas("not json") == P.parse_canvas("{}") == {"text": "", "links": []}


WORDS = [{"plain_text": "bold", "annotations": {"bold": True, "code": True}}, {"plain_text": " and "}, {"plain_text": "link", "href": "https://x.y"}]


@pytest.mark.parametrize(
    ("kind", "data", "want"),
    [
        ("paragraph", {"rich_text": WORDS}, "`**bold**` and [link](https://x.y)"), ("heading_2", {"rich_text": WORDS[1:2]}, "##  and "), ("to_do", {"rich_text": [], "checked": True}, "- [x] "),
        ("code", {"rich_text": [{"plain_text": "x = 1"}], "language": "python"}, "```python\nx = 1\n```"), ("image", {"external": {"url": "u"}}, "![image](u)"), ("divider", {}, "---"),
        ("bookmark", {"url": "u"}, "[u](u)"), ("equation", {"expression": "a"}, "$$a$$"), ("child_page", {"title": "T"}, "**[T]**"), ("child_database", {"title": "T"}, "**[Database: T]**"),
        ("table_of_contents", {}, None), ("unknown", {"rich_text": WORDS[1:2]}, " and "), ("unknown", {}, None), ("quote", {"rich_text": None}, "> "),
    ],
)
def test_blocks(kind, data, want):
    assert P.block_markdown({"type": kind, kind: data}) == want
    assert P.block_markdown({}) is None and P.block_markdown({"type": kind}) is None


def test_sessions(spark):
    lines = ['{"role": "user", "content": "hi"}', '{"id": 3, "message": {"role": "assistant", "content": "yes"}}', "broken {", "", '{"type": "session"}', '{"message": null}']
    rows = P.session_messages(spark.createDataFrame(list(enumerate(lines)), "place long, value string")).collect()
    assert sorted(map(tuple, rows)) == [(0, "user", "hi"), (1, "assistant", "yes")]

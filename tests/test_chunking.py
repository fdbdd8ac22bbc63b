"""Chunking by kind, against the facts that each strategy must meet and a plain loop over prose."""

import math
import random
import re

import pytest

from textlode.operators import chunking as C
from textlode.sources import parsers

MARKDOWN = "intro words\n\n# Title\n\ntext a\n\n## Sub One\n\ntext b\n```\n# no heading\n```\n\n## Sub Two\n\n### Deep\n\ntext c\n# Next\nend"


def size(text):
    return math.ceil(len(text) / 3.8)


def plain_prose(text, target, most):
    """The fill of prose as one loop with two buffers."""
    out, buffer, total = [], [], 0
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        if size(paragraph) > most:
            if buffer:
                out.append("\n\n".join(buffer))
            buffer, total, line, n = [], 0, [], 0
            for s in C.sentences(paragraph):
                if size(s) > most and not line:
                    out += [s[i : i + 4 * most] for i in range(0, len(s), 4 * most)]
                    continue
                if n + size(s) > most and line:
                    out.append(" ".join(line))
                    line, n = [], 0
                line.append(s)
                n += size(s)
            if line:
                out.append(" ".join(line))
            continue
        if total + size(paragraph) > target and buffer:
            out.append("\n\n".join(buffer))
            buffer, total = [], 0
        buffer.append(paragraph)
        total += size(paragraph)
    return out + (["\n\n".join(buffer)] if buffer else [])


def test_prose_against_a_plain_loop():
    rnd = random.Random(3)
    word = lambda: "w" * rnd.choice([1, 3, 8, 8, 30, 200])
    for _ in range(300):
        text = "".join(word() + rnd.choice([" ", " ", ". ", "! ", "\n", "\n\n", "\n \n"]) for _ in range(rnd.randrange(120)))
        for target, most in ((20, 40), (50, 50), (5, 100)):
            assert C.prose(text, target, most) == plain_prose(text, target, most)


def test_a_long_paragraph_fills_to_the_most_and_joins_by_spaces():
    text = " ".join(f"Sentence number {i} is here." for i in range(400))
    found = list(C.by_prose("before\n\n" + text + "\n\nafter", 512, 1024))
    assert found[0].text == "before" and found[-1].text == "after" and not any("\n" in c.text for c in found)
    assert all(900 < c.tokens <= 1024 for c in found[1:-2]) and " ".join(c.text for c in found[1:-1]) == text


def test_sentences():
    assert C.sentences("The U.S. Army came at 5 p.m. today. It left.") == ["The U.S. Army came at 5 p.m. today.", "It left."]
    assert C.sentences("See fig. 3, e.g. that of Corp. Jones et al. and 3.14. 15 more... Then? Yes!! J. Doe") == [
        "See fig. 3, e.g. that of Corp. Jones et al. and 3.14. 15 more...", "Then?", "Yes!!", "J. Doe",
    ]
    assert C.sentences(" \n ") == [] and C.sentences("wait\nfor it. ok") == ["wait for it.", "ok"]
    assert len(C.ABBREVIATIONS) == 39


def test_markdown_sections_carry_their_chain_of_headings():
    marks = parsers.marks_of("markdown", MARKDOWN)
    found = list(C.by_headings(MARKDOWN, marks, 2000))
    assert [c.prefix for c in found] == ["", "Title", "Title > Sub One", "Title > Sub Two", "Title > Sub Two > Deep", "Next"]
    assert found[2].text.startswith("## Sub One") and "# no heading" in found[2].text
    long = "# A\n\n" + "\n\n".join("word " * 60 for _ in range(10))
    parts = list(C.by_headings(long, parsers.marks_of("markdown", long), 200))
    assert len(parts) > 3 and all(c.prefix == "A" and c.tokens <= 200 for c in parts)


def test_code_by_definitions():
    setup = "import os\n" + "x = 1\n" * 30
    code = setup + "\ndef a():\n    pass\n\nclass B:\n    y = 2\n"
    found = list(C.by_definitions(code, parsers.marks_of("code", code), 1000))
    assert [c.prefix for c in found] == ["imports / module setup", "def a():", "class B:"] and found[1].text == "def a():\n    pass"
    assert [c.prefix for c in C.by_definitions("import os\ndef a(): pass", parsers.marks_of("code", "import os\ndef a(): pass"), 1000)] == ["def a(): pass"]
    lines = "\n".join(f"line {i}" for i in range(400))
    assert "\n".join(c.text for c in C.by_definitions(lines, [], 100)) == lines


def test_tables_repeat_their_header():
    rows = [f"{i},v" for i in range(45)]
    found = list(C.by_rows("a,b\n" + "\n".join(rows), 1000))
    assert [c.prefix for c in found] == ["rows 1-20", "rows 21-40", "rows 41-45"] and all(c.text.startswith("a,b\n") for c in found)
    ruled = list(C.by_rows("|a|b|\n|---|---|\n" + "\n".join(rows), 1000))
    assert ruled[1].text.startswith("|a|b|\n|---|---|\n20,v")
    wide = list(C.by_rows("a\n" + "\n".join("x" * 300 for _ in range(20)), 500))
    assert [c.prefix for c in wide] == ["rows 1-6", "rows 7-12", "rows 13-18", "rows 19-20"] and all(c.tokens <= 500 for c in wide)
    assert [c.text for c in C.by_rows("a,b\n---", 100)] == ["a,b"]


def test_small_chunks_join_the_one_before_and_lines_overlap():
    chunks = [C.Chunk("a" * 500, "A", 132), C.Chunk("b", "B", 1), C.Chunk("c" * 500, "", 132)]
    joined = C.merged(chunks, 100)
    assert [(c.prefix, len(c.text)) for c in joined] == [("A | B", 503), ("", 500)]
    first, second = C.overlapped([C.Chunk("\n".join(map(str, range(10))), "", 5), C.Chunk("next", "N", 2)], 102)
    assert second == C.Chunk("7\n8\n9\nnext", "N", size("7\n8\n9\nnext")) and first.text.count("\n") == 9


def test_a_long_run_of_small_chunks_is_joined_once(monkeypatch):
    measured = []
    monkeypatch.setattr(C, "tokens_of", lambda text: measured.append(len(text)) or size(text))
    chunks = [C.Chunk("a" * 500, "", 132), *(C.Chunk(f"b{i}", f"p{i}" if i % 2 else "", 1) for i in range(2000)), C.Chunk("c", "C", 100)]
    first, last = C.merged(chunks, 100)
    assert first.text == "\n\n".join(c.text for c in chunks[:-1]) and first.prefix == " | ".join(f"p{i}" for i in range(1, 2000, 2))
    assert first.tokens == size(first.text) and last == chunks[-1] and C.merged([], 100) == [] and C.merged(chunks[1:2], 100) == chunks[1:2]
    assert measured == [len(first.text)]  # once for all, not once for each that joins


@pytest.mark.parametrize("kind", ["text", "markdown", "html", "code", "csv", "pdf", None])
def test_empty_texts_have_no_chunks(kind):
    assert C.chunked(None, kind) == C.chunked(" \n ", kind) == []


def test_documents_of_every_kind(spark):
    from textlode.plans.registry import QUERIES

    rows = QUERIES["document_chunks"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {k.split()[0] for k in by} == {"page", "conversation", "region", "brand", "document"}
    assert all(sorted(r.position for r in found) == list(range(len(found))) for found in by.values())
    assert any(" > " in r.prefix for r in rows if r.doc_id.startswith("conversation"))
    assert any(r.prefix for r in rows if r.doc_id.startswith("page"))
    documents = {f"document {r.doc_id}": r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for k, text in documents.items():
        whole = plain_prose(text or "", 512, 1024)
        last = [r for r in sorted(by.get(k, []), key=lambda r: r.position)]
        assert bool(last) == bool(whole) and (not whole or (last[0].text.startswith(whole[0]) and last[-1].text.endswith(whole[-1])))

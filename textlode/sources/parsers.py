"""Parsers of document formats: small functions for one text, applied by Arrow batches."""

from __future__ import annotations

import csv
import io
import json
import re
from email import message_from_string, policy
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions.batches import flat_map

#: First bytes, in hexadecimal digits, that a format's files must have.
MAGIC = {"pdf": "25504446", "png": "89504E47", "jpg": "FFD8FF", "zip": "504B0304", "docx": "504B0304", "pptx": "504B0304", "xlsx": "504B0304", "epub": "504B0304"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def magic_matches(path: Column, content: Column) -> Column:
    """Do the first bytes fit the extension? Formats without a signature always do."""
    head, fits = F.hex(F.substring(content, 1, 4)), F.lit(True)
    for kind, want in MAGIC.items():
        fits = F.when(extension(path) == kind, head.startswith(want)).otherwise(fits)
    return fits


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.title, self.parts, self.headings, self.skip, self.inside = "", [], [], 0, ""
        self.marks, self.length = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "nav", "footer")
        if tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.inside = tag

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style", "nav", "footer")))
        if tag == self.inside:
            self.inside = ""

    def handle_data(self, data):
        data = " ".join(data.split())
        if not data or self.skip:
            return
        if self.inside == "title":
            self.title += data
        else:
            self.parts.append(data)
            if self.inside:
                self.headings.append(f"{self.inside[1]} {data}")
                self.marks.append((self.length, self.length + len(data), int(self.inside[1])))
            self.length += len(data) + 1


def parse_html(pages: DataFrame) -> DataFrame:
    """page_id, title, text and headings (level and words)."""

    def make(k: int, html: str | None) -> list[tuple]:
        parser = _Text()
        parser.feed(html or "")
        return [(k, parser.title, "\n".join(parser.parts), parser.headings)]

    return flat_map(pages.select("page_id", "html"), make, "page_id long, title string, text string, headings array<string>")


def html_documents(pages: DataFrame) -> DataFrame:
    """page_id, title, text and headings as (start, end, level) in it: what the chunker takes."""

    def make(k: int, html: str | None) -> list[tuple]:
        parser = _Text()
        parser.feed(html or "")
        return [(k, parser.title, "\n".join(parser.parts), [dict(zip(("start", "end", "level"), m, strict=True)) for m in parser.marks])]

    schema = "page_id long, title string, text string, headings array<struct<start:int,end:int,level:int>>"
    return flat_map(pages.select("page_id", "html"), make, schema)


DEFINITION = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:async\s+)?(?:def|class|function|func|fn|interface|struct)\s+[A-Za-z_]\w*.*$", re.ASCII)


def marks_of(kind: str, text: str) -> list[tuple[int, int, int]]:
    """(start, end, level) of the headings of Markdown (outside fenced code) or of the definitions of code."""
    if kind == "code":
        return [(m.start(), m.end(), 1) for m in DEFINITION.finditer(text)]
    if kind != "markdown":
        return []
    out, at, fenced = [], 0, False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        heading = re.match(r"(#{1,6})\s+\S", line)
        if heading and not fenced:
            out.append((at, at + len(line), len(heading[1])))
        at += len(line) + 1
    return out


def flatten_json(value, path: str = "", depth: int = 15) -> list[str]:
    """Lines ``a.b[0]: value`` down to a depth."""
    if isinstance(value, dict) and depth:
        return [x for k, v in value.items() for x in flatten_json(v, f"{path}.{k}" if path else k, depth - 1)]
    if isinstance(value, list) and depth:
        return [x for i, v in enumerate(value) for x in flatten_json(v, f"{path}[{i}]", depth - 1)]
    return [f"{path}: {json.dumps(value) if isinstance(value, dict | list) else value}"]


def parse_json_lines(text: str) -> str:
    """Records flattened and joined by blank lines; a bad line stays as it is."""
    out = []
    for line in filter(str.strip, text.splitlines()):
        try:
            out.append("\n".join(flatten_json(json.loads(line))))
        except ValueError:
            out.append(line)
    return "\n\n".join(out)


def parse_email(text: str) -> dict:
    m = message_from_string(text, policy=policy.default)
    body = m.get_body(("plain", "html"))
    head = {k.lower(): m[k] for k in ("Subject", "From", "To", "Cc", "Date") if m[k]}
    return head | {"body": body.get_content().strip() if body else "", "attachments": [p.get_filename() for p in m.iter_attachments()]}


def markdown_headings(text: Column) -> Column:
    """ATX headings outside fenced code."""
    plain = F.regexp_replace(text, "(?s)```.*?(```|$)", "")
    return F.regexp_extract_all(plain, F.lit("(?m)^#{1,6} +(.+?) *#* *$"), F.lit(1))


def frontmatter(text: Column) -> Column:
    """Keys and values of the lines between two leading rules of dashes."""
    block = F.regexp_extract(text, "(?s)^---\\n(.*?)\\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda line: F.contains(line, F.lit(":")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^:]*):", 1)), F.trim(F.regexp_extract(p, ":(.*)$", 1)))))


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\[\\[([^\\]|#]+)"), F.lit(1))


def code_definitions(text: Column) -> Column:
    """Names of functions and classes in Python-like and C-like code."""
    return F.regexp_extract_all(text, F.lit("(?m)^\\s*(?:export\\s+)?(?:async\\s+)?(?:def|class|function|func|fn|interface|struct)\\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def parse_csv(text: str, path: str = "") -> str:
    """Header, a rule of dashes and rows, cells joined by bars. Tabs part cells by the file's name or by the first line."""
    first = text.split("\n", 1)[0]
    tabs = path.lower().endswith(".tsv") or (not path.lower().endswith(".csv") and first.count("\t") > first.count(","))
    rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text), delimiter="\t" if tabs else ",") if any(c.strip() for c in row)]
    if len(rows) < 2:
        return ""
    width = len(rows[0])
    lines = [" | ".join((row + [""] * width)[:width]) for row in rows]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


#: What a node of a canvas says, by its type: the field that must be there, and the text around it.
CANVAS = {"text": ("text", "{}"), "file": ("file", "[Linked file: {}]"), "link": ("url", "[Link: {}]"), "group": ("label", "--- {} ---")}


def parse_canvas(text: str) -> dict:
    """text and links of a canvas: its nodes, then the labels of its edges. Text that is no JSON gives none."""
    try:
        canvas = json.loads(text)
    except ValueError:
        return {"text": "", "links": []}
    nodes = [(n, *CANVAS[n["type"]]) for n in canvas.get("nodes") or [] if n.get("type") in CANVAS]
    parts = [form.format(n[field].strip()) for n, field, form in nodes if n.get(field)]
    parts += [f"[Connection: {e['label']}]" for e in canvas.get("edges") or [] if e.get("label")]
    return {"text": "\n\n".join(parts), "links": [n["file"] for n, field, _ in nodes if field == "file" and n.get("file")]}


#: What a block says in Markdown; the words of rich text stand for {}.
BLOCKS = {
    "paragraph": "{}", "heading_1": "# {}", "heading_2": "## {}", "heading_3": "### {}", "bulleted_list_item": "- {}", "numbered_list_item": "1. {}",
    "toggle": "> {}", "quote": "> {}", "callout": "> {}",
}
#: Marks of rich text, the innermost first.
MARKS = (("bold", "**"), ("italic", "*"), ("strikethrough", "~~"), ("code", "`"))


def rich_text(spans: list | None) -> str:
    out = ""
    for span in spans or []:
        word = span.get("plain_text") or ""
        for name, mark in MARKS:
            if (span.get("annotations") or {}).get(name):
                word = f"{mark}{word}{mark}"
        out += f"[{word}]({span['href']})" if span.get("href") else word
    return out


def block_markdown(block: dict) -> str | None:
    """Markdown of one block, or None if it has none."""
    kind = block.get("type")
    data = block.get(kind) if kind else None
    if data is None or kind == "table_of_contents":
        return None
    words, url = rich_text(data.get("rich_text")), data.get("url")
    if kind in BLOCKS:
        return BLOCKS[kind].format(words)
    if kind == "to_do":
        return f"- [{'x' if data.get('checked') else ' '}] {words}"
    if kind == "code":
        return f"```{data.get('language') or ''}\n{words}\n```"
    if kind == "image":
        return f"![image]({((data.get('file') or data.get('external')) or {}).get('url') or ''})"
    fixed = {
        "divider": "---", "bookmark": f"[{url}]({url})", "link_preview": f"[{url}]({url})", "equation": f"$${data.get('expression')}$$",
        "child_page": f"**[{data.get('title')}]**", "child_database": f"**[Database: {data.get('title')}]**",
    }
    return fixed.get(kind, words if data.get("rich_text") else None)


MESSAGE = "role string, content string"


def session_messages(lines: DataFrame) -> DataFrame:
    """place, role, content of a session's lines (place, value): a message, or a record that holds one. Other lines are skipped."""
    whole, inner = F.from_json("value", MESSAGE), F.from_json("value", f"message struct<{MESSAGE}>")["message"]
    read = lines.select("place", F.coalesce(F.when(inner["role"].isNotNull(), inner), F.when(whole["role"].isNotNull(), whole)).alias("m"))
    return read.filter("m IS NOT NULL").select("place", "m.role", "m.content")

"""Files as documents: a parser for each extension, applied to a table of files by Arrow batches.

``parsed`` gives each file (path, text) its text, title and metadata, and the places of headings, code and tables in it.
Extensions without a parser here, and files whose first bytes do not fit theirs, have a ``problem`` and no text; so have null
texts. Malformed content falls back to plainer readings, as each parser says. Repeated files are parsed each.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import re
from collections.abc import Callable, Iterator
from email import message_from_string, policy
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions.batches import arrow_schema, slices
from textlode.sources import parsers

SCHEMA = (
    "path string, kind string, title string, author string, date string, text string, tags array<string>, aliases array<string>, links array<struct<target:string,display:string>>, "
    "block_refs array<string>, structure array<struct<type:string,level:int,language:string,start:int,end:int>>, problem string"
)
COLUMNS = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", SCHEMA)]
#: Languages by extension, and what opens a definition in each.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "java": "java", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "cs": "csharp", "sh": "bash", "ps1": "powershell", "sql": "sql", "lua": "lua", "r": "r", "scala": "scala",
}
DEFINITIONS = {
    "javascript": r"^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:\(|function))|^(?:export\s+)?class\s+\w+",
    "typescript": r"^(?:export\s+)?(?:async\s+)?(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:\(|function))|^(?:export\s+)?(?:abstract\s+)?class\s+\w+|^(?:export\s+)?interface\s+\w+",
    "python": r"^(?:async\s+)?(?:def|class)\s+\w+",
    "go": r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?\w+",
    "rust": r"^(?:pub\s+)?(?:async\s+)?fn\s+\w+|^(?:pub\s+)?struct\s+\w+|^(?:pub\s+)?enum\s+\w+|^impl\s+",
    "java": r"^(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface|enum)\s+\w+|^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+){1,5}\w+\s*\(",
    "c": r"^(?:\w+\s+){1,5}\w+\s*\([^)]{0,200}\)\s*\{",
    "cpp": r"^(?:class|struct)\s+\w+|^(?:\w+\s+){1,5}\w+\s*\([^)]{0,200}\)\s*(?:const\s*)?\{",
    "ruby": r"^(?:class|module|def)\s+(\w+)",
    "php": r"^(?:class|function|interface|trait)\s+(\w+)",
    "swift": r"^(?:class|struct|enum|protocol|func)\s+(\w+)",
    "kotlin": r"^(?:class|fun|object|interface)\s+(\w+)",
    "csharp": r"^(?:class|struct|interface|enum|void|static\s+\w+)\s+(\w+)",
    "bash": r"^(?:function\s+)?(\w+)\s*\(\)",
    "powershell": r"(?i)^function\s+(\w[\w-]*)",
    "sql": r"(?i)^CREATE\s+(?:TABLE|VIEW|INDEX|FUNCTION|PROCEDURE)\s+\w+",
    "lua": r"^(?:local\s+)?function\s+(\w+)",
    "r": r"^(\w+)\s*<-\s*function",
    "scala": r"^(?:class|object|trait|def)\s+(\w+)",
}
DEEPEST = 15
DYNAMIC = r"(?ms)^```(?:dataview|dataviewjs|tasks)\r?\n.*?\r?\n\s*```$"
FENCED = r"(?ms)^```(\w*)\r?\n.*?\r?\n\s*```$"
HEADING = r"(?m)^(#{1,6})\s+(.+)$"
WIKILINK = r"(?<!!)\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|([^\]]+))?\]\]"
TAG = r"(?:^|\s)#([a-zA-Z][a-zA-Z0-9_/-]*)"
BLOCK_REF = r"(?m)(?:^|\s)\^([a-zA-Z0-9-]+)\s*$"
FRONT = r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n"
STRUCTURES = ("class", "struct", "interface", "impl")


def base_name(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def plain_text(path: str, text: str) -> dict:
    return {"kind": "plaintext", "title": base_name(path), "text": text}


def scalar(value: str):
    """A plain or quoted value of front matter; numbers, flags and dates as they are written out."""
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        return value[1:-1]
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        return f"{value}T00:00:00.000Z"
    return re.sub(r"\s+#.*$", "", value)


def front_matter(block: str) -> dict | None:
    """Keys and values (texts or lists) of a block of ``key: value`` lines and lists; None if it is anything else."""
    found, key = {}, None
    for line in block.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item, pair = re.match(r"\s*-\s+(.*)$", line), re.match(r"([A-Za-z0-9_][\w \t-]*?):(?:[ \t]+(.*)|)$", line)
        if item and key is not None and found[key] in ("", None) or item and key is not None and isinstance(found[key], list):
            found[key] = [*(found[key] or []), scalar(item[1])]
        elif pair:
            key, value = pair[1].strip(), (pair[2] or "").strip()
            if value.startswith("[") != value.endswith("]"):
                return None
            found[key] = [scalar(v) for v in next(csv.reader([value[1:-1]], skipinitialspace=True), [])] if value.startswith("[") else scalar(value)
        elif not line.startswith((" ", "\t")):
            return None
    return found


def described(block: str) -> dict:
    """title, author, date, tags, aliases of front matter; by single patterns where it is malformed."""
    found = front_matter(block)
    if found is None:
        one = lambda name: (re.search(rf"(?m)^{name}:\s*[\"']?(.+?)[\"']?\s*$", block) or [None, None])[1]
        tags = re.search(r"(?m)^tags:\s*\[(.+?)\]", block)
        return {"title": one("title"), "author": one("author"), "date": one("date"), "tags": [re.sub("[\"']", "", t.strip()) for t in tags[1].split(",")] if tags else None, "aliases": None}
    text = lambda name: found.get(name) if isinstance(found.get(name), str) and found[name] else None
    many = lambda name, cut: [t for t in (v.strip() for v in (found[name] if isinstance(found[name], list) else found[name].split(",") if cut else [found[name]])) if t] if found.get(name) else None
    return {"title": text("title"), "author": text("author"), "date": text("date"), "tags": many("tags", True), "aliases": many("aliases", False)}


def markdown(path: str, text: str) -> dict:
    """Notes: front matter, links, tags and block references outside code, headings and code; blocks that are queries go."""
    head = re.match(FRONT, text)
    found = described(head[1]) if head else {"title": None, "author": None, "date": None, "tags": None, "aliases": None}
    text = re.sub(DYNAMIC, "", text[head.end() :] if head else text)
    fences = list(re.finditer(FENCED, text))
    outside = lambda pattern: [m for m in re.finditer(pattern, text) if not any(f.start() <= m.start() <= f.end() for f in fences)]
    headings = outside(HEADING)
    structure = [("code_block", None, f[1] or None, f.start(), f.end()) for f in fences] + [("heading", len(m[1]), None, m.start(), m.end()) for m in headings]
    links = [(m[1].strip(), m[2].strip() if m[2] else None) for m in outside(WIKILINK) if m[1].strip()]
    tags = [m[1] for m in outside(TAG)]
    title = found["title"] or (re.sub(r"^#+\s+", "", headings[0][0]) if headings else re.sub(r"\.[^.]+$", "", base_name(path)))
    merged = list(dict.fromkeys([*(found["tags"] or []), *tags])) if tags else found["tags"]
    return found | {"kind": "markdown", "title": title, "text": text, "tags": merged, "links": links or None, "block_refs": [m[1] for m in outside(BLOCK_REF)] or None, "structure": structure}


def html(path: str, text: str) -> dict:
    """Visible text; title, author and date of the head, headings where they stand in the text."""
    parser = parsers._Text()
    parser.feed(text)
    meta = {}
    for tag in re.findall(r"(?is)<meta\b[^>]*>", text):
        attributes = {k.lower(): v for k, _, v in re.findall(r"""([\w:-]+)\s*=\s*(["'])(.*?)\2""", tag)}
        meta.setdefault((attributes.get("name") or attributes.get("property") or "").lower(), attributes.get("content"))
    body = "\n".join(parser.parts)
    marks = [("heading", level, None, start, end) for start, end, level in parser.marks]
    return {"kind": "html", "title": parser.title or re.sub(r"\.html$", "", base_name(path)), "author": meta.get("author"), "date": meta.get("date") or meta.get("article:published_time"), "text": body, "structure": marks}


def table(path: str, text: str) -> dict:
    shown = parsers.parse_csv(text, path)
    first = re.split(r"\r?\n", text, maxsplit=1)[0]
    tabs = path.lower().endswith(".tsv") or first.count("\t") > first.count(",")
    return {"kind": "tsv" if tabs else "csv", "title": base_name(path), "text": shown, "structure": [("table", None, None, 0, len(shown))] if shown else []}


def written(value) -> str:
    """A JSON value as text: flags and null in small letters, whole numbers without a point."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return "[object Object]" if isinstance(value, dict) else ",".join("" if v is None else written(v) for v in value) if isinstance(value, list) else str(value)


def flat(value, path: str = "", depth: int = 0) -> str:
    """Lines ``a.b: value``; lists of objects by number, other lists joined by commas."""
    if depth > DEEPEST:
        return f"{path}: [nested object]"
    if isinstance(value, list):
        value = {str(i): v for i, v in enumerate(value)}
    if not isinstance(value, dict):
        return f"{path}: {written(value)}" if path else written(value)
    lines = []
    for k, v in value.items():
        at = f"{path}.{k}" if path else k
        if isinstance(v, dict):
            lines.append(flat(v, at, depth + 1))
        elif isinstance(v, list) and v and isinstance(v[0], dict | list):
            lines += [flat(x, f"{at}[{i}]", depth + 1) for i, x in enumerate(v)]
        elif isinstance(v, list):
            lines.append(f"{at}: {', '.join('' if x is None else written(x) for x in v)}")
        else:
            lines.append(f"{at}: {written(v)}")
    return "\n".join(lines)


def records(path: str, text: str) -> dict:
    """JSON and lines of it, flattened; malformed JSON stays as it is."""
    out = {"kind": "json", "title": base_name(path)}
    if path.lower().endswith(".jsonl"):
        parts = []
        for line in filter(str.strip, text.split("\n")):
            try:
                parts.append(flat(json.loads(line)))
            except ValueError:
                parts.append(line)
        return out | {"text": "\n\n".join(parts)}
    try:
        value = json.loads(text)
    except ValueError:
        return out | {"text": text}
    return out | {"text": "\n\n".join(map(flat, value)) if isinstance(value, list) else flat(value)}


def mail(path: str, text: str) -> dict:
    """Head lines and body, plain text before HTML, and the names of attachments."""
    m = message_from_string(text, policy=policy.default)
    try:
        date = parsedate_to_datetime(str(m["Date"])).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z") if m["Date"] else None
    except ValueError:
        date = None
    said = lambda name: str(m[name]) if m[name] else None
    parts = [f"Subject: {said('Subject') or '(no subject)'}", f"From: {said('From') or 'unknown'}", f"To: {said('To') or 'unknown'}"]
    parts += [f"{name.upper()}: {said(name)}" for name in ("Cc", "Bcc") if said(name)] + ([f"Date: {date}"] if date else []) + [""]
    body = m.get_body(("plain", "html"))
    if body is not None:
        content = body.get_content()
        if body.get_content_type() == "text/html":
            content = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)</?(p|div|br|h[1-6]|li|tr|td|th|blockquote)[^>]*>", "\n", content))
            content = re.sub(r"\s+", " ", content)
        parts.append(content.strip())
    names = [p.get_filename() or "unnamed" for p in m.iter_attachments()]
    if names:
        parts.append(f"\nAttachments: {', '.join(names)}")
    return {"kind": "email", "title": said("Subject") or "Untitled Email", "author": said("From"), "date": date, "text": "\n".join(parts), "tags": ["has-attachments"] if names else None}


def canvas(path: str, text: str) -> dict:
    found = parsers.parse_canvas(text)
    return {"kind": "canvas", "title": re.sub(r"\.canvas$", "", base_name(path)), "text": found["text"], "links": [(f, None) for f in found["links"]] or None}


def code(path: str, text: str) -> dict:
    language = LANGUAGES[path.rsplit(".", 1)[-1].lower()]
    found = re.finditer(DEFINITIONS[language], text, re.MULTILINE | re.ASCII)
    structure = [("heading", 1 if any(w in m[0] for w in STRUCTURES) else 2, language, m.start(), m.end()) for m in found]
    return {"kind": "code", "title": base_name(path), "text": text, "tags": [language], "structure": structure}


#: The parser of each extension.
PARSERS: dict[str, Callable[[str, str], dict]] = (
    dict.fromkeys(("md", "markdown", "mdx"), markdown) | dict.fromkeys(("html", "htm"), html) | dict.fromkeys(("csv", "tsv"), table) | dict.fromkeys(("json", "jsonl"), records)
    | {"eml": mail, "canvas": canvas} | dict.fromkeys(("txt", "log", "cfg", "ini", "yaml", "yml", "toml", "xml"), plain_text) | dict.fromkeys(LANGUAGES, code)
)


def parse(path: str | None, text: str | None) -> dict:
    path = path or ""
    extension = base_name(path).rsplit(".", 1)[-1].lower() if "." in base_name(path) else ""
    if extension not in PARSERS:
        return {"path": path, "problem": f"no parser for .{extension}"}
    if text is None:
        return {"path": path, "problem": "no text"}
    return {"path": path} | PARSERS[extension](path, text)


def parsed(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents (SCHEMA) of files (path, text), with the columns ``keep`` of the files as they are."""
    kinds = dict(files.dtypes)
    schema = ", ".join([SCHEMA, *(f"{c} {kinds[c]}" for c in keep)])
    arrow = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [parse(p, t) for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                for r in rows:
                    r["links"] = [{"target": a, "display": b} for a, b in r["links"]] if r.get("links") else None
                    r["structure"] = [dict(zip(("type", "level", "language", "start", "end"), x, strict=True)) for x in r.get("structure") or []]
                made = [pa.array([r.get(c) for r in rows], t) for c, t in zip(COLUMNS, arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*made, *part.columns[2:]], names=[*COLUMNS, *keep])

    return files.select("path", "text", *keep).mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files under a path, in UTF-8; files whose first bytes do not fit their extension have no text."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = parsers.magic_matches(F.col("path"), F.col("content"))
    return found.select("path", F.when(fits, F.decode("content", "utf-8")).alias("text"))


def session_messages(files: DataFrame) -> DataFrame:
    """path, place, role, content of session files (path, text): a JSON array of messages, or a line for each record."""
    array = F.startswith(F.trim(F.regexp_replace("text", r"^\s+", "")), F.lit("["))
    whole = F.from_json("text", "array<string>")
    lines = F.when(array, F.coalesce(whole, F.array().cast("array<string>"))).otherwise(F.split("text", r"\r?\n"))
    each = files.filter("text IS NOT NULL").select("path", F.posexplode(lines).alias("place", "value")).filter(F.trim("value") != "")
    said = F.from_json("value", "role string, content string, command string, output string, message string")
    read_ = each.select("path", "place", said.alias("r")).withColumn("m", F.when(F.col("r.message").isNotNull(), F.from_json("r.message", "role string, content string")))
    role, content = F.coalesce("m.role", "r.role"), F.when(F.col("m.role").isNotNull(), F.col("m.content")).otherwise(F.coalesce("r.content", F.concat_ws("\n", "r.command", "r.output")))
    return read_.filter(role.isNotNull()).select("path", "place", role.alias("role"), content.alias("content"))

"""Chunking by the kind of a document: prose, headings, definitions, rows of a table; then merging and overlap."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, pairwise, zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions.batches import arrow_schema, flat_map, slices

#: Words after whose full stop a sentence goes on.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof sr jr st ave blvd vs etc inc ltd corp dept univ approx fig eq vol no pp ed rev gen gov sgt cpl pvt capt lt col cmdr adm i.e e.g cf al".split()
)
#: Tokens of a chunk (target, most, least), and of the lines that it repeats.
TARGET, MOST, LEAST, OVERLAP = 512, 1024, 100, 102


class Chunk(NamedTuple):
    """A text, the headings that it stands under, and its tokens: the sum over the parts that it was filled with."""

    text: str
    prefix: str
    tokens: int


def tokens_of(text: str) -> int:
    return math.ceil(len(text) / 3.8)


def goes_on(before: str, after: str) -> bool:
    """Whether a full stop between the two does not end a sentence."""
    word = re.sub("[^A-Za-z0-9_.]", "", before.rpartition(" ")[2])
    if {word.lower(), word.lower().replace(".", "")} & ABBREVIATIONS or re.fullmatch(r"[A-Za-z](\.[A-Za-z])+", word):
        return True
    if before[-1:].isdigit() and after[:1].isdigit():
        return True
    return len(word) == 1 and re.search("[A-Z]$", before) is not None


def sentences(text: str) -> list[str]:
    """Ends at . ! ? before white space, but not after abbreviations, acronyms and initials, nor between numbers."""
    text = " ".join(text.split())
    out, start = [], 0
    for m in re.finditer(r"[.!?]+(?= |$)", text):
        if m[0][0] == "." and goes_on(text[start : m.end() - 1], text[m.end() + 1 :][:1]):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def runs(items: Iterable[str], most: int, cost: Callable[[str], int]) -> Iterator[tuple[list[str], int]]:
    """Runs of items whose summed cost stays within ``most``, with that sum; an item above it is a run of its own."""
    held, total = [], 0
    for item in items:
        n = cost(item)
        if held and total + n > most:
            yield held, total
            held, total = [], 0
        held.append(item)
        total += n
    if held:
        yield held, total


def filled(parts: Iterable[str], joint: str, most: int, prefix: str = "", slices: bool = False) -> Iterator[Chunk]:
    """Parts in order, joined while their tokens stay within ``most``; with ``slices``, leading parts that alone are above it are cut."""
    leading = slices
    for held, total in runs(parts, most, tokens_of):
        leading = leading and total > most
        if leading:
            cuts = [held[0][i : i + 4 * most] for i in range(0, len(held[0]), 4 * most)]
            yield from (Chunk(c, prefix, tokens_of(c)) for c in cuts)
        else:
            yield Chunk(joint.join(held), prefix, total)


def paragraphs(text: str) -> list[str]:
    return re.split(r"\n\s*\n", text)


def by_prose(text: str, target: int, most: int) -> Iterator[Chunk]:
    """Paragraphs up to ``target`` tokens; one above ``most`` stands alone, as sentences up to ``most``."""
    for large, run in groupby(filter(None, map(str.strip, paragraphs(text))), key=lambda p: tokens_of(p) > most):
        if large:
            for paragraph in run:
                yield from filled(sentences(paragraph), " ", most, slices=True)
        else:
            yield from filled(run, "\n\n", target)


def by_headings(text: str, headings: list[tuple[int, int, int]], most: int) -> Iterator[Chunk]:
    """A chunk for each heading's section under its chain of headings; larger ones by paragraphs. Headings are (start, end, level)."""
    chain: list[tuple[int, str]] = []
    starts = [(0, 0, 0), *sorted(headings)]
    for (start, end, level), following in zip_longest(starts, starts[1:]):
        section = text[start : following[0] if following else len(text)].strip()
        if end:
            chain = [h for h in chain if h[0] < level] + [(level, re.sub(r"^#+\s+", "", text[start:end]))]
        elif not section:
            continue
        prefix = " > ".join(name for _, name in chain)
        yield from [Chunk(section, prefix, tokens_of(section))] if tokens_of(section) <= most else filled(paragraphs(section), "\n\n", most, prefix)


def by_definitions(text: str, definitions: list[tuple[int, int, int]], most: int) -> Iterator[Chunk]:
    """A chunk for each definition under its first line, after what stands before the first if that is above 20 tokens."""
    starts = sorted(definitions)
    if not starts:
        yield from filled(text.split("\n"), "\n", most, slices=True)
        return
    setup = text[: starts[0][0]].strip()
    if tokens_of(setup) > 20:
        yield Chunk(setup, "imports / module setup", tokens_of(setup))
    for (start, end, _), following in zip_longest(starts, starts[1:]):
        body, name = text[start : following[0] if following else len(text)].strip(), text[start:end].strip()
        if body:
            yield from [Chunk(body, name, tokens_of(body))] if tokens_of(body) <= most else filled(paragraphs(body), "\n\n", most, name)


def is_rule(line: str) -> bool:
    return re.fullmatch(r"[\s|:-]+", line) is not None and "-" in line


def by_rows(text: str, most: int, size: int = 20) -> Iterator[Chunk]:
    """Rows of a table in groups of ``size`` under its header (and the rule of a Markdown table); groups above ``most`` in runs of rows."""
    lines = text.split("\n")
    if len(lines) < 3:
        text = "\n".join(line for line in lines if not is_rule(line))
        yield Chunk(text, "", tokens_of(text))
        return
    top = 2 if is_rule(lines[1]) else 1
    head, rows = "\n".join(lines[:top]), lines[top:]
    for at in range(0, len(rows), size):
        group, first = rows[at : at + size], at + 1
        fits = tokens_of("\n".join([head, *group])) <= most
        for run in [group] if fits else [r for r, _ in runs(group, most - tokens_of(head), lambda row: tokens_of("\n" + row))]:
            body = "\n".join([head, *run])
            yield Chunk(body, f"rows {first}-{first + len(run) - 1}", tokens_of(body))
            first += len(run)


def merged(chunks: Iterable[Chunk], least: int) -> list[Chunk]:
    """Chunks below ``least`` tokens join the one before, and so do their prefixes. A run of them is joined once, whatever its length."""
    joined: list[list[Chunk]] = []
    for chunk in chunks:
        if joined and chunk.tokens < least:
            joined[-1].append(chunk)
        else:
            joined.append([chunk])
    out = []
    for run in joined:
        text = run[0].text if len(run) == 1 else "\n\n".join(c.text for c in run)
        out.append(run[0] if len(run) == 1 else Chunk(text, " | ".join(c.prefix for c in run if c.prefix), tokens_of(text)))
    return out


def overlapped(chunks: list[Chunk], most: int) -> list[Chunk]:
    """Each chunk after the last lines of the one before it."""
    out = chunks[:1]
    for before, chunk in pairwise(chunks):
        lines = before.text.split("\n")
        text = "\n".join([*lines[-max(1, min(most, len(lines) * 3 // 10)) :], chunk.text])
        out.append(chunk._replace(text=text, tokens=tokens_of(text)))
    return out


def chunked(text: str | None, kind: str = "text", headings: list | None = None, target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[Chunk]:
    """Chunks of one document by its kind; kinds with headings go by them, tables by rows, all else as prose."""
    if not (text or "").strip():
        return []
    marks = [tuple(h) for h in headings or []]
    if kind == "csv":
        found = by_rows(text, most)
    elif kind == "code" and marks:
        found = by_definitions(text, marks, most)
    elif kind in ("markdown", "html", "docx", "pptx") and marks:
        found = by_headings(text, marks, most)
    else:
        found = by_prose(text, target, most)
    return overlapped(merged(found, least), target * 2 // 10)


def prose(text: str | None, target: int = TARGET, most: int = MOST) -> list[str]:
    return [c.text for c in by_prose(text or "", target, most)]


def chunk_texts(docs: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """doc_id, position, text, tokens of every chunk of prose. The fill starts anew at its budget, which no window expresses."""

    def make(k: int, text: str | None) -> Iterator[tuple]:
        return ((k, i, c.text, c.tokens) for i, c in enumerate(by_prose(text or "", target, most)))

    return flat_map(docs.select("doc_id", "text"), make, "doc_id long, position int, text string, tokens long")


def chunk_documents(docs: DataFrame, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """doc_id, position, prefix, text, tokens of the chunks of (doc_id, kind, text, headings), merged and overlapped.

    ``headings`` are structs of (start, end, level); null ones are found in the text of Markdown and code.
    """
    from textlode.sources.parsers import marks_of

    def make(k: str, kind: str, text: str | None, marks: list | None) -> Iterator[tuple]:
        marks = marks_of(kind, text or "") if marks is None else [(h["start"], h["end"], h["level"]) for h in marks]
        return ((k, i, c.prefix, c.text, c.tokens) for i, c in enumerate(chunked(text, kind, marks, target, most, least)))

    chosen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "kind", "text", "headings")
    return flat_map(chosen, make, "doc_id string, position int, prefix string, text string, tokens long")


def chunk_lists(docs: DataFrame, keep: list[str], target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """chunks (an array of position, prefix, text, tokens) of each of (kind, text, headings), with the columns ``keep`` as they are: a row stays a row, so that nothing has to meet again."""
    from textlode.sources.parsers import marks_of

    kinds = dict(docs.dtypes)
    schema = ", ".join(["chunks array<struct<position:int,prefix:string,text:string,tokens:bigint>>", *(f"{c} {kinds[c]}" for c in keep)])
    kind_of = arrow_schema(schema).types[0]

    def make(kind: str, text: str | None, marks: list | None) -> list[dict]:
        marks = marks_of(kind, text or "") if marks is None else [(h["start"], h["end"], h["level"]) for h in marks]
        return [{"position": i, "prefix": c.prefix, "text": c.text, "tokens": c.tokens} for i, c in enumerate(chunked(text, kind, marks, target, most, least))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [make(*values) for values in zip(*(c.to_pylist() for c in part.columns[:3]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, kind_of), *part.columns[3:]], names=["chunks", *keep])

    return docs.select("kind", "text", "headings", *(F.col(c).alias(f"{c}_kept") for c in keep)).mapInArrow(run, schema)


def with_overlap(df: DataFrame, by: list[str], order: str, text: str, share: float = 0.3, most: int = 102) -> DataFrame:
    """Adds ``overlapped``: the last lines of the chunk before, then the chunk."""
    before = F.lag(text).over(Window.partitionBy(*by).orderBy(order))
    lines = F.split(before, "\n")
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.size(lines) * F.lit(share)).cast("int")))
    tail = F.array_join(F.slice(lines, F.size(lines) - n + 1, n), "\n")
    return df.withColumn("overlapped", F.when(before.isNull(), F.col(text)).otherwise(F.concat(tail, F.lit("\n"), F.col(text))))


def table_groups(rows: DataFrame, header: str, size: int) -> DataFrame:
    """chunk, prefix, text: ``size`` numbered rows (row, line) each, with the header on top."""
    g = rows.withColumn("chunk", F.floor(F.col("row") / size).cast("long")).groupBy("chunk")
    found = g.agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("rows"))
    lines = F.transform("rows", lambda r: r["line"])
    first = F.col("chunk") * size
    prefix = F.concat(F.lit("rows "), (first + 1).cast("string"), F.lit("-"), (first + F.size("rows")).cast("string"))
    return found.select("chunk", prefix.alias("prefix"), F.concat_ws("\n", F.lit(header), F.array_join(lines, "\n")).alias("text"))

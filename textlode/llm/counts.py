"""Token counts: a map-side lookup in two tiers.

A count needs no ids, only the number of tokens of each pre-token. First tier: a
compact hash table of the corpus's frequent pre-tokens and their lengths, at most
``TABLE`` entries of at most ``LONGEST`` characters, which is broadcast. Second
tier: pre-tokens that it misses are encoded by the library, and each worker keeps
the lengths of the last ones. Texts never leave their task, and no pre-token is
shuffled.

The frequent pre-tokens come from the whole corpus: each task counts its own in a
Misra-Gries summary of bounded size, and summaries are merged in two steps (a few
to a task, then one). The table only saves work: a count is the library's with
any table, or none.

The vocabulary file (JSON) is read once on the driver, from a path that the caller
gives. Files whose pre-tokenizer is not the one below are counted by the library
text by text, as are texts with code points that Python's tables do not know.

Null text counts as empty: no bytes, no tokens. A long text is split at spaces,
``PIECE`` characters or one word at a time. Repeated rows give repeated results,
and a table without rows none. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm import bpe
from textlode.llm.common import map_rows

TABLE = 16_384
LONGEST = 64
CACHED = 500_000
PIECE = 1 << 20
#: Fixed value: the pattern of the pre-tokenizer that is split here; others are left to the library.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def unknown_points() -> str:
    """A character class of the code points that Python's tables leave unassigned."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        out = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if out and start is None:
            start = c
        elif not out and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "[" + "".join(ranges) + "]"


def read_file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        file = f.read()
    stored = json.loads(file)
    steps = (stored["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    splits = steps[0].get("pattern", {}).get("Regex") == SPLIT and bool(stored["model"].get("end_of_word_suffix"))
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    return {"file": file, "splits": splits, "special": special, "unknown": unknown_points()}


class Splitter(bpe.Codec):
    """Pre-tokens of a text, and the library's own count where they are not known."""

    def __init__(self, stored: dict):
        from tokenizers import Tokenizer

        self.library, self.splits, self.special = Tokenizer.from_str(stored["file"]), stored["splits"], stored["special"]
        self.library.no_truncation()
        self.library.no_padding()
        self.unknown, self.beyond_latin = re.compile(stored["unknown"]), re.compile("[^\0-ɏ]")
        self.ascii_pieces, self.latin_pieces = re.compile(bpe.ASCII_PIECES), re.compile(bpe.LATIN_PIECES)
        kinds = {"{L}": "\\p{L}", "{N}": "\\p{N}", "{NOT_SPACE}": bpe.SPACE.replace("[", "[^", 1)}
        pattern = bpe.PIECES.replace("(?!{L}|{N})", "(?![\\p{L}\\p{N}])")
        for name, kind in kinds.items():
            pattern = pattern.replace(name, kind)
        self.pieces = regex.compile("(?V1)" + pattern)
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes = dict(enumerate(bpe.byte_symbols()))

    def known(self, text: str) -> bool:
        return self.splits and (text.isascii() or not self.beyond_latin.search(text) or not self.unknown.search(text))

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def length(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes)))

    def pieces_of(self, text: str) -> Iterator[list[str]]:
        """Lists of the pre-tokens of a known text; special tokens are pieces of their own lists, as ``None``."""
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):  # up to a space: no pre-token or special token holds one
                cut = text.rfind(" ", at + 1, end)
                end = cut if cut > 0 else text.find(" ", end)
                end = end if end > 0 else len(text)
            piece = text[at:end]
            for k, part in enumerate(self.apart.split(piece) if self.apart else [piece]):
                if k % 2:
                    yield [None]
                elif part:
                    plain = self.normal(part)
                    yield self.pattern_for(plain).findall(plain)
            at = end


class Lengths(dict):
    """The broadcast table; what it misses comes from the worker's cache, else from the library."""

    def __init__(self, table: dict[str, int], splitter: Splitter):
        super().__init__(table)
        self[None] = 1
        self.splitter, self.rest = splitter, {}

    def __missing__(self, piece: str) -> int:
        n = self.rest.get(piece)
        if n is None:
            n = self.splitter.length(piece)
            if len(piece) <= LONGEST:
                if len(self.rest) >= CACHED:
                    self.rest.clear()
                self.rest[piece] = n
        return n

    def count(self, text: str) -> int:
        if not self.splitter.known(text):
            return self.splitter.whole(text)
        return sum(sum(map(self.__getitem__, pieces)) for pieces in self.splitter.pieces_of(text))


def pruned(counts: Counter, most: int) -> Counter:
    """The Misra-Gries reduction to at most ``most`` entries: all lose the count of the first one that must go."""
    if len(counts) <= most:
        return counts
    floor = nlargest(most + 1, counts.values())[-1]
    return Counter({w: n - floor for w, n in counts.items() if n > floor})


SUMMARY = "part int, piece array<string>, n array<long>"


def _summary(part: int, counts: Counter) -> pa.RecordBatch:
    columns = [pa.array([part], "int32"), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "piece", "n"])


def _splitter(shared: Broadcast) -> Splitter:
    stored = shared.value
    if "splitter" not in stored:
        stored["splitter"] = Splitter(stored)
    return stored["splitter"]


def frequent_lengths(df: DataFrame, shared: Broadcast, text: str, most: int) -> dict[str, int]:
    """Tokens of each of at most ``most`` pre-tokens, the most frequent ones by the merged summaries."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        splitter, counts = _splitter(shared), Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if not t or not splitter.known(t):
                    continue
                for pieces in splitter.pieces_of(t):
                    counts.update(pieces)
                if len(counts) > 2 * most:
                    counts = pruned(counts, most)
        counts = Counter({w: n for w, n in counts.items() if w is not None and len(w) <= LONGEST})
        if counts:
            yield _summary(TaskContext.get().partitionId(), pruned(counts, most))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = 0, Counter()
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                counts.update(dict(zip(row["piece"], row["n"], strict=True)))
                counts = pruned(counts, most)
        if counts:
            yield _summary(part, counts)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = _splitter(shared).length
        for batch in merged(batches):
            pieces = batch.column(1)[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(pieces), pa.array(list(map(length, pieces)), "int32")], names=["piece", "tokens"])

    summaries = df.select(text).mapInArrow(counted, SUMMARY)
    summaries = summaries.repartition(F.col("part")).mapInArrow(merged, SUMMARY).repartition(1)
    return {r.piece: r.tokens for r in summaries.mapInArrow(measured, "piece string, tokens int").collect()}


def token_counts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", table: int = TABLE) -> DataFrame:
    """key, ``n_bytes`` and ``n_tokens`` of every whole text; ``table`` bounds the broadcast table."""
    context, stored = df.sparkSession.sparkContext, read_file(path)
    shared = context.broadcast(stored)
    lengths = context.broadcast(frequent_lengths(df, shared, text, table) if stored["splits"] and table else {})

    def make():
        worker = shared.value
        if "lengths" not in worker:
            worker["lengths"] = Lengths(lengths.value, _splitter(shared))
        count = worker["lengths"].count
        return lambda k, t: (k, len(t.encode()), count(t)) if t else (k, 0, 0)

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(F.col(key), F.col(text)), make, f"`{key}` {kind}, n_bytes long, n_tokens long")

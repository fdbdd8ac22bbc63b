"""BPE encoding and decoding.

Each word is a doubly linked list of symbols; a priority queue holds the
possible merges by rank and place, and entries whose symbols have changed since
are skipped. Decoding concatenates vocabulary strings.

The vocabulary file (JSON with ``model.vocab``, ``model.merges`` and an
end-of-word suffix) is read once on the driver from a path that the caller
gives, and broadcast: its size is fixed by the file, not by the data.

Null text counts as empty, and has no tokens. Words are bounded only by the
text itself; a run of n letters costs n log n steps. Repeated rows give
repeated results, and a table without rows none. Columns other than the key and
the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import map_rows

#: The pre-tokenizer's pattern and white space of the vocabulary file.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|(?:(?!{L}|{N}){NOT_SPACE})+"
#: Letters and numbers of Unicode 16, which the pattern's engine knows and Python's tables may not.
NEWER = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-113b7 113d1-113d3 11bc0-11be0 "
    "11bf0-11bf9 116d0-116e3 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff-18cff 1ccf0-1ccf9 1e5d0-1e5fa"
)
#: The same for text of ASCII only, after lower-casing.
ASCII_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+"
#: The same for Latin text up to U+024F.
LATIN_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\\t-\\r \\x85\\xa0a-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+"
CACHED_WORDS = 500_000


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def pieces_pattern() -> str:
    """The pattern, with letters and numbers as of Unicode 16.

    The regex module may know newer ones; characters that Python's tables leave
    unassigned and that are not in NEWER count as neither.
    """
    known = {c for a, b in (r.split("-") for r in NEWER.split()) for c in range(int(a, 16), int(b, 16) + 1)}
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer = sorted({ord(c) for c in regex.findall("[\\p{L}\\p{N}]", everything) if unicodedata.category(c) == "Cn"} - known)
    ranges: list[list[int]] = []
    for c in newer:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    drop = "--[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else ""
    kinds = {"{L}": f"[\\p{{L}}{drop}]", "{N}": f"[\\p{{N}}{drop}]", "{NOT_SPACE}": SPACE.replace("[", "[^", 1)}
    pattern = PIECES
    for name, kind in kinds.items():
        pattern = pattern.replace(name, kind)
    return "(?V1)" + pattern


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    model = stored["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    return {"vocab": vocab, "merges": pairs, "special": special, "suffix": model.get("end_of_word_suffix") or "", "pieces": pieces_pattern()}


class Codec:
    """Encoder and decoder over one vocabulary, with a bounded cache of words."""

    def __init__(self, stored: dict):
        self.vocab, self.suffix, self.special = stored["vocab"], stored["suffix"], stored["special"]
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[int, int] = {}
        self.made = [self.vocab[a + b] for a, b in stored["merges"]]
        for rank, (a, b) in enumerate(stored["merges"]):
            self.ranks.setdefault(self.vocab[a] << 20 | self.vocab[b], rank)
        symbols = byte_symbols()
        self.first = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.pieces, self.beyond_latin = regex.compile(stored["pieces"]), re.compile("[^\0-ɏ]")
        self.ascii_pieces, self.latin_pieces = re.compile(ASCII_PIECES), re.compile(LATIN_PIECES)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[bytes, int, str]] = {}

    def merge(self, data: bytes) -> list[int]:
        first = self.first
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        rank_of, made, queue = self.ranks.get, self.made, []
        for i in range(n - 1):
            rank = rank_of(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = right[i]
            if ids[i] < 0 or j < 0 or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = whole, _ = made[rank], -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                rank = rank_of(whole << 20 | ids[after])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            before = left[i]
            if before >= 0:
                rank = rank_of(ids[before] << 20 | whole)
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | before)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[bytes, int, str]:
        """Ids as bytes, their number, and the strings that decoding puts out."""
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        ids = self.merge(word.encode())
        found = np.array(ids, "<u4").tobytes(), len(ids), self.decode(ids)
        self.cache[word] = found
        return found

    def normal(self, text: str) -> str:
        """Composed and lower case; white space stays, as no piece has any."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form by context
        return text.lower()

    def pattern_for(self, plain: str):
        if plain.isascii():
            return self.ascii_pieces
        return self.pieces if self.beyond_latin.search(plain) else self.latin_pieces

    def parts(self, text: str):
        """Words and special tokens of a text, encoded, in order."""
        cache = self.cache
        for k, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if k % 2:
                i = self.special[part]
                yield np.array([i], "<u4").tobytes(), 1, part
            elif part:
                plain = self.normal(part)
                for w in self.pattern_for(plain).findall(plain):
                    yield cache.get(w) or self.word(w)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(p[0] for p in self.parts(text or "")), "<u4")

    def decode(self, ids) -> str:
        """The vocabulary's strings, in order, with the separator of a file without a decoder."""
        return " ".join([self.strings[int(i)] for i in ids if int(i) in self.strings])


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def _codec(shared) -> Codec:
    """One codec per Python worker: the broadcast value outlives a task, and so does its cache."""
    stored = shared.value
    if "codec" not in stored:
        stored["codec"] = Codec(stored)
    return stored["codec"]


def encode_column(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ``ids`` (array<int>) of every whole text."""
    shared = _shared(df, path)

    def make():
        codec = _codec(shared)
        return lambda k, t: (k, codec.encode(t).astype("int32").tolist())

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(F.col(key), F.col(text)), make, f"`{key}` {kind}, ids array<int>")


def decode_column(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and ``decoded`` of every id list; null lists decode to the empty text."""
    shared = _shared(df, path)

    def make():
        codec = _codec(shared)
        return lambda k, i: (k, codec.decode(i or []))

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(F.col(key), F.col(ids)), make, f"`{key}` {kind}, decoded string")


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token count and digests of ids and decoded text of every whole text, in one pass."""
    shared = _shared(df, path)

    def make():
        codec = _codec(shared)

        def one(k, t):
            found = list(codec.parts(t or ""))
            ids, decoded = b"".join([p[0] for p in found]), " ".join([p[2] for p in found])
            return k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return one

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(df.select(F.col(key), F.col(text)), make, schema)

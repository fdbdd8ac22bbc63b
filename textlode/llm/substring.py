"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words. Each window has a minimiser: the least
hash of its runs of ``run`` words. Consecutive windows with one minimiser form a
super-k-mer, which can travel as one packed string instead of a string for each
window. Three steps:

1. Every text yields the minimisers of its super-k-mers and a 128-bit digest of
   each. Counts by (minimiser, digest) are summed map-side. A window that occurs
   twice has its minimiser in two super-k-mers, or twice in one, so minimisers
   seen once drop out before any text moves.
2. The texts that hold the others cut those super-k-mers. Each goes, packed, to
   the bucket of its minimiser; equal strings are one row with a count. In a
   bucket the windows are sorted and counted exactly, by their words. Where a
   minimiser has more than ``hot`` different strings, its windows travel singly,
   each to the bucket of its own digest, so no bucket grows with a hot passage.
3. Verdicts return to the places of their strings, and texts drop the words that
   a repeated window covers.

Windows are compared as words, whole. Strings are equal if their 128-bit digests
are. Null text has no words. Texts of fewer words than a window lose nothing.
Repeated rows are places of their own, so each loses what they share; rows that
share an id are told apart by a digest of their text. A table without rows gives
none. Columns other than doc_id and text are not read. Memory is that of one text,
or of one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import map_rows, stored

WIDTH = 35
RUN = 12
HOT = 2000
MIX = np.uint64(0x9E3779B97F4A7C15)


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


class Cutter:
    """Super-k-mers of texts, with a bounded cache of word hashes."""

    def __init__(self, width: int, run: int):
        self.width, self.run, self.cache = width, run, {}

    def hash(self, word: bytes) -> int:
        if len(self.cache) > 500_000:
            self.cache.clear()
        found = self.cache[word] = xxhash.xxh3_64_intdigest(word, 7)
        return found

    def least(self, runs: np.ndarray) -> np.ndarray:
        """The least run of each window, by doubling the stretch that a minimum covers."""
        size, have, low = self.width - self.run + 1, 1, runs
        while 2 * have <= size:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        return low if have == size else np.minimum(low[: have - size], low[size - have :])

    def cut(self, words: list[bytes], repeats: bool = False) -> list[tuple[int, int, int, bool]]:
        """(minimiser, first window, number of windows, does the minimiser stand twice?), in order; the last only with ``repeats``."""
        n = len(words) - self.width + 1
        if n < 1:
            return []
        cache = self.cache
        h = np.array([cache.get(w) or self.hash(w) for w in words], "u8")
        runs = np.zeros(len(words) - self.run + 1, "u8")
        for k in range(self.run):
            runs = runs * MIX + h[k : k + len(runs)]
        runs ^= runs >> np.uint64(29)
        runs *= MIX
        low = self.least(runs)
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        ends = np.append(starts[1:], n)
        twice = np.zeros(len(starts), bool)
        if repeats:
            spans = ends - starts + self.width - self.run  # runs of each super-k-mer
            firsts = np.cumsum(spans) - spans
            inside = np.arange(spans.sum()) + np.repeat(starts - firsts, spans)
            twice = np.add.reduceat((runs[inside] == np.repeat(low[starts], spans)).astype("i8"), firsts) > 1
        columns = low[starts].astype("i8"), starts, ends - starts, twice
        return list(zip(*(c.tolist() for c in columns), strict=True))

    def packed(self, words: list[bytes], start: int, windows: int) -> bytes:
        return b" ".join(words[start : start + windows + self.width - 1])


def version_of(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode()) >> 1


def split(text: str | None) -> list[bytes]:
    """bytes.split() parts at U+0020 and U+0009..U+000D only."""
    return (text or "").encode().split()


def kmers(docs: DataFrame, width: int, run: int, with_strings: bool) -> DataFrame:
    """Minimiser of every super-k-mer, with a digest of its string or else with the document's id."""

    def make():
        cutter = Cutter(width, run)

        def one(k, text):
            words = split(text)
            if not with_strings:
                return [(k, m) for m in {x[0] for x in cutter.cut(words)}]
            return [(xxhash.xxh3_64_intdigest(cutter.packed(words, s, n)) >> 1, m, 1 + two) for m, s, n, two in cutter.cut(words, True)]

        return one

    schema = "string long, minimiser long, times int" if with_strings else "doc_id long, minimiser long"
    return map_rows(docs.select("doc_id", "text"), make, schema, many=True)


def cut_again(texts: DataFrame, width: int, run: int) -> DataFrame:
    """The super-k-mers of (doc_id, text, cold, hot): a row for each whose minimiser is in one of the two lists."""

    def make():
        cutter = Cutter(width, run)

        def one(k, text, cold, hot):
            cold, hot, words, rows = set(cold or []), set(hot or []), split(text), []
            version = version_of(text)
            for m, s, n, _ in cutter.cut(words):
                if m in cold:
                    data = cutter.packed(words, s, n)
                    rows.append((k, version, s, m, digest(data), data))
                elif m in hot:
                    for i in range(s, s + n):
                        data = cutter.packed(words, i, 1)
                        sid = digest(data)
                        rows.append((k, version, i, int.from_bytes(sid[:8], "little", signed=True), sid, data))
            return rows

        return one

    return map_rows(texts, make, "doc_id long, version long, start int, bucket long, sid binary, packed binary", many=True)


def count_bucket(strings: list[tuple[bytes, bytes, int]], width: int) -> list[tuple[bytes, bytes]]:
    """(sid, flags): for each string, a byte for each window, 1 where it occurs twice or more in the bucket."""
    if len(strings) == 1 and strings[0][2] > 1:  # copies of one string only: each window is in all of them
        sid, data, _ = strings[0]
        return [(sid, b"\1" * (data.count(b" ") + 2 - width))]
    windows, numbers = [], []
    for k, (_, data, count) in enumerate(strings):
        ends = [i for i, c in enumerate(data) if c == 32] + [len(data)]
        starts = [0] + [e + 1 for e in ends]
        numbers.append(len(ends) - width + 1)
        windows += [(data[starts[i] : ends[i + width - 1]], k, i, count) for i in range(numbers[-1])]
    windows.sort()
    flags = [bytearray(n) for n in numbers]
    at = 0
    while at < len(windows):
        end, total = at, 0
        while end < len(windows) and windows[end][0] == windows[at][0]:
            total += windows[end][3]
            end += 1
        if total > 1:
            for _, k, i, _ in windows[at:end]:
                flags[k][i] = 1
        at = end
    return [(s[0], bytes(f)) for s, f in zip(strings, flags, strict=True) if any(f)]


def verdicts(unique: DataFrame, width: int) -> DataFrame:
    """(bucket, sid, flags) of (bucket, sid, packed, n), dealt by bucket and sorted in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, strings = None, []

        def done():
            found = count_bucket(strings, width)
            if found:
                b = pa.array([bucket] * len(found), pa.int64())
                columns = [b, pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "sid", "flags"])

        for batch in batches:
            for b, sid, data, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    yield from done()
                    bucket, strings = b, []
                strings.append((sid, data, n))
        yield from done()

    dealt = unique.select("bucket", "sid", "packed", "n").repartition("bucket").sortWithinPartitions("bucket", "sid")
    return dealt.mapInArrow(run, "bucket long, sid binary, flags binary")


def repeated_windows(docs: DataFrame, width: int = WIDTH, run: int = RUN, hot: int = HOT) -> DataFrame:
    """of_doc and ``spans``: the windows of a text that occur elsewhere, as an array of (version, start, flags)."""
    by_string = kmers(docs, width, run, True).groupBy("minimiser", "string").agg(F.sum("times").alias("n"))
    by_minimiser = by_string.groupBy("minimiser").agg(F.sum("n").alias("n"), F.count("*").alias("strings"))
    often = by_minimiser.filter("n > 1").select("minimiser", (F.col("strings") > hot).alias("hot"))
    found = kmers(docs, width, run, False).join(often, "minimiser")
    held = found.groupBy(F.col("doc_id").alias("of_doc")).agg(
        F.collect_set(F.when(~F.col("hot"), F.col("minimiser"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("minimiser"))).alias("hot")
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc"))
    texts = docs.select("doc_id", "text").join(held.hint("shuffle_hash"), same).select("doc_id", "text", "cold", "hot")
    places = stored(cut_again(texts, width, run))
    unique = places.groupBy("bucket", "sid").agg(F.min("packed").alias("packed"), F.count("*").alias("n"))
    back = places.select("doc_id", "version", "start", "bucket", "sid").join(verdicts(unique, width), ["bucket", "sid"])
    return back.groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list(F.struct("version", "start", "flags")).alias("spans"))


def covered(n: int, spans: list, width: int) -> np.ndarray:
    """Is a word covered by a window that a span flags?"""
    change = np.zeros(n + 1, "i8")
    for s in spans:
        starts = s["start"] + np.flatnonzero(np.frombuffer(s["flags"], "u1"))
        np.add.at(change, starts, 1)
        np.add.at(change, starts + width, -1)
    return np.cumsum(change)[:n] > 0


def kept_words(text: str | None, spans: list | None, width: int) -> tuple[int, list[bytes]]:
    words = split(text)
    if spans:
        version = version_of(text)
        gone = covered(len(words), [s for s in spans if s["version"] == version], width)
        return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), words


def _with_spans(docs: DataFrame, width: int, run: int, hot: int) -> DataFrame:
    spans = repeated_windows(docs, width, run, hot)
    return docs.select("doc_id", "text").join(spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").drop("of_doc")


def dedup(docs: DataFrame, width: int = WIDTH, run: int = RUN, hot: int = HOT) -> DataFrame:
    """doc_id and ``text`` of what is kept: words joined by one space."""

    def make():
        return lambda k, text, spans: (k, b" ".join(kept_words(text, spans, width)[1]).decode())

    return map_rows(_with_spans(docs, width, run, hot), make, "doc_id long, text string")


def digests(docs: DataFrame, width: int = WIDTH, run: int = RUN, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and a digest of the kept words of every text."""

    def make():
        def one(k, text, spans):
            n, words = kept_words(text, spans, width)
            return k, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()

        return one

    return map_rows(_with_spans(docs, width, run, hot), make, "doc_id long, n_words long, n_removed long, kept_sha256 string")

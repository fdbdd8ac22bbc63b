"""LM scoring by subword lattice likelihood.

An existing subword vocabulary weighs the segmentations of each word: a word's
probability is the sum over all segmentations of the product of their pieces'
probabilities, found by a forward recursion in log space over the lattice of
pieces. A text is a row of words, each drawn from that model, and an end. The
vocabulary file stores merge ranks as scores; they give a weight
1 / (rank + ``FLAT``) to each piece. ``rounds`` passes of expectation
maximisation over the counts of the training words fit the weights to the
corpus, with the vocabulary's own weights beside the expected counts, as
pseudo-counts of a share ``PSEUDO`` of the training words; each pass sums expected
piece counts, one number for each piece of the vocabulary, whatever the data.

Beside it stands the base score of add-one word counts. All words are counted,
map-side first, those of training rows apart, and one pass over the table of
words gives each its probability, so that no word is computed twice. Of at most
``common`` words, those above the least count that leaves no more (found from a
histogram of counts, some hundred rows), count and probability are broadcast; each
text sends its other words, which are few, to be joined with the full table. So
the vocabulary of the corpus may grow without bound, and a hot word moves no rows.

Null and blank texts have no words and score the end alone. Characters outside
the vocabulary are spelled in its byte pieces. Words of n characters take
n * (longest piece) steps; short words of one length are computed together, long
ones keep one number for each character. Repeated rows get repeated scores.
Without training rows N and V are 0 and the base score of a token is log10(1). A
table without rows gives none. Columns other than doc_id, text and those that
``train`` names are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import ascii_lower, stored, words_of

SPACE_MARK = "▁"
COMMON = 100_000
ROUNDS = 2
FLAT = 100.0
PSEUDO = 0.1
#: Steps of the histogram of counts for each power of two.
STEPS = 8
SHORT = 64  # characters of words that are computed by the batch
BASE = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> tuple[dict[str, float], list[float]]:
    """Log weights of the pieces by string, and of the 256 bytes, from a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, spelled = {}, [0.0] * 256
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            spelled[int(model.id_to_piece(i)[3:5], 16)] = -math.log(4e5)
        else:
            pieces[model.id_to_piece(i)] = -math.log(FLAT - model.get_score(i))
    total = math.log(sum(map(math.exp, [*pieces.values(), *spelled])))
    return {p: w - total for p, w in pieces.items()}, [w - total for w in spelled]


class Lattice:
    """All segmentations of words."""

    def __init__(self, pieces: dict[str, float], spelled: list[float]):
        self.pieces, self.spelled = pieces, spelled
        self.longest = max(map(len, pieces), default=1)
        self.names, self.tables, self.powers = list(pieces), {}, {}
        for size in sorted(set(map(len, self.names))):
            numbers = [i for i, p in enumerate(self.names) if len(p) == size]
            hashes = np.zeros(len(numbers), "u8")
            codes = np.frombuffer("".join(self.names[i] for i in numbers).encode("utf-32-le"), "<u4").reshape(-1, size)
            power = np.ones(1, "u8")
            for k in range(size):
                hashes = hashes * BASE + codes[:, k] + np.uint64(1)
                power = power * BASE
            order = np.argsort(hashes)
            numbers = np.array(numbers)[order]
            self.tables[size] = hashes[order], np.array([pieces[self.names[i]] for i in numbers.tolist()]), numbers
            self.powers[size] = power[0]

    def edges(self, text: str, end: int) -> list[tuple[int, float, str | None]]:
        """(start, log weight, piece) of the edges to ``end``; a piece of None spells a character in bytes."""
        get, found = self.pieces.get, []
        for start in range(max(0, end - self.longest), end):
            piece = text[start:end]
            w = get(piece)
            if w is not None:
                found.append((start, w, piece))
        found.append((end - 1, sum(self.spelled[b] for b in text[end - 1].encode("utf-8", "replace")), None))
        return found

    def forward(self, text: str) -> array:
        """For each end, the logarithm of the summed weights of the segmentations up to it."""
        alpha = array("d", [0.0])
        for end in range(1, len(text) + 1):
            values = [alpha[s] + w for s, w, _ in self.edges(text, end)]
            top = max(values)
            alpha.append(top + math.log(sum([math.exp(v - top) for v in values])))
        return alpha

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``words``, code points as a matrix) of the words of each length, marked, a few thousand at once."""
        lengths = np.array([len(w) for w in words]) + 1
        for n in np.unique(lengths).tolist():
            for places in np.array_split(at := np.flatnonzero(lengths == n), -(-len(at) * n // 100_000)):
                joined = "".join([SPACE_MARK + words[i] for i in places.tolist()])
                yield places, np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(places), n).astype("u8")

    def batch_edges(self, codes: np.ndarray) -> tuple[list[list[tuple]], np.ndarray, np.ndarray]:
        """As ``edges`` for words of one length and every end: (start, weights, pieces' numbers or None)."""
        n = codes.shape[1]
        prefix = np.zeros((codes.shape[0], n + 1), "u8")
        for k in range(n):
            prefix[:, k + 1] = prefix[:, k] * BASE + codes[:, k] + np.uint64(1)
        chars, which = np.unique(codes, return_inverse=True)
        which = which.reshape(codes.shape)
        spelling = np.array([sum(self.spelled[b] for b in chr(c).encode("utf-8", "replace")) for c in chars.tolist()])
        out = []
        for end in range(1, n + 1):
            found = []
            for size, (hashes, weights, numbers) in self.tables.items():
                if size > end:
                    continue
                power = self.powers[size]
                h = prefix[:, end] - prefix[:, end - size] * power
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                if hit.any():
                    found.append((end - size, np.where(hit, weights[at], -np.inf), np.where(hit, numbers[at], -1)))
            found.append((end - 1, spelling[which[:, end - 1]], None))
            out.append(found)
        return out, chars, which

    @staticmethod
    def log_sum(values: list[np.ndarray]) -> np.ndarray:
        stack = np.stack(values)
        top = stack.max(axis=0)
        return top + np.log(np.exp(stack - top).sum(axis=0))

    def batch_forward(self, edges: list, rows: int) -> list[np.ndarray]:
        alpha = [np.zeros(rows)]
        for found in edges:
            alpha.append(self.log_sum([alpha[s] + w for s, w, _ in found]))
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithms of the words' marginal probabilities."""
        out = np.zeros(len(words))
        short = np.array([i for i, w in enumerate(words) if len(w) <= SHORT], "i8")
        for i in set(range(len(words))).difference(short.tolist()):
            out[i] = self.forward(SPACE_MARK + words[i])[-1]
        if len(short):
            for places, codes in self.by_length([words[i] for i in short.tolist()]):
                out[short[places]] = self.batch_forward(self.batch_edges(codes)[0], len(places))[-1]
        return out

    def batch_expected(self, words: list[str], counts: list[int], pieces: np.ndarray, spelled: Counter) -> None:
        """As ``expected`` for many words of up to SHORT characters; pieces are summed by number."""
        counts = np.array(counts, "f8")
        for places, codes in self.by_length(words):
            edges, chars, which = self.batch_edges(codes)
            n, rows, times = codes.shape[1], len(places), counts[places]
            alpha = self.batch_forward(edges, rows)
            beta = [np.full(rows, -np.inf) for _ in range(n)] + [np.zeros(rows)]
            by_char = np.zeros(len(chars))
            with np.errstate(invalid="ignore"):
                for end in range(n, 0, -1):
                    for start, w, numbers in edges[end - 1]:
                        value = w + beta[end]
                        share = np.exp(alpha[start] + value - alpha[n]) * times
                        if numbers is None:
                            by_char += np.bincount(which[:, end - 1], share, len(chars))
                        else:
                            hit = numbers >= 0
                            pieces += np.bincount(numbers[hit], share[hit], len(pieces))
                        beta[start] = np.logaddexp(beta[start], value)
            for c, share in zip(chars.tolist(), by_char.tolist(), strict=True):
                for b in chr(c).encode("utf-8", "replace"):
                    spelled[b] += share

    def expected(self, word: bytes, count: int, into: Counter) -> None:
        """Adds the word's expected piece counts, times its count; bytes count under their number."""
        text = SPACE_MARK + word.decode()
        alpha = self.forward(text)
        beta = array("d", [-math.inf]) * len(alpha)
        beta[-1] = 0.0
        for end in range(len(alpha) - 1, 0, -1):
            if beta[end] == -math.inf:
                continue
            for start, w, piece in self.edges(text, end):
                value = w + beta[end]
                share = count * math.exp(alpha[start] + value - alpha[-1])
                if share > 1e-9:
                    for name in [piece] if piece is not None else text[start:end].encode():
                        into[name] += share
                old = beta[start]
                top = max(old, value)
                beta[start] = value if old == -math.inf else top + math.log(math.exp(old - top) + math.exp(value - top))


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """word, n: lower-case words of all rows of (text), and how often rows that meet ``train`` have them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = words_of(F.translate(F.col("text"), upper, lower))
    each = docs.select(F.coalesce(train, F.lit(False)).alias("train"), F.explode(words).alias("word"))
    return each.groupBy("word").agg(F.count(F.when(F.col("train"), 1)).alias("n"))


def priced(counts: DataFrame, pieces: dict, spelled: list) -> DataFrame:
    """word, n, p: each word's log probability."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, spelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            p = pa.array(lattice.log_probabilities(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=["word", "n", "p"])

    return counts.select("word", "n").mapInArrow(run, "word string, n long, p double")


def reweighted(counts: DataFrame, pieces: dict, spelled: list, prior: tuple[dict, list], pseudo: float) -> tuple[dict, list]:
    """One round of expectation maximisation over word counts; ``prior``: the vocabulary's own weights, as ``pseudo`` counts in all."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, spelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = Lattice(*shared.value), Counter()
        by_number = np.zeros(len(lattice.names))
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            short = [r for r in rows if len(r[0]) <= SHORT]
            if short:
                lattice.batch_expected([r[0] for r in short], [r[1] for r in short], by_number, sums)
            for word, n in rows:
                if len(word) > SHORT:
                    lattice.expected(word.encode(), n, sums)
        for i in np.flatnonzero(by_number).tolist():
            sums[lattice.names[i]] += by_number[i]
        names = [f"{x:02x}" if isinstance(x, int) else "=" + x for x in sums]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(sums.values()), pa.float64())], names=["piece", "n"])

    sums = counts.select("word", "n").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    found = {r.piece: r.n for r in sums.collect()}  # a number for each piece of the vocabulary at most
    of_piece = {p: found.get("=" + p, 0.0) + pseudo * math.exp(w) for p, w in prior[0].items()}
    of_byte = [found.get(f"{b:02x}", 0.0) + pseudo * math.exp(w) for b, w in enumerate(prior[1])]
    total = math.log(math.fsum([*of_piece.values(), *of_byte]))
    return {p: math.log(n) - total for p, n in of_piece.items()}, [math.log(n) - total for n in of_byte]


def frequent_words(counts: DataFrame, common: int) -> dict[bytes, tuple[int, float]]:
    """Count and log probability of at most ``common`` words, all that training rows have often enough."""
    counts = counts.filter("n > 0")
    step = F.floor(F.log2("n") * STEPS).alias("step")
    sizes = {r.step: r.words for r in counts.groupBy(step).agg(F.count("*").alias("words")).collect()}  # STEPS rows a power of two
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > common:
            break
        least = k
    if least is None:
        return {}
    return {r.word.encode(): (r.n, r.p) for r in counts.filter(step >= least).collect()}


def first_pass(docs: DataFrame, shared, p_end: float, known_end: int) -> DataFrame:
    """What one text says alone: the sums of its common words and of the ends, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        go_on, stop = math.log1p(-p_end), math.log(p_end)
        names = ["doc_id", "version", "n_words", "known", "base", "score", "rare", "rare_tf"]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = (c.slice(at, 500).to_pylist() for c in batch.columns)
                raw = [(t or "").encode() for t in texts]
                rows, rare, rare_tf, offsets = [], [], [], [0]
                for k, r in zip(ids, raw, strict=True):
                    words = Counter(ascii_lower(r).split())
                    n_words, known, base, p = words.total(), known_end, [], []
                    for w, n in words.items():
                        found = frequent.get(w)
                        if found is None:
                            rare.append(w)
                            rare_tf.append(n)
                        else:
                            known += n
                            base.append(n * math.log10(found[0] + 1))
                            p.append(n * found[1])
                    offsets.append(len(rare))
                    rows.append((k, xxhash.xxh3_64_intdigest(r) >> 1, n_words, known, math.fsum(base), math.fsum(p) + n_words * go_on + stop))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                ends = pa.array(offsets, pa.int32())
                lists = [pa.array(rare, pa.binary()).cast(pa.string()), pa.array(rare_tf, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(ends, x) for x in lists], names=names)

    schema = "doc_id long, version long, n_words long, known long, base double, score double, rare array<string>, rare_tf array<long>"
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, train: Column, path: str, rounds: int = ROUNDS, common: int = COMMON, pseudo: float = PSEUDO) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text; rows that meet ``train`` are learned from."""
    docs = docs.select("doc_id", "text")
    counts = stored(word_counts(docs, train))
    rows = docs.filter(train).count()
    learned = counts.filter("n > 0")
    types, words = learned.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_total, n_types = words + rows, types + (rows > 0)
    pieces, spelled = prior = read_pieces(path)
    for _ in range(rounds if words else 0):
        pieces, spelled = reweighted(learned, pieces, spelled, prior, pseudo * words)
    counts = stored(priced(counts, pieces, spelled))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(counts, common))
    alone = stored(first_pass(docs, shared, (rows + 1) / (n_total + 2), int(rows > 0)))
    rare = alone.select("doc_id", "version", F.explode(F.arrays_zip("rare", "rare_tf")).alias("x"))
    rare = rare.select("doc_id", "version", F.col("x.rare").alias("word"), F.col("x.rare_tf").alias("tf"))
    # rows that share id and text add up here; ``tokens`` tells how many they are
    sums = rare.join(counts, "word").groupBy(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version")).agg(
        F.sum("tf").alias("tokens"),
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rare_base"),
        F.sum(F.col("tf") * F.col("p")).alias("rare_score"),
    )
    own = F.aggregate("rare_tf", F.lit(0).cast("long"), lambda total, x: total + x)
    alone = alone.withColumn("own", own).drop("rare", "rare_tf")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    joined = alone.join(sums, same, "left").withColumn("copies", F.coalesce(F.col("tokens") / F.col("own"), F.lit(1.0)))
    n_tokens = F.col("n_words") + 1
    base = F.col("base") + F.coalesce(F.col("rare_base") / F.col("copies"), F.lit(0.0)) + math.log10(rows + 1)
    known = F.col("known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), F.lit(0))
    total = (F.col("score") + F.coalesce(F.col("rare_score") / F.col("copies"), F.lit(0.0))) / math.log(10)
    return joined.select(
        "doc_id", n_tokens.alias("n_tokens"), known.alias("n_known"), F.lit(n_total).cast("long").alias("train_tokens"),
        (base - n_tokens * math.log10(n_total + n_types + 1)).alias("base_score"), total.alias("score"),
    )

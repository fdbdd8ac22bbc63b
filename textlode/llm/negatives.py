"""Hard-negative mining: a distributed kNN join over Voronoi cells.

Vectors are scaled and floored to integers; the score of two is their integer
inner product. A candidate x is given one more component, sqrt(M^2 - |x|^2) with M
the largest norm, and an anchor a zero: then |a - x|^2 = |a|^2 + M^2 - 2 score, so
that higher scores are lesser distances and the triangle inequality holds.

Anchors are assigned to the nearest of ``pivots`` points; small cells that lie
close share a group and large ones are dealt to several, so that a group has about
``group`` anchors. A cell keeps the least and largest distance of its anchors to
the pivot and the least and largest distance at which any of them still needs
candidates. A candidate goes to a group only if, by these bounds, one of its cells
may need it. Within a group candidates are dealt to chunks; each (group, chunk)
holds its anchors, reads its candidates block by block and keeps the best, exactly.
The best of all chunks are ranked by a window that is limited before it moves.

Two joins run: the positives (same label), then the negatives, whose scores must
lie between shares of a positive's score. The distances that anchors need come
from a pilot of at most ``pilot`` rows that they meet first: as the pilot is part
of the candidates, its k-th best score bounds theirs from below. Pivots and pilot
only save work; results do not depend on them. On vectors without clusters in many
dimensions no such bound cuts much, and the work is then anchors times candidates.

Broadcast are the pilot and a row a pivot. No row is dropped: hot labels, cells
and equal vectors are dealt like others.

Rows with a null label, a null vector, or any component that is null or not finite
(also after scaling) take no part. Repeated rows are rows of their own: an anchor
that occurs twice is answered twice, and each is the other's first positive. A null
id is no anchor; as a partner it comes last among equal scores. Shorter vectors
count as ending in zeros. Scores must fit a long. Anchors without partners give no
rows, and so do tables without rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from pyspark.sql.window import Window

from textlode.llm.common import stored

LAST = np.iinfo("i8").max
LEAST = np.iinfo("i8").min
BLOCK = 4096


@dataclass(frozen=True)
class Mining:
    """``low`` and ``high`` are hundredths of the positive's score, between which a negative's must lie."""

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    pivots: int = 64
    pilot: int = 2048
    group: int = 1024
    chunk: int = 16_384


def usable(vectors: DataFrame, m: Mining) -> DataFrame:
    """vec_id, label and embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * m.scale) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    return rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def matrix(lists: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """Scaled integers as float64, a row a list, with zeros behind shorter ones up to ``width`` at least."""
    flat = np.floor(scale * np.asarray(lists.flatten(), "f8"))
    lengths = np.asarray(lists.value_lengths(), "i8")
    width = max(width, int(lengths.max(initial=0)))
    if len(flat) == len(lengths) * width:
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def integers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exactly: by floats as long as every sum stays below 2^53."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    largest = [np.sqrt((x * x).sum(1).max(initial=0.0)) for x in (a, b)]
    if largest[0] * largest[1] < 2.0**52:
        return (a @ b.T).astype("i8")
    exact = [[[int(v) for v in row] for row in x] for x in (a, b)]
    rows = [[sum(p * q for p, q in zip(x, y, strict=True)) for y in exact[1]] for x in exact[0]]
    return np.array(rows, "i8").reshape(len(a), len(b))


class Space:
    """Pivots and pilot, and distances to pivots; the same on the driver and in tasks."""

    def __init__(self, pilot: np.ndarray, ids: np.ndarray, labels: np.ndarray, largest: float, pivots: int):
        self.pilot, self.ids, self.labels, self.largest = pilot, ids, labels, largest
        self.pivots = pilot[:pivots]
        self.height = np.sqrt(np.maximum(0, largest - (self.pivots**2).sum(1)))
        #: More than what rounding adds to a distance.
        self.slack = 1e-5 * np.sqrt(largest) + 1e-9

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """From each row to each pivot."""
        width = max(x.shape[1], self.pivots.shape[1])
        a, p = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, self.pivots))
        norms = (a * a).sum(1)
        up = np.zeros(len(a)) if anchors else np.sqrt(np.maximum(0, self.largest - norms))
        return np.sqrt(np.maximum(0, (norms + up * up)[:, None] + self.largest - 2 * (a @ p.T + up[:, None] * self.height)))

    def reach(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance that a score means; infinite for no score."""
        d = np.sqrt(np.maximum(0, norms + self.largest - 2 * scores.astype("f8")))
        return np.where(scores == LEAST, np.inf, d)


def parts_of(pilot: pa.Table, largest: float, m: Mining) -> dict:
    """What a space is made of, as plain values that travel without this module."""
    pilot = pilot.combine_chunks()
    vectors = matrix(pilot["embedding"].combine_chunks(), m.scale) if pilot.num_rows else np.zeros((1, 1))
    return {"pilot": vectors, "ids": longs(pilot["vec_id"]), "labels": longs(pilot["label"]), "largest": largest, "pivots": m.pivots}


def space_of(shared: Broadcast) -> Space:
    """One for each Python worker: the broadcast value outlives a task."""
    parts = shared.value
    if "space" not in parts:
        parts["space"] = Space(**parts)
    return parts["space"]


def longs(column) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(LAST), "i8")


def first_k(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each key's first ``k`` entries: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, keys))
    ranked = keys[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, "i8")
    rank = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.r_[starts, len(ranked)]))
    return order[rank < k]


class Best:
    """The first ``k`` partners of each of some slots, over blocks of candidates."""

    def __init__(self, bounds: np.ndarray, k: int):
        self.k, self.floor = k, bounds.copy()
        self.slots, self.scores, self.ids = (np.zeros(0, "i8") for _ in range(3))

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(slots):
            return
        slots, scores, ids = (np.concatenate(x) for x in ((self.slots, slots), (self.scores, scores), (self.ids, ids)))
        kept = first_k(slots, scores, ids, self.k)
        self.slots, self.scores, self.ids = slots[kept], scores[kept], ids[kept]
        starts = np.flatnonzero(np.r_[True, self.slots[1:] != self.slots[:-1]])
        full = np.diff(np.r_[starts, len(self.slots)]) == self.k
        ends = starts[full] + self.k - 1
        self.floor[self.slots[ends]] = np.maximum(self.floor[self.slots[ends]], self.scores[ends])


class Anchors:
    """The anchors of a group, and what they want of candidates."""

    def __init__(self, rows: pa.Table, m: Mining):
        rows = rows.combine_chunks()
        self.rows, self.ids, self.labels = longs(rows["row"]), longs(rows["vec_id"]), longs(rows["label"])
        self.vectors, self.m = matrix(rows["embedding"].combine_chunks(), m.scale), m
        self.own = np.array([integers(v[None], v[None])[0, 0] for v in self.vectors], "i8")
        self.seen = np.zeros(len(self.rows), bool)
        self.wanted = rows["wanted"].to_pylist()
        if self.wanted and self.wanted[0] is not None:
            shape = len(self.rows), m.positives
            self.low, self.high = np.full(shape, LAST), np.full(shape, LEAST)
            for a, wanted in enumerate(self.wanted):
                for j, w in enumerate(wanted):
                    self.low[a, j], self.high[a, j] = w["low"], w["high"]
            self.best = Best(self.low.ravel(), m.negatives)
        else:
            self.wanted, self.best = None, Best(longs(rows["floor"]), m.positives)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores, same = integers(self.vectors, vectors), self.labels[:, None] == labels
        if self.wanted is None:
            a, c = np.nonzero(same & (scores >= self.best.floor[:, None]))
            found = scores[a, c]
            for i in np.flatnonzero((ids[c] == self.ids[a]) & (found == self.own[a])):
                if not self.seen[a[i]]:  # the anchor itself, once
                    self.seen[a[i]], a[i] = True, -1
            self.best.add(a[a >= 0], found[a >= 0], ids[c[a >= 0]])
            return
        floor, slots, found, partners = self.best.floor.reshape(self.low.shape), [], [], []
        for j in range(self.m.positives):
            a, c = np.nonzero(~same & (scores <= self.high[:, j : j + 1]) & (scores >= floor[:, j : j + 1]))
            slots.append(a * self.m.positives + j)
            found.append(scores[a, c])
            partners.append(ids[c])
        self.best.add(*map(np.concatenate, (slots, found, partners)))

    def result(self) -> pa.RecordBatch:
        b, ids = self.best, pa.array(self.best.ids, mask=self.best.ids == LAST)
        if self.wanted is None:
            return pa.RecordBatch.from_arrays([pa.array(self.rows[b.slots]), ids, pa.array(b.scores)], names=["row", "id", "score"])
        a, j = np.divmod(b.slots, self.m.positives)
        wanted = [self.wanted[x][y] for x, y in zip(a, j, strict=True)]
        columns = [pa.array(self.rows[a]), pa.array(self.ids[a]), pa.array(j.astype("i4"))]
        columns += [pa.array([w[k] for w in wanted], "int64") for k in ("id", "score")]
        return pa.RecordBatch.from_arrays([*columns, ids, pa.array(b.scores)], names=["row", "anchor_id", "place", "positive_id", "positive_score", "id", "score"])


def local_join(m: Mining) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (group, chunk), anchors first: the anchors are held, candidates pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, anchors = None, [], None
        for batch in batches:
            keys = np.stack([longs(batch["group"]), longs(batch["chunk"]), batch["row"].is_valid().to_numpy(zero_copy_only=False)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for start, stop in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                group, chunk, anchor = keys[:, start]
                if (group, chunk) != key:
                    if anchors:
                        yield anchors.result()
                    key, held, anchors = (group, chunk), [], None
                if anchor:
                    held.append(batch.slice(start, stop - start))
                    continue
                if held:
                    anchors, held = Anchors(pa.Table.from_batches(held), m), []
                if anchors:
                    for at in range(start, stop, BLOCK):
                        part = batch.slice(at, min(BLOCK, stop - at))
                        anchors.meet(longs(part["vec_id"]), longs(part["label"]), matrix(part["embedding"], m.scale))
        if anchors:
            yield anchors.result()

    return run


#: What a candidate of a (group, chunk) carries beside its own columns, so that both kinds have the same.
WANTED = "array<struct<id:long,score:long,low:long,high:long>>"


def groups_of(cells: list[dict], space: Space, group_size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last group of each pivot's cell: close cells share one, large cells get several."""
    first, last = (np.full(len(space.pivots), -1) for _ in range(2))
    counts = {c["cell"]: c["n"] for c in cells}
    left, at, group, fill = set(counts), min(counts, default=0), -1, LAST
    while left:
        at = min(left, key=lambda c: ((space.pivots[c] - space.pivots[at]) ** 2).sum())
        left.remove(at)
        n = -(-counts[at] // group_size)
        if n > 1 or fill + counts[at] > group_size:
            first[at], last[at] = group + 1, group + n
            group, fill = group + n, LAST if n > 1 else counts[at]
        else:
            first[at] = last[at] = group
            fill += counts[at]
    return first, last


def joined(candidates: DataFrame, anchors: DataFrame, space: Broadcast, n: int, m: Mining, schema: str) -> DataFrame:
    """The local joins' rows. ``anchors``: row, vec_id, label, embedding, cell, near, floor, wanted, least and most (distances needed)."""
    cells = anchors.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("inner"), F.max("near").alias("outer"), F.min("least").alias("least"), F.max("most").alias("most"))
    cells = [r.asDict() for r in cells.collect()]
    first, last = groups_of(cells, space_of(space), m.group)
    chunks = -(-n // m.chunk)
    own = [c["cell"] for c in cells]
    bounds = {k: np.array([c[k] for c in cells], "f8") for k in ("inner", "outer", "least", "most")}
    ranges = sorted({(first[c], last[c]) for c in own})
    member = np.array([[(first[c], last[c]) == r for r in ranges] for c in own])

    def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space_of(space)
        for batch in batches:
            d = s.distances(matrix(batch["embedding"], m.scale), anchors=False)[:, own]
            nearest = np.maximum(d - bounds["outer"], bounds["inner"] - d)
            needed = (nearest <= bounds["most"] + s.slack) & (d + bounds["outer"] >= bounds["least"] - s.slack)
            which = needed @ member
            lists = pa.ListArray.from_arrays(np.r_[0, which.sum(1).cumsum()].astype("i4"), pa.array(np.nonzero(which)[1].astype("i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "ranges"])

    if not cells:
        return candidates.sparkSession.createDataFrame([], schema)
    spread = F.array(*(F.struct(F.lit(int(a)).alias("first"), F.lit(int(b)).alias("last")) for a, b in ranges))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    kept = candidates.mapInArrow(served, StructType([*candidates.schema.fields]).add("ranges", ArrayType(IntegerType())))
    kept = kept.select("*", F.explode("ranges").alias("range")).withColumn("range", spread[F.col("range")])
    kept = kept.select(F.explode(F.sequence("range.first", "range.last")).alias("group"), chunk.alias("chunk"), F.lit(None).cast("long").alias("row"), "vec_id", "label", "embedding", F.lit(None).cast("long").alias("floor"), F.lit(None).cast(WANTED).alias("wanted"))
    dealt = F.array(*(F.struct(F.lit(int(first[c])).alias("first"), F.lit(int(last[c] - first[c] + 1)).alias("many")) if first[c] >= 0 else F.lit(None) for c in range(len(first))))[F.col("cell")]
    asking = anchors.withColumn("dealt", dealt)
    asking = asking.withColumn("group", (F.col("dealt.first") + F.pmod(F.xxhash64("row"), F.col("dealt.many"))).cast("int"))
    asking = asking.select("group", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "row", "vec_id", "label", "embedding", "floor", "wanted")
    every = asking.union(kept).repartition("group", "chunk").sortWithinPartitions("group", "chunk", F.col("row").isNull(), "row")
    return every.mapInArrow(local_join(m), schema)


def _asking(space: Broadcast, m: Mining) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors with their cell, and what the pilot says of the positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space_of(space)
        for batch in batches:
            x, ids, labels = matrix(batch["embedding"], m.scale), longs(batch["vec_id"]), longs(batch["label"])
            d, own = s.distances(x, anchors=True), (x * x).sum(1)
            scores = integers(x, s.pilot)[:, : len(s.ids)]
            floor = np.full(len(x), LEAST)
            for a in range(len(x)):
                found = scores[a][s.labels == labels[a]]
                itself = np.flatnonzero((s.ids[s.labels == labels[a]] == ids[a]) & (found == own[a]))
                found = np.sort(np.delete(found, itself[:1]))
                if len(found) >= m.positives:
                    floor[a] = found[-m.positives]
            cell = d.argmin(1)
            columns = [pa.array(cell.astype("i4")), pa.array(d[np.arange(len(x)), cell]), pa.array(floor), pa.array(np.zeros(len(x))), pa.array(s.reach(own, floor))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "cell", "near", "floor", "least", "most"])

    return run


def _windows(space: Broadcast, m: Mining) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors with their positives: the scores that negatives may have, as far as the pilot does not narrow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, arrow = space_of(space), pa.list_(pa.struct([(k, pa.int64()) for k in ("id", "score", "low", "high")]))
        for batch in batches:
            x, labels = matrix(batch["embedding"], m.scale), longs(batch["label"])
            own, scores = (x * x).sum(1), integers(x, s.pilot)[:, : len(s.ids)]
            wanted, ends = [], []
            for a, positives in enumerate(batch["positives"].to_pylist()):
                found, windows = np.sort(scores[a][s.labels != labels[a]]), []
                for p in positives:
                    low, high = -(-m.low * p["score"] // 100), m.high * p["score"] // 100
                    inside = found[(found >= low) & (found <= high)][-m.negatives :]
                    low = int(inside[0]) if len(inside) == m.negatives else low
                    windows.append({"id": p["id"], "score": p["score"], "low": low, "high": high})
                open_ones = [w for w in windows if w["low"] <= w["high"]]
                wanted.append(windows)
                ends.append((max((w["high"] for w in open_ones), default=None), min((w["low"] for w in open_ones), default=None)))
            wide = [e[0] is not None for e in ends]
            reach = [s.reach(own, np.array([e[k] or 0 for e in ends], "i8")) for k in (0, 1)]
            batch = batch.drop_columns(["floor", "least", "most", "positives"])
            columns = [*batch.columns, pa.array(reach[0]), pa.array(reach[1]), pa.array(wanted, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "least", "most", "wanted"]).filter(pa.array(wide))

    return run


def mine(vectors: DataFrame, anchor: Column, m: Mining | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, label and embedding; ``anchor`` tells the rows that ask.
    """
    m = m or Mining()
    context, rows = vectors.sparkSession.sparkContext, usable(vectors, m)
    norm = F.aggregate("embedding", F.lit(0.0), lambda sum_, x: sum_ + F.pow(F.floor(x.cast("double") * m.scale).cast("double"), F.lit(2.0)))
    n, largest = rows.agg(F.count("*"), F.max(norm)).first()
    pilot = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(m.pilot)
    space = context.broadcast(parts_of(pilot.toArrow(), largest or 0.0, m))

    kinds = "row long, vec_id long, label long, embedding {}, cell int, near double".format(rows.schema["embedding"].dataType.simpleString())
    asking = rows.filter(anchor).withColumn("row", F.monotonically_increasing_id()).select("row", *rows.columns)
    asking = stored(asking.mapInArrow(_asking(space, m), f"{kinds}, floor long, least double, most double"))
    found = joined(rows, asking.withColumn("wanted", F.lit(None).cast(WANTED)), space, n, m, "row long, id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= m.positives)
    positives = ranked.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asking = asking.join(positives, F.col("row") == F.col("of")).drop("of")
    asking = stored(asking.mapInArrow(_windows(space, m), f"{kinds}, least double, most double, wanted {WANTED}"))

    schema = "row long, anchor_id long, place int, positive_id long, positive_score long, id long, score long"
    found = joined(rows, asking.withColumn("floor", F.lit(None).cast("long")), space, n, m, schema)
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(*order))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= m.negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

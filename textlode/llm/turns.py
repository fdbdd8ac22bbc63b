"""Conversation structure repair: a min-plus scan of turn matrices.

A repaired conversation has the roles ``(system? (user assistant)+)?``, by their
initials. The states of that form are: nothing yet, after the system turn, after
a user turn, after an assistant turn. Each turn is a 4x4 matrix over (cost,
audit): entry (i, j) is the cheapest way from state i to state j by one edit of
the turn and any inserts behind it (the insert closure). Sums of costs and joined
audits multiply, the lesser pair adds; as ways over the same turns that cost the
same never have an audit that begins the other, joining keeps their order, so the
product is associative and conversations reduce as trees.

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty
user or assistant turn 2; a truncated turn that stays costs 1 more; blank turns
and duplicates (role and text seen earlier in the conversation) must go. Among
the cheapest audits the least in ASCII order is taken.

Rows are put in order by ranges of (conversation, turn, digest), so a conversation
may span many partitions: each partition reduces its share of a conversation to
one matrix, and the shares are multiplied in levels of ``FAN``. Only turns and
digests move for that, no texts. Equal rows are counted before they move. Texts
move once, to the task that writes a conversation out, row by row in constant
memory besides the audit, which is one value of the result.

Order: by turn, null turns first, ties by a digest of role and text. Null roles
and texts count as one space, which makes a text blank; a null conversation is
one of its own. Roles that begin otherwise (or are empty) can not be kept. A table
without rows gives none; texts of any length are digested and written whole;
repeated rows are duplicates. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

FAN = 32
#: Turns whose product is remembered, and how many such products a task keeps.
RUN, KEPT = 8, 1 << 16
STATES = "ESUA"
#: From a state to the one that a role's initial leads to.
NEXT = {"Es": "S", "Eu": "U", "Su": "U", "Ua": "A", "Au": "U"}
#: The initial that fits behind a state, where an edit may choose it.
FITS = {"E": "u", "S": "u", "U": "a", "A": "u"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
Matrix = tuple[tuple[int, str] | None, ...]


def times(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                a, b = x[i + k], y[4 * k + j]
                if a and b and (best is None or a[0] + b[0] <= best[0]):
                    way = a[0] + b[0], a[1] + b[1]
                    best = way if best is None else min(best, way)
            out.append(best)
    return tuple(out)


def _matrix(ways: dict[str, tuple[int, str]]) -> Matrix:
    return tuple(ways.get(i + j) for i in STATES for j in STATES)


def _closure() -> Matrix:
    """Any number of inserts; more than two never pay."""
    none, one = _matrix({s + s: (0, "") for s in STATES}), _matrix({s + NEXT[s + FITS[s]]: (2, "I") for s in STATES})
    two = times(one, one)
    return tuple(min((w for w in ways if w), default=None) for ways in zip(none, one, two, strict=True))


CLOSURE = _closure()


def turn_matrix(kind: str) -> Matrix:
    """Of one turn: ``X`` must go; else its role's initial (``o``: another), in upper case if truncated."""
    ways = {s + s: (3, "D") for s in STATES}
    if kind != "X":
        extra = int(kind.isupper())
        for s in STATES:
            fitting = s + NEXT[s + FITS[s]]
            ways[fitting] = min(ways.get(fitting, (9, "")), (2 + extra, "R"))
            if to := NEXT.get(s + kind.lower()):
                ways[s + to] = min(ways.get(s + to, (9, "")), (extra, "K"))
    return times(_matrix(ways), CLOSURE)


#: A plain table: a wrapped function would travel by its module's name, which workers need not have.
RUNS: dict[str, Matrix] = {}


def _run(kinds: str) -> Matrix:
    found = RUNS.get(kinds)
    if found is None:
        if len(RUNS) >= KEPT:
            RUNS.clear()
        found = RUNS[kinds] = turn_matrix(kinds) if len(kinds) == 1 else times(_run(kinds[:-1]), _run(kinds[-1]))
    return found


def product(kinds: str) -> Matrix:
    """Of one turn or more, as a tree over runs."""
    if len(kinds) <= RUN:
        return _run(kinds)
    half = (len(kinds) // 2 + RUN - 1) // RUN * RUN
    return times(product(kinds[:half]), product(kinds[half:]))


def cheapest(whole: Matrix) -> tuple[int, str]:
    ways = times(CLOSURE, whole)
    return min(w for w in (ways[0], ways[3]) if w)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that each row's crc32 chooses."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("how")
    ).filter("how <> 0")
    how = F.col("how")
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(how == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def _plain(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _kinds(conversations: DataFrame) -> DataFrame:
    """A row for each different (conv_id, turn, role, text): initial, kind of the first of its ``n`` copies, and faults."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    state = F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), "blank").when(~text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated").otherwise("whole")
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    rows = _plain(conversations).select("conv_id", "turn", "digest", initial.alias("initial"), state.alias("state"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    first = rows.groupBy(F.col("conv_id").alias("conv"), F.col("digest").alias("same")).agg(F.min(F.struct("turn")).alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("same")))
    seen = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return rows.select("conv_id", "turn", "digest", "initial", "n", F.when((F.col("state") != "blank") & seen, "duplicate").otherwise(F.col("state")).alias("state"))


class Share:
    """What a run of a conversation's turns comes to."""

    SCHEMA = (
        "costs array<long>, ways array<string>, blank long, duplicate long, truncated long, illegal long, turns long, "
        "first string, last string, first_turn long, last_turn long, least long, most long"
    )

    def __init__(self, matrix: Matrix, counts: list[int], ends: list):
        self.matrix, self.counts, self.ends = matrix, counts, ends

    @staticmethod
    def of(rows: list[tuple]) -> Share:
        """From (turn, initial, n, state) in order."""
        kinds, blank, duplicate, truncated, illegal, turns, before, last = [], 0, 0, 0, 0, 0, None, None
        for turn, initial, n, state in rows:
            if state == "blank":
                blank += n
                kinds.append("X" * n)
            elif state == "duplicate":
                duplicate += n
                kinds.append("X" * n)
            else:
                truncated += state == "truncated"
                duplicate += n - 1
                kinds.append((initial.upper() if state == "truncated" else initial) + "X" * (n - 1))
            illegal += n - 1 + (last is not None and last + initial not in LEGAL)
            turns += turn is not None and turn != before
            before, last = turn, initial
        known = [t for t in (r[0] for r in rows) if t is not None]
        ends = [rows[0][1], last, rows[0][0], before, known[0] if known else None, before]
        return Share(product("".join(kinds)), [blank, duplicate, truncated, illegal, turns], ends)

    def then(self, other: Share) -> Share:
        counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        a, b = self.ends, other.ends
        counts[3] += a[1] + b[0] not in LEGAL
        counts[4] -= a[3] is not None and a[3] == b[2]
        least = a[4] if a[4] is not None else b[4]
        return Share(times(self.matrix, other.matrix), counts, [a[0], b[1], a[2], b[3], least, b[5] if b[5] is not None else a[5]])

    def row(self) -> tuple:
        ways = self.matrix
        return [w and w[0] for w in ways], [w and w[1] for w in ways], *self.counts, *self.ends

    @staticmethod
    def read(row: tuple) -> Share:
        matrix = tuple(None if c is None else (c, w) for c, w in zip(row[0], row[1], strict=True))
        return Share(matrix, list(row[2:7]), list(row[7:]))

    def result(self) -> tuple:
        cost, audit = cheapest(self.matrix)
        blank, duplicate, truncated, illegal, turns = self.counts
        least, most = self.ends[4:]
        return 0 if least is None else most - least + 1 - turns, blank, duplicate, truncated, illegal, cost, audit


def tree(shares: list[Share]) -> Share:
    while len(shares) > 1:
        pairs = [a.then(b) for a, b in zip(shares[::2], shares[1::2], strict=False)]
        shares = pairs + shares[len(pairs) * 2 :]
    return shares[0]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``most`` rows or some 16 MB of text."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(waiting) >= most or size > 16e6:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns), strict=True)


def _runs(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows that agree in their first ``width`` values."""
    key, run = None, []
    for row in rows:
        if run and row[:width] != key:
            yield key, run
            run = []
        key = row[:width]
        run.append(row[width:])
    if run:
        yield key, run


def _schema(text: str, df: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.types import _parse_datatype_string

    text = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {text}"
    return text, to_arrow_schema(_parse_datatype_string(text))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(conversations: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost and the cheapest audit."""
    spark = conversations.sparkSession
    kinds = _kinds(conversations).withColumn("turn", F.col("turn").cast("long"))
    order = ["conv_id", "turn", "digest"]
    placed = kinds.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", F.spark_partition_id().alias("part"), "turn", "initial", "n", "state")
    share_schema, share_arrow = _schema(f"part int, {Share.SCHEMA}", conversations)
    result_schema, result_arrow = _schema(RESULT, conversations)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((*key, *Share.of(run).row()) for key, run in _runs(_rows(batches), 2)), share_arrow)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = ((*key, *tree([Share.read(r[1:]) for r in run]).row()) for key, run in _runs(_rows(batches), 2))
        return _batches(shares, share_arrow)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((*key, *tree([Share.read(r[1:]) for r in run]).result()) for key, run in _runs(_rows(batches), 1)), result_arrow)

    def grouped(shares: DataFrame, block: Column) -> DataFrame:
        rest = [c for c in shares.columns if c not in ("conv_id", "part")]
        shares = shares.withColumn("block", block.cast("int"))
        return shares.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part").select("conv_id", "block", "part", *rest)

    shares = placed.mapInArrow(first, share_schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while parts > FAN:
        shares = grouped(shares, F.floor(F.col("part") / FAN)).mapInArrow(level, share_schema)
        parts = -(-parts // FAN)
    return grouped(shares, F.lit(0)).drop("block").mapInArrow(last, result_schema)


def steps(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay and of inserted ones, in order."""
    at, state = 0, "E"
    for role, text in turns:
        while audit[at] == "I":
            fit = FITS[state]
            yield "I", ROLES[fit], ""
            at, state = at + 1, NEXT[state + fit]
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else FITS[state]
        yield edit, role if edit == "K" else ROLES[initial], text
        state = NEXT[state + initial]
    for _ in audit[at:]:
        fit = FITS[state]
        yield "I", ROLES[fit], ""
        state = NEXT[state + fit]


def repaired(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, step, edit, role and text of the repaired turns; each conversation lies in one partition, in order."""
    texts = _plain(conversations).select("conv_id", F.col("turn").cast("long").alias("turn"), "digest", "role", "text")
    heads = audits.select("conv_id", F.lit(True).alias("head"), *(F.lit(None).cast(t).alias(c) for c, t in texts.dtypes[1:4]), F.col("audit").alias("text"))
    rows = heads.union(texts.select("conv_id", F.lit(False).alias("head"), "turn", "digest", "role", "text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "digest")
    schema, arrow = _schema("step long, edit string, role string, text string", conversations)

    def write(rows: Iterator[tuple]) -> Iterator[tuple]:
        waiting = next(rows, None)
        while waiting:
            conv, _, _, audit = waiting
            waiting = None

            def turns(conv=conv):
                nonlocal waiting
                for row in rows:
                    if row[1]:
                        waiting = row
                        return
                    yield row[2], row[3]

            for k, step in enumerate(steps(audit, turns())):
                yield conv, k, *step

    return rows.select("conv_id", "head", "role", "text").mapInArrow(lambda batches: _batches(write(_rows(batches)), arrow), schema)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its turns as ``role:text`` lines, from the rows of ``repaired`` as they lie."""
    schema, arrow = _schema("repaired_sha256 string", repaired)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, found = None, None
        for c, step, role, text in rows:
            if step == 0:
                if found:
                    yield conv, found.hexdigest()
                conv, found = c, hashlib.sha256()
            else:
                found.update(b"\n")
            found.update(f"{role}:{text}".encode())
        if found:
            yield conv, found.hexdigest()

    return repaired.select("conv_id", "step", "role", "text").mapInArrow(lambda batches: _batches(run(_rows(batches)), arrow), schema)

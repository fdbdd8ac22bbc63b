import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from textlode.llm import queries, turns
from textlode.llm.sql import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def digest(row):
    return hashlib.md5(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()


def plain_repair(rows):
    """Of one conversation's damaged rows, turn by turn over (initials so far) for every prefix of the form."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    known = [t for _, t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))

    def after(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    if (to := after(state, role[0])) is not None:
                        ways[to] = min(ways.get(to, (10**9, "", [])), (cost + 2, audit + "I", [*out, role + ":"]))
        return ways

    ways = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def take(to, way, new=new):
            new[to] = min(new.get(to, (10**9, "", [])), way)

        for state, (cost, audit, out) in ways.items():
            take(state, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (to := after(state, role[:1])) is not None:
                    take(to, (cost + extra, audit + "K", [*out, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    if (to := after(state, other[0])) is not None:
                        take(to, (cost + 2 + extra, audit + "R", [*out, f"{other}:{text}"]))
        ways = inserted(new)
    cost, audit, out = min(ways[s] for s in ("", "a") if s in ways)
    count = Counter(faults)
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return {c: plain_repair(of) for c, of in by.items()}


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "So it is", "", " \t", "What? ", None, f"t{rng.random()}.", f"u{rng.random()}"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows + rows[:7]


def run(spark, tmp_path, rows, **extra):
    spark.createDataFrame([r for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_structure_repair(spark, str(tmp_path))
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}


def test_cases(spark, tmp_path):
    rows = conversations(1, 400, 7) + conversations(2, 3, 300)[:-7]
    assert run(spark, tmp_path, rows) == expected(rows)


def test_long_conversation_spans_partitions(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = [(7, t, ["user", "assistant"][t % 2 ^ (t % 11 == 0)], f"text {t % 900}" + "." * (t % 5 > 0)) for t in range(20_000)]
        rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
        assert run(spark, tmp_path, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_every_row_dropped(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = run(spark, tmp_path, [(dropped, 0, "user", "Hi.")])
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_other_columns_and_general_output(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Go on"), (1, 2, "tool", "x."), (1, 2, "tool", "x.")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", audit int, digest string")
    audits = turns.audits(df)
    (row,) = audits.collect()
    assert (row.audit, row.cost, row.duplicate, row.truncated, row.gaps) == ("IKKRD", 2 + 1 + 2 + 3, 1, 1, 0)
    out = turns.repaired(df, audits).orderBy("step").collect()
    assert [tuple(r)[1:] for r in out] == [(0, "I", "user", ""), (1, "K", "assistant", "Hello."), (2, "K", "user", "Go on"), (3, "R", "assistant", "x.")]


def all_ways(kinds):
    """Every audit of a few turns, by trying all of them: the cheapest, then least."""
    best = (10**9, "")
    inserts = ["", "I", "II"]
    for edits in itertools.product("KRD", repeat=len(kinds)):
        for gaps in itertools.product(inserts, repeat=len(kinds) + 1):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:], strict=True))
            outs, cost, rest = {""}, 0, list(kinds)
            for letter in audit:
                kind = "" if letter == "I" else rest.pop(0)
                if letter == "D":
                    cost += 3
                    continue
                if kind == "X" or (letter == "K" and kind.lower() not in "sua"):
                    outs = set()
                    break
                cost += {"I": 2, "R": 2, "K": 0}[letter] + kind.isupper()
                outs = {o + x for o in outs for x in (kind.lower() if letter == "K" else "ua")}
            if any(FORM.fullmatch(o) for o in outs):
                best = min(best, (cost, audit))
    return best


@pytest.mark.parametrize("kinds", ["", *map("".join, itertools.product("suaoUX", repeat=2)), "uua", "aau", "sXa", "oSu", "Aus", "uau"])
def test_matrices_against_all_ways(kinds):
    if kinds:
        assert turns.cheapest(turns.product(kinds)) == all_ways(kinds)


def test_product_is_associative():
    rng = random.Random(3)
    for _ in range(200):
        kinds = "".join(rng.choice("suaoSUAOX") for _ in range(rng.randint(2, 60)))
        cut = rng.randrange(1, len(kinds))
        assert turns.times(turns.product(kinds[:cut]), turns.product(kinds[cut:])) == turns.product(kinds)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_structure_repair(spark, sf).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duck.sql(f"SELECT conv_id, {', '.join(COLUMNS)} FROM ({ORACLES['op11_structure_repair']})").fetchall()
    assert got == {r[0]: r[1:] for r in want}

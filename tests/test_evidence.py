import datetime as dt
import random

from textlode.operators import evidence
from textlode.operators import index as ix

SECTIONS = "query_id long, section int, name string, header string, needs int, lines array<string>"
OBJECTS = (
    "id long, scope_id long, kind string, subject string, predicate string, object string, event_type string, confidence double, status string, "
    "created_at timestamp_ntz, priority long, severity string, failures long, content string"
)


def fold(sections, budget):
    left, names, texts = budget, [], []
    for _, name, header, needs, lines in sorted(sections):
        first, own = name.split("/")[0], name.split("/")[-1]
        if left <= needs or first in names:
            continue
        taken = []
        for line in lines:
            cost = -(-len(line) // 4)
            if left - cost < 0:
                break
            left -= cost
            taken.append(line)
        if taken:
            left -= -(-len(header) // 4)
            names.append(own)
            texts.append(header + "\n".join(taken))
    return names, texts


def test_one_budget_over_sections_in_order(spark):
    rng = random.Random(2)
    rows = []
    for q in range(60):
        for section, (name, needs) in enumerate([("claims", 0), ("decisions", 0), ("relations", 0), ("relations/relationships", 0), ("summaries", 100), ("messages", 50)]):
            if rng.random() < 0.8:
                lines = ["x" * rng.choice([1, 4, 40, 300, 900]) for _ in range(rng.randint(0, 5))]
                rows.append((q, section, name, f"[{name}]\n", needs, lines))
    got = {r.query_id: r for r in evidence.budgeted(spark.createDataFrame(rows, SECTIONS), 300).collect()}
    for q in range(60):
        names, texts = fold([r[1:] for r in rows if r[0] == q], 300)
        if not names:
            assert q not in got
            continue
        assert (got[q].sources.split(","), got[q].n_sections) == (names, len(names))
        mixed = {"summaries", "messages"} & set(names) and {"claims", "decisions", "relations", "relationships"} & set(names)
        assert got[q].answer == (evidence.RESOLVED if mixed else "") + "\n\n".join(texts)


def thing(i, kind, subject, confidence=0.5, status="active", scope=1, content=None, predicate="owns", **more):
    row = {"object": "u1", "event_type": "click", "priority": 1, "severity": "error", "failures": 2} | more
    created = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    return (i, scope, kind, subject, predicate, row["object"], row["event_type"], confidence, status, created, row["priority"], row["severity"], row["failures"], content or f"{subject} {kind}")


def test_federated_answer(spark, tmp_path):
    rows = [
        thing(1, "claim", "red bolt", 0.4, predicate="is"), thing(2, "claim", "red bolt", 0.9, predicate="is", object=None), thing(3, "claim", "red bolt", 1.0, "superseded"),
        thing(4, "decision", "red bolt", content="use red bolt"), thing(5, "entity", "red bolt"), thing(6, "relation", "blue ring", 0.9), thing(7, "relation", "red bolt", 0.25),
        thing(8, "relation", "red bolt", 0.8, scope=2), thing(9, "claim", "blue ring", 0.7),
    ]
    objects = spark.createDataFrame(rows, OBJECTS)
    turns = spark.createDataFrame([("a", "the red bolt broke", 1), ("b", "a red ring", 2), ("c", "Red bolt again", 3)], "msg_id string, text string, created long")
    history = evidence.History("messages", turns, ix.build(turns, str(tmp_path / "h"), "msg_id"))
    index = ix.build(objects, str(tmp_path / "o"), "id", "content")
    queries = spark.createDataFrame([(1, "Red bolt", 1), (2, "blue ring", 9), (3, "zz", 9), (4, " ", 9)], "query_id long, query string, scope_id long")
    docs = spark.createDataFrame([(1, "unused"), (3, " Some text "), (4, "  ")], "query_id long, text string")
    got = {r.query_id: r for r in evidence.federated(queries, objects, index, [history], docs).collect()}
    assert got[1].answer == evidence.RESOLVED + "\n\n".join([
        "[Resolved Facts — current state]\n• red bolt is: (empty)\n• red bolt is: u1", "[Active Decisions]\n• use red bolt", "[Entities]\n• red bolt (click)",
        "[Relations — entity connections]\n• red bolt —[owns]→ u1 (conf=0.25)\n• blue ring —[owns]→ u1 (conf=0.90)",
        "[Conversation History — may contain outdated info]\n• Red bolt again\n• the red bolt broke",
    ])
    assert got[2].sources == "claims,relationships,messages"  # no relations in its scope; any word is enough for the history
    assert "• blue ring —[owns]→ u1" in got[2].answer and "• a red ring" in got[2].answer
    assert (got[3].answer, got[3].sources) == ("[From Documents]\nSome text", "documents")
    assert 4 not in got


def test_bundles_are_limited_and_cut(spark):
    rows = [thing(i, "claim", f"s{i}", i / 100, predicate="is") for i in range(40)] + [thing(50, "loop", "late", priority=9, content="x" * 13_000), thing(51, "loop", "soon", priority=1)]
    rows += [thing(60, "invariant", "a", severity="info"), thing(61, "invariant", "b", severity="critical", scope=2), thing(62, "claim", "gone", status="superseded", scope=3)]
    got = {r.scope_id: r.evidence for r in evidence.bundles(spark.createDataFrame(rows, OBJECTS)).collect()}
    lines = got[1].split("\n")
    assert lines[0] == "Claims:" and lines[1:16] == [f"  - s{i} is: u1 (confidence: {i / 100:.2f})" for i in range(39, 24, -1)]
    assert got[1].endswith("x\n[... truncated]") and len(got[1]) == 12_000 + len("\n[... truncated]")
    assert got[2] == "Invariants:\n  - [critical] b invariant" and 3 not in got


def test_foremost_holders_are_those_of_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), float(rng.randint(0, 5)), float(rng.randint(0, 3)), " ".join(rng.sample(["red", "hot", "bolt", "ring", f"u{i}"], rng.randint(1, 4)))) for i in range(300)]
    known = spark.createDataFrame(rows, "id long, part string, first double, second double, content string")
    asked = {q: rng.sample(["red", "hot", "bolt", "ring", "none"], rng.randint(1, 3)) for q in range(40)}
    terms = spark.createDataFrame([(q, len(w), t) for q, w in asked.items() for t in w], "query_id long, n_terms int, term string")
    index = ix.build(known, str(tmp_path / "o"), "id", "content")
    got = evidence.foremost_holders(index, terms, known, {"a": 2, "b": 3})
    want = set()
    for q, words in asked.items():
        for part, n in (("a", 2), ("b", 3)):
            best = sorted((f, s, i) for i, p, f, s, c in rows if p == part and set(words) <= set(c.split()))[:n]
            want |= {(q, part, k, i) for k, (_, _, i) in enumerate(best, 1)}
    assert {(r.query_id, r.part, r.place, r.id) for r in got.collect()} == want

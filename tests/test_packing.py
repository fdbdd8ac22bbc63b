"""Packing into budgets, against plain loops."""

import random

from textlode.operators import packing
from textlode.operators.chunking import sentences, tokens_of


def plain_pack(rows, budget):
    """(source, item) of one query's ranked rows: a header for each source, until one does not fit."""
    kept, left, order = [], budget, []
    for source, *_ in rows:
        if source not in order:
            order.append(source)
    for source in order:
        if tokens_of(f"[{source}]") > left:
            break
        left -= tokens_of(f"[{source}]")
        for s, item, tokens in rows:
            if s == source:
                if tokens > left:
                    break
                left -= tokens
                kept.append((source, item))
    return kept


def test_pack_context_against_a_plain_loop(spark):
    rnd, rows, want = random.Random(6), [], {}
    for q in range(30):
        ranked = [(rnd.choice(["a", "bb", "a long source name"]), 100 * q + i, rnd.choice([5, 20, 60, 200])) for i in range(rnd.randrange(1, 25))]
        rows += [(q, s, item, i + 1, tokens) for i, (s, item, tokens) in enumerate(ranked)]
        want[q] = plain_pack(ranked, 150)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "query_id long, source string, item long, rank long, tokens long")
    got = {q: [] for q in want}
    for r in sorted(packing.pack_context(df, 150).collect(), key=lambda r: (r.query_id, r.place)):
        got[r.query_id].append((r.source, r.item))
    assert got == want and any(len(v) > 3 for v in want.values())


def test_brief_takes_the_best_sentences_that_fit(spark):
    rnd, rows = random.Random(2), []
    words = ["cache", "server", "fails", "often", "the", "of", "night", "report", "index", "slow"]
    for q in range(6):
        for i in range(5):
            text = " ".join(" ".join(rnd.choices(words, k=rnd.choice([3, 8, 12, 60]))).capitalize() + "." for _ in range(8))
            rows.append((q, "cache index", 10 * q + i, text, float(5 - i)))
    df = spark.createDataFrame(rows, "query_id long, query string, item long, text string, score double")
    got = packing.brief(df, 60).collect()
    for q in range(6):
        scored = []
        for _, query, item, text, score in (r for r in rows if r[0] == q):
            found = [s for s in sentences(text) if len(s) >= 10]
            for n, s in enumerate(found):
                hits = len([t for t in query.split() if t in s.lower()]) / 2
                length = len(s.split())
                weight = (1.1 if n == 0 else 1.05 if n == len(found) - 1 else 1.0) * (0.3 if length < 5 else 0.6 if length > 50 else 1.0)
                scored.append((-(0.7 * score / 5.0 + 0.3 * hits) * weight, item, n, s))
        left, taken = 60, []
        for _, item, n, s in sorted(scored):
            if sum(x[0] == item for x in taken) < 3:
                if tokens_of(s) > left:
                    break
                left -= tokens_of(s)
                taken.append((item, n, s))
        assert [(r.item, r.sentence_no, r.sentence) for r in got if r.query_id == q] == sorted(taken)

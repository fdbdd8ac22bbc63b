"""Retrieval from question to passage against a plain rewrite of its steps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textlode.operators import retrieve
from textlode.operators.retrieve import Settings

CHUNK = "item long, document string, position int, collection string, text string, embedding array<double>"
QUERY = "query_id long, query string, vector array<double>, collection string"
ENTITY, MENTION = "entity string, type string, mentions long", "id long, entity string, terms array<string>"
WORDS = "nova orion red blue bolt ring gear box agent core".split()
S = Settings(top=4, multiplier=2, gate=1.2)


def world(seed=1, n=60):
    rng = random.Random(seed)
    unit = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rng.gauss(0, 1) for _ in range(3)])
    chunks = [(i, f"d{i // 6}", i % 6, f"c{i // 6 % 2}", " ".join(rng.choice(WORDS) for _ in range(12)), unit() if i % 11 else None) for i in range(n)]
    texts = ["red bolt", "nova", "person:nova", "rio", "", None, "zzz", "gear box agent core", "red", "blue ring", "  nova  "]
    queries = [(i, t, unit() if i % 4 != 3 else None, [None, "c0", "c1"][i % 3]) for i, t in enumerate(texts)]
    entities = [("nova", "person", 3), ("orion", "thing", 2), ("orion core", "thing", 9), ("red", "color", 1)]
    mentions = [(1, "nova", ["nova", "orion"]), (2, "nova", []), (3, "nova", ["ring", "orion"]), (4, "orion core", ["Orion core", "gear"]), (5, "nova", ["box"]), (6, "nova", ["core"])]
    return chunks, queries, entities, mentions


def plain(chunks, queries, entities, mentions, scores, s):
    tokens = lambda t: (t or "").lower().split()
    n_docs, mean = len(chunks), sum(len(tokens(c[4])) for c in chunks) / len(chunks)
    by_place = {(c[1], c[2]): c for c in chunks}
    out, summaries = {}, {}
    for q, text, vector, collection in queries:
        text = (text or "").strip(" ")
        if not text:
            summaries[q] = ("rejected:empty", 0, 0, 0.0)
            continue
        strategy, spoken, low = "dense", text, text.lower()
        if len(text.split()) <= 2:
            known = [e for e in entities if e[2] >= 2]
            stages = [[e for e in known if f"{e[1]}:{e[0]}" == low], [e for e in known if e[0].lower() == low], [e for e in known if low in e[0].lower()]]
            found = next((min(st, key=lambda e: (-e[2], e[0])) for st in stages if st), None)
            if found:
                said = [t for m in [m for m in sorted(mentions) if m[1] == found[0] and m[2]][:5] for t in m[2]]
                more = [t for t in dict.fromkeys(said) if t.lower() != low][:3]
                if more:
                    spoken, strategy = f"{text} {' '.join(more)}", strategy + "+entity_boost"
        inside = [c for c in chunks if collection in (None, c[3])]
        terms = list(dict.fromkeys(" ".join("".join(ch if ch.isalnum() else " " for ch in w).split()) for w in spoken.lower().split()))
        count = lambda c, t: sum(tokens(c[4])[i : i + len(t.split())] == t.split() for i in range(len(tokens(c[4]))))  # noqa: B023, E731
        df = {t: sum(count(c, t) > 0 for c in chunks) for t in terms}
        worded = []
        for c in inside:
            if all(count(c, t) for t in terms):
                idf = {t: max(math.log((n_docs - df[t] + 0.5) / (df[t] + 0.5)), 0) or 1e-6 for t in terms}
                worded.append((-round(sum(idf[t] * count(c, t) * 2.2 / (count(c, t) + 1.2 * (0.25 + 0.75 * len(tokens(c[4])) / mean)) for t in terms), 9), c[0]))
        words = [i for _, i in sorted(worded)[: s.candidates]]
        near = sorted((round(math.dist(vector, c[5]), 9), c[0]) for c in inside if vector and c[5])[: s.candidates]
        good = [x for x in near if x[0] < s.gate]
        strategy += "+hybrid" if words else ""
        fused = {}
        for ranked in ([i for _, i in good], words):
            for r, i in enumerate(ranked, 1):
                fused[i] = fused.get(i, 0) + 1 / (60 + r)
        order = sorted(fused, key=lambda i: (-round(fused[i], 12), i))[: s.candidates]
        kept, seen = [], set()
        for i in order:
            if i in seen:
                continue
            c = chunks[i]
            beside = [by_place[c[1], p] for p in range(max(0, c[2] - 1), c[2] + 2) if (c[1], p) in by_place]
            seen |= {i} | ({b[0] for b in beside} if len(beside) > 1 else set())
            kept.append((i, "\n\n".join(b[4] for b in beside), len(beside)))
        best, second = (good[0][0] if good else None), (good[1][0] if len(good) > 1 else None)
        clear = second is not None and best <= 0.8 and (best == 0 or second / best > 2)
        tried = scores is not None and len(kept) > 1 and not clear and bool(good)
        own = {i: scores[q, i] for i, *_ in kept if tried and (q, i) in scores}
        if own:
            rows = sorted(((-own[i], k, i, p, m) for k, (i, p, m) in enumerate(kept) if math.isfinite(own.get(i, math.nan)) and own[i] >= s.least_score))[: s.top]
            rows = [(i, p, m, -sc) for sc, _, i, p, m in rows]
            strategy += "+rerank"
        else:
            rows = [(i, p, m, 1.0 if tried else 1 - k / len(kept)) for k, (i, p, m) in enumerate(kept)][: s.top]
            strategy += "+rerank-fallback" if tried and rows else "+skip-rerank" if scores is not None and clear and len(rows) > 1 else ""
        out[q] = [(k, i, m, p, round(sc, 9)) for k, (i, p, m, sc) in enumerate(rows, 1)]
        factor = None if best is None else 0.8 if best < 0.5 else 0.5 if best < 0.8 else 0.3 if best < 1 else 0.1
        n, values = len(rows), sorted((r[3] for r in rows), reverse=True)
        if n == 0:
            sure = 0.0
        elif not own:
            sure = factor if factor is not None else 0.6 if n >= 5 else 0.5 if n >= 3 else 0.35
        elif n == 1:
            sure = factor or 0.5
        else:
            spread = values[0] - values[-1]
            share = 0.3 + (0.4 * (values[0] - values[1]) / spread if spread > 0 else 0) + 0.1 * (spread > 0.01) + 0.1 * (spread > 0.05) + 0.1 * (n >= 3)
            sure = min(1, 0.5 * (factor or 0.5) + 0.5 * min(1, share))
        summaries[q] = (strategy, len(order), n, round(sure, 9))
    return out, summaries


@pytest.mark.parametrize("scored", [False, True])
def test_against_plain_steps(spark, scored):
    chunks, queries, entities, mentions = world()
    rng = random.Random(5)
    scores = {(q, i): rng.choice([rng.random(), -0.5, math.nan]) for q in range(8) for i in range(60) if rng.random() < 0.8 and q != 2} if scored else None
    frame = spark.createDataFrame([(q, i, x) for (q, i), x in scores.items()], "query_id long, item long, score double") if scored else None
    made = [spark.createDataFrame(rows, schema) for rows, schema in ((queries, QUERY), (chunks, CHUNK), (entities, ENTITY), (mentions, MENTION))]
    got = retrieve.answer(*made, scores=frame, s=S)
    want, summaries = plain(chunks, queries, entities, mentions, scores, S)
    rows = {}
    for r in got.passages.orderBy("query_id", "place").collect():
        rows.setdefault(r.query_id, []).append((r.place, r["item"], r.parts, r.passage, round(r.score, 9)))
    assert rows == {q: p for q, p in want.items() if p}
    assert {r.query_id: (r.strategy, r.candidates, r.returned, round(r.confidence, 9)) for r in got.summary.collect()} == summaries


def test_absorbed_hits_drop_out(spark):
    hits = [(1, "a", 5), (2, "a", 6), (3, "a", 7), (4, "b", 6), (5, "a", 3), (6, "a", 4)]
    df = spark.createDataFrame([([dict(zip(("at", "document", "position"), h, strict=True)) for h in hits],)], "hits array<struct<at:int,document:string,position:int>>")
    kept = df.select(F.transform(retrieve.without_absorbed(F.col("hits")), lambda h: h["at"]).alias("k")).first().k
    assert kept == [1, 3, 4, 5]  # 2 and 6 stand in the passage of 1; 3 touches 2 only, which is gone


def test_titles_and_no_chunks(spark):
    chunks, queries, entities, mentions = world()
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    q, e, m = make(queries, QUERY), make(entities, ENTITY), make(mentions, MENTION)
    titles = retrieve.answer(q, make(chunks, CHUNK), e, m, s=S, titles=True)
    assert {r.parts for r in titles.passages.collect()} == {1}
    assert {r.confidence for r in titles.summary.filter("returned > 0").collect()} == {0.5}
    none = retrieve.answer(q, make([], CHUNK), e, m, s=S)
    assert none.passages.count() == 0 and {r.returned for r in none.summary.collect()} == {0}

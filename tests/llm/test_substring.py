import hashlib
import random
import re
from collections import Counter

import pytest

from textlode.llm import substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width):
    split = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts():
    rnd = random.Random(11)
    word = lambda: f"é{rnd.randrange(400)}"
    passage = [word() for _ in range(70)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, " ".join("a" for _ in range(100))), (4, " ".join(passage[:35])), (5, "\x0b".join(passage))]
    for k in range(60):
        words = [word() for _ in range(rnd.randrange(120))]
        if k % 3:
            at, a = rnd.randrange(len(words) + 1), rnd.randrange(20)
            words[at:at] = passage[a : a + rnd.randrange(20, 51)]
        rows.append((10 + k, rnd.choice([" ", "\n", "  "]).join(words)))
    rows += [(100, rows[20][1]), (101, rows[20][1] + " x"), (20, rows[20][1]), (20, rows[21][1]), (None, rows[22][1])]
    return rows + [(200, " ".join(word() for _ in range(20_000)))]


@pytest.mark.parametrize("width, run, hot", [(35, 12, 2000), (35, 12, 1), (10, 3, 2), (5, 5, 3)])
def test_against_brute_force(spark, width, run, hot):
    rows = texts()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int")
    got = sorted(map(tuple, substring.digests(docs, width, run, hot).collect()), key=repr)
    assert got == brute(rows, width)


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "a b c d x"), (2, "y a  b c d"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.dedup(docs, width=3, run=2).collect()}
    assert got == {1: "x", 2: "y", 3: ""}


def test_empty_table(spark):
    assert substring.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import math
import random
import re
from collections import Counter

import xxhash

from textlode.llm import quality

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def gram_buckets(words, buckets):
    """Spark's xxhash64 chains its columns: the hash so far seeds the next."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(hashes, hashes[1:])]
    return [signed(h) % buckets for h in hashes + pairs]


def ratios(raw, trusted, buckets):
    corpus = lambda b: (raw[b] + 1) / (raw.total() + buckets)
    mass = quality.PRIOR * buckets
    return lambda b: math.log((trusted[b] + mass * corpus(b)) / (trusted.total() + mass)) - math.log(corpus(b))


def brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rnd = random.Random(3)
    out = ["", None, " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "é|ü\nl\n\nl\n \n l", " a b"]
    for n in (5, 9, 30, 200, 3000):
        for v in (2, 5, 1000):
            out.append("".join(f"w{rnd.randrange(v)}{rnd.choice([' ', '  ', chr(10), chr(9)])}" for _ in range(n)))
    return out + out[3:8]


def test_against_brute_force(spark):
    rows = [(i, t, "other") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    good = [1, 5, 9, 12, 13, 20]
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(0, 24)] + [(None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels, least_score=0.0, buckets=64).collect()}
    raw, trusted = Counter(), Counter()
    for i, t, _ in rows:
        grams = gram_buckets(SPLIT.findall(t or ""), 64)
        raw.update(grams)
        if i in good:
            trusted.update(grams)
    ratio = ratios(raw, trusted, 64)
    for i, t, _ in rows:
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        grams = gram_buckets(SPLIT.findall(t or ""), 64)
        score = sum(map(ratio, grams)) / max(1, len(grams))
        assert abs(r.score - score) < 1e-6
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed
        assert r.kept == (not failed and score >= 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "word " + " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert [r.kept for r in quality.judge(one, labels).collect()] == [True]


def test_verdicts_on_labels_outside_the_fit(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    judged = quality.judge(docs, labels.filter(half == 0)).join(labels.filter(half == 1), "doc_id")
    kept = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.9 and kept[0] < 0.2

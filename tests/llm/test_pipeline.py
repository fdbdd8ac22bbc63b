import hashlib
import importlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_jaccard import brute as brute_groups  # noqa: E402
from test_quality import brute as brute_measures  # noqa: E402
from test_quality import gram_buckets, ratios  # noqa: E402

from textlode.llm import jaccard, pii, quality  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def judged(rows, trusted):
    raw, good, kept = Counter(), Counter(), []
    grams = {k: gram_buckets(WORD.findall(t or ""), quality.BUCKETS) for k, t, _ in rows}
    for k, _, _ in rows:
        raw.update(grams[k])
        if k in trusted:
            good.update(grams[k])
    ratio = ratios(raw, good, quality.BUCKETS)
    for k, t, source in rows:
        n, _, _, _, again = brute_measures(t)
        if n >= 20 and 100 * again <= 30 * n and sum(map(ratio, grams[k])) / (2 * n - 1) >= quality.LEAST_SCORE:
            kept.append((k, t, source))
    return kept


def mixed(rows):
    sizes = {k: len(WORD.findall(t)) for k, t, _ in rows}
    total = Counter()
    for k, _, s in rows:
        total[s] += sizes[k]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    targets, wanted, open_ = {}, 1.5 * sum(total.values()), set(total)
    while True:  # clamp, reshare, again
        level = (wanted - sum(targets.values())) / sum(weights[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weights[s] > 2 * total[s]}
        if not above:
            break
        targets |= {s: 2.0 * total[s] for s in above}
        open_ -= above
    targets |= {s: level * weights[s] for s in open_}
    out = []
    for s in total:
        whole, run = int(targets[s] // total[s]), 0
        for k, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            part = run + sizes[k] / 2 <= targets[s] - whole * total[s] and whole < 2
            run += sizes[k]
            out += [(k, t)] * (whole + part)
    return out


def test_pipeline_against_brute_force(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    kept = judged(rows, trusted)
    assert len(kept) > 0.7 * len(rows)
    near = {k for k, _, c in brute_groups([(k, t) for k, t, _ in kept], jaccard.Similarity(5, 8, 10)) if k == c}
    unique = spark.createDataFrame([r for r in kept if r[0] in near], "doc_id long, text string, source string")
    masked = [(r.doc_id, r.text, r.source) for r in pii.mask(unique).collect()]
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for k, t in mixed(masked):
        ids = theirs.encode(t, add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (2, None, None, None, None, None), (None, text + " y", "en", None, 0, "z"), (3, "", "de", "a", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for odd in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            found = stage(spark, odd, SF)
            assert found.columns == docs.columns
            found.collect()
        assert pipeline.tokens(spark, odd, SF).count() == odd.count()

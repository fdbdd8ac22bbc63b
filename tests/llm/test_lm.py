import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textlode.llm import lm

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


def segmentations(text, pieces, spelled):
    """Every segmentation, one by one."""
    if not text:
        return [0.0]
    out = []
    for k in range(1, len(text) + 1):
        ways = ([pieces[text[:k]]] if text[:k] in pieces else []) + ([sum(spelled[b] for b in text[0].encode())] if k == 1 else [])
        out += [w + rest for w in ways for rest in segmentations(text[k:], pieces, spelled)]
    return out


def test_marginal_is_the_sum_over_segmentations():
    pieces, spelled = lm.read_pieces(PATH)
    assert abs(sum(map(math.exp, [*pieces.values(), *spelled])) - 1) < 1e-6
    lattice = lm.Lattice(pieces, spelled)
    for word in ["the", "éa", "token", "日x", "x"]:
        want = math.log(math.fsum(map(math.exp, segmentations(lm.SPACE_MARK + word, pieces, spelled))))
        assert abs(lattice.log_probabilities([word])[0] - want) < 1e-9


def test_batches_agree_with_single_words():
    pieces, spelled = lm.read_pieces(PATH)
    one, many = lm.Lattice(pieces, spelled), lm.Lattice(pieces, spelled)
    words = ["the", "of", "idea", "éaéa", "日本", "a" * 30, "b" * 100, "tion", "thé", "😀"]
    learned = dict(zip(words, many.log_probabilities(words).tolist(), strict=True))
    sums, spelt, by_number = Counter(), Counter(), np.zeros(len(many.names))
    many.batch_expected([w for w in words if len(w) <= lm.SHORT], [3] * 9, by_number, spelt)
    for w in words:
        assert abs(learned[w] - one.forward(lm.SPACE_MARK + w)[-1]) < 1e-9
        if len(w) <= lm.SHORT:
            one.expected(w.encode(), 3, sums)
    for name, n in sums.items():
        got = spelt[name] if isinstance(name, int) else by_number[many.names.index(name)]
        assert abs(got - n) < 1e-6


@pytest.mark.parametrize("common", [3, 1000])
def test_base_score_against_brute_force(spark, common):
    texts = [None, "", "The the a b", "the  B c\nd é", "unseen words here the", "x " * 500, "the a", "the a"]
    rows = list(enumerate(texts)) + [(7, "the a"), (7, "other text"), (None, "a b zz")]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, score double")
    train = F.coalesce(F.col("doc_id") != 4, F.lit(False))
    got = lm.score(docs, train, PATH, rounds=1, common=common).collect()
    counts = Counter(w for k, t in rows if k is not None and k != 4 for w in tokens(t))
    n, v = counts.total(), len(counts)
    want = sorted(
        ((k, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in rows), key=repr
    )
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    # the score is the words' marginals, the number of words and the end; other than the pieces' weights, all is redone here
    pieces, spelled = fitted(Counter({w: c for w, c in counts.items() if w is not None}))
    ends = counts[None]
    go_on, stop = math.log1p(-(ends + 1) / (n + 2)), math.log((ends + 1) / (n + 2))
    sums = {w: math.log(math.fsum(map(math.exp, segmentations(lm.SPACE_MARK + w, pieces, spelled)))) for _, t in rows for w in tokens(t) if w}
    want = sorted(((k, round((sum(sums[w] + go_on for w in tokens(t)[:-1]) + stop) / math.log(10), 6)) for k, t in rows), key=repr)
    assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=repr) == want


def fitted(counts):
    """One round of expectation maximisation, by listing every segmentation of every word."""
    pieces, spelled = lm.read_pieces(PATH)
    sums = Counter()
    for word, n in counts.items():
        text = lm.SPACE_MARK + word
        ways = []

        def walk(at, used, weight, text=text, ways=ways):
            if at == len(text):
                ways.append((used, weight))
                return
            for k in range(at + 1, len(text) + 1):
                if text[at:k] in pieces:
                    walk(k, used + [text[at:k]], weight + pieces[text[at:k]])
            letters = list(text[at].encode())
            walk(at + 1, used + letters, weight + sum(spelled[b] for b in letters))

        walk(0, [], 0.0)
        total = math.fsum(math.exp(w) for _, w in ways)
        for used, w in ways:
            for name in used:
                sums[name] += n * math.exp(w) / total
    pseudo = lm.PSEUDO * sum(counts.values())
    new = {p: sums[p] + pseudo * math.exp(w) for p, w in pieces.items()}
    bytes_ = [sums[b] + pseudo * math.exp(w) for b, w in enumerate(spelled)]
    total = math.fsum([*new.values(), *bytes_])
    return {p: math.log(x / total) for p, x in new.items()}, [math.log(x / total) for x in bytes_]


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i % 50, -1.0) for i in range(1000)] + [("unseen", 0, -2.0)], "word string, n long, p double")
    for common in (0, 19, 20, 500, 5000):
        found = lm.frequent_words(counts, common)
        assert len(found) <= common and all(n >= 1 and p == -1.0 for n, p in found.values())
        rest = [1 + i % 50 for i in range(1000) if f"w{i}".encode() not in found]
        assert not found or not rest or min(found.values())[0] > max(rest)
    assert len(lm.frequent_words(counts, 5000)) == 1000


def test_a_very_long_word(spark):
    docs = spark.createDataFrame([(1, "ab" * 100_000 + " word"), (2, "word")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") == 2, PATH).collect()}
    assert got[1].n_tokens == 3 and got[1].score < 20 * got[2].score


def test_training_helps_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.col("doc_id") % 4 != 1
    held = lambda rounds: lm.score(docs, train, PATH, rounds=rounds).filter(~train).agg(F.sum("score")).first()[0]
    assert held(1) > held(0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, F.lit(True), PATH).count() == 0


def test_two_rounds_are_the_default_and_help_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.col("doc_id") % 4 != 1
    total = lambda **given: lm.score(docs, train, PATH, **given).filter(~train).agg(F.sum("score")).first()[0]
    one, two = total(rounds=1), total(rounds=2)
    print("held-out log10 likelihood at sf0.001, one round and two:", one, two)
    assert two > one and total() == pytest.approx(two, abs=1e-6)

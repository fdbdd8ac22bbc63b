from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlode.llm import counts

PATH = public_tokenizers.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)
STORED = counts.read_file(PATH)
LENGTHS = counts.Lengths({}, counts.Splitter(STORED))
TEXTS = [
    "", " ", "Hello,  World's 12 caféś don't", "ΣΑΣ Σ", "<|endoftext|> a<|startoftext|>B <|endoftex", "\x1c a\x85b c\x00", "日本語テキスト 🙂🙂",
    "a" * 5000, "İstanbul ǅ ß", "x\ty\nz" * 50, "'S 'LL we'Re", "é ́x", "\u1c89 \U00011bc0", " " * 300, "٣४ Ⅷ ½",
]


def same(text):
    assert LENGTHS.count(text) == len(THEIRS.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(text):
    same(text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


def test_every_code_point():
    """Alone between letters, a few hundred to a text; unassigned ones go to the library and are left out here."""
    splitter = LENGTHS.splitter
    points = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if not splitter.unknown.match(c)]
    points = [c for c in points if not 0xE000 <= ord(c) < 0xF800 and ord(c) < 0xF0000]
    texts = [" a".join(points[k : k + 400]) for k in range(0, len(points), 400)]
    want = [len(e.ids) for e in THEIRS.encode_batch(texts, add_special_tokens=False)]
    assert [LENGTHS.count(t) for t in texts] == want


def test_long_texts_are_split_at_spaces(monkeypatch):
    monkeypatch.setattr(counts, "PIECE", 20)
    for text in ["word " * 300, "x" * 500 + " y", "<|endoftext|> " * 40, " é" * 90, "no\nspaces\nat all" * 20, "ab cd" + " " * 100 + "ef"]:
        same(text)


def test_rows(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, None, 7), (1, " ", 8), (1, " ", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").repartition(3)
    want = Counter((k, len((t or "").encode()), len(THEIRS.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows)
    for table in (0, 3, counts.TABLE):
        assert Counter(tuple(r) for r in counts.token_counts(docs, PATH, table=table).collect()) == want


def test_empty_table(spark):
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_files_are_counted_by_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    theirs = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in counts.token_counts(docs, path).collect()} == {
        i: len(theirs.encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)
    }


def test_frequent_pieces_reach_the_table(spark):
    """A piece that a share of over 1 / table of all pieces makes up is never lost, however the rows are dealt."""
    rows = [(f"often w{i} x{i} y{i}",) for i in range(900)] + [("many many",)] * 300
    docs = spark.createDataFrame(rows, "text string").repartition(7)
    shared = spark.sparkContext.broadcast(counts.read_file(PATH))
    found = counts.frequent_lengths(docs, shared, "text", 20)
    assert len(found) <= 20 and {"often", "many"} <= set(found)


def test_query_over_its_table(spark):
    from textlode.llm.queries import op13_token_counts

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(THEIRS.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)

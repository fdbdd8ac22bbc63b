import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlode.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
CODEC = bpe.Codec(bpe.read_vocabulary(PATH))
THEIRS = Tokenizer.from_file(PATH)
TEXTS = [
    "", " ", "Hello,  World's 12 caféś don't", "ΣΑΣ Σ", "<|endoftext|> a<|startoftext|>B <|endoftex", "\x1c a\x85b c\x00",
    "日本語テキスト 🙂🙂", "a" * 5000, "İstanbul ǅ ß", "x\ty\nz" * 50, "'S 'LL we'Re",
]


def same(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    got = CODEC.encode(text).tolist()
    assert got == want
    assert CODEC.decode(got) == THEIRS.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_round_trip_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (1, " ", "y")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        ids = THEIRS.encode(t, add_special_tokens=False).ids
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert by[None].n_tokens == 0


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    ids = bpe.encode_column(docs, PATH)
    back = {r.doc_id: r.decoded for r in bpe.decode_column(ids, PATH).collect()}
    assert back == {1: "hello</w> world</w>", 2: ""}


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

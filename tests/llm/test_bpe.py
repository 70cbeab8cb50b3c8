import hashlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(bpe.codec(PATH).encode(text), "<u4").tolist()


def check(text):
    want = REFERENCE.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert bpe.codec(PATH).decode(np.array(want, "<u4")) == REFERENCE.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a", "aaaa" * 50, "hello  world \n\n x", "<|endoftext|>", "x<|endoftext|> y<|endo", "it's they'LL 123４５", " a b​c\x1c\x1d \x85q", "ééé 日本語 🙂🙂", "###$$$%%%&&&", " " * 300 + "\t" * 40, "\x00\x01", "==" * 90 + "=", "0" * 333])
def test_equals_the_library(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'se\n\t<|endoftx>=-é", max_size=80), st.text(alphabet="aet hin", max_size=120)))
def test_any_text(text):
    check(text)


def test_pieces_without_a_pretokenizer_cache():
    rng = np.random.default_rng(0)
    c = bpe.codec(PATH)
    for _ in range(300):
        word = "".join(rng.choice(list("etaonrishd"), rng.integers(1, 40)))
        assert c.encode_piece(word.encode()) == REFERENCE.encode(word, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\u00a0\u2003a\u00b2\u00bc7\u0660\u0301\u4e2d'_sé.\x1c", max_size=30))
def test_spaces_and_digits(text):
    check(text)


def test_frames(spark):
    rows = [(1, "hello there", "x"), (2, None, "x"), (None, "hello there", None), (1, "hello there", "x"), (5, "long " * 40000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip_digests(df, PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[2, 0].ids_sha256 == empty == out[2, 0].decoded_sha256
    assert len(bpe.round_trip_digests(df, PATH).collect()) == 5
    texts = sorted((r.text for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()), key=len)
    assert texts == sorted((t or "" for _, t, _ in rows), key=len)
    assert bpe.round_trip_digests(df.limit(0), PATH).collect() == []

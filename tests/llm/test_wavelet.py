import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyloom.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()


@pytest.mark.parametrize("n", [0, 1, 7, 5000, 300_001])
def test_shard_answers(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([2, 3, 5, 49407, 77, 1024], n).astype("<u4")
    shard = wavelet.Shard(wavelet.build(ids, [4, None], [n, 0], 1, 2, 16) + b"\n")
    assert np.array_equal(shard.ids(), ids)
    assert shard.documents()[0] == [4, None]
    for i in rng.integers(0, n, 20) if n else []:
        i = int(i)
        assert shard.access(i) == ids[i]
        assert shard.rank(int(ids[i]), i) == np.count_nonzero(ids[:i] == ids[i])
        assert shard.select(int(ids[i]), shard.rank(int(ids[i]), i)) == i
    assert shard.count(2) == np.count_nonzero(ids == 2)
    assert shard.count(9) == 0 == shard.count(1 << 20)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAΣσªİ,.ǅ\n\x1c\x85 é́<|endoftx>'s1", max_size=60)))
def test_chunks_equal_whole_texts(text):
    assert np.frombuffer(wavelet.word_encoder(PATH).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_files(spark):
    rows = [(i, f"word {i} " * (i % 7), "x") for i in range(300)] + [(None, "a b", "y"), (5, None, None), (5, "zz", "q"), (900, "long word " * 30000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    out = wavelet.read_documents(spark, wavelet.write(df, PATH, 2, shard_tokens=500)).collect()
    want, at = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert wavelet.read_documents(spark, wavelet.write(df.limit(0), PATH, 2)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAÉé,. \n'1٠ﬁªⅠ中", max_size=40), max_size=8))
def test_many_texts_at_once(texts):
    encoder = wavelet.WordEncoder(PATH) if not hasattr(test_many_texts_at_once, "e") else test_many_texts_at_once.e
    test_many_texts_at_once.e = encoder
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["İ.", "İx, aİ", "क़. क़", "ΑΣ, Σ.", "ﬁ. Å,", "a., b.. c,"])
def test_letters_that_normalize_to_more(text):
    assert np.frombuffer(wavelet.WordEncoder(PATH).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_stores_that_follow_each_other(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE", 20)
    encoder = wavelet.WordEncoder(PATH)
    texts = [f"some words, {'abcdefghij'[i % 10] * 3} here. {'klmno'[i % 5]}Q" for i in range(60)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_words_are_asked_for_together(monkeypatch):
    encoder, asked = wavelet.WordEncoder(PATH), []
    ask = encoder._ask
    monkeypatch.setattr(encoder, "_ask", lambda text: asked.append(text) or ask(text))
    odd = ["<|ENDOFTEXT|> <|endoftext|>", "a<|startoftext|>b <|", "J̌. ǰ, J̌1", "a B　c.", "\x1cA\x1d b\x0bC", " ", "", "don't'S -- it's... (É) ÀÖ!? ×÷ KÅ."]
    texts = [*odd, *(f"é{i}à, 中{i}. Word{i}" for i in range(500)), *odd]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == want
    assert len(asked) < 10
    asked.clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == want and not asked


def test_pieces_of_a_column_that_is_a_slice():
    texts = pa.array(["x" * n for n in (9, 1, 0, 50, 2, 3, 4)]).slice(1)
    assert [p.to_pylist() for p in wavelet._pieces(texts, 5)] == [["x", ""], ["x" * 50], ["xx", "xxx"], ["xxxx"]]
    ids, ends = wavelet.word_encoder(PATH).encode_column(pa.array(["a b", "A, b", "", "c"]).slice(1))
    assert ends.tolist() == [3, 3, 4] and ids.tolist() == LIBRARY.encode("a, b c", add_special_tokens=False).ids

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import decontaminate as D
from skyloom.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items):
    """Hit places of words, and the items with occurring windows."""
    own, hit, who = words(text), set(), set()
    for item, said in items:
        w = words(said)
        k = min(len(w), D.WINDOW)
        for j in range(len(w) - k + 1) if w else []:
            for i in range(len(own) - k + 1):
                if own[i:i + k] == w[j:j + k]:
                    hit |= set(range(i, i + k))
                    who.add(item)
    return len(own), hit, who - {None}


def scan(texts, items, size=W.PIECE):
    known = D.WindowSet([(i, " ".join(words(t))) for i, t in items if words(t)])
    counts, (first, last, start, end, text), who = D.scanned_texts(known, W.Hashes(), pa.array(texts, pa.string()), size)
    out = []
    for k, t in enumerate(texts):
        hit = set()
        for a, b, x, y, of in zip(first, last, start, end, text, strict=True):
            if of == k:
                assert not hit & set(range(a, b))
                hit |= set(range(a, b))
                assert words(t.encode()[x:y].decode()) == words(t)[a:b]
        out.append((counts[k], hit, {known.ids[c] for d, c in who if d == k}))
    return out


LIKELY = st.lists(st.sampled_from(["a", "B", "ab", "é", "1", "aa"]), max_size=30).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(LIKELY | st.text(alphabet="aB é.1\n", max_size=60), max_size=5), st.lists(LIKELY, max_size=5), st.integers(1, 20))
def test_scan_equals_brute_force(texts, said, size):
    items = [(f"i{k % 3}" if k else None, t) for k, t in enumerate(said)]
    assert scan(texts, items, size) == [brute(t, items) for t in texts]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that all words share, only the comparison of bytes decides."""
    monkeypatch.setattr(W.Hashes, "of", lambda self, folded, starts, ends: starts.astype("uint64") * 0 + W._U(7))
    items = [("x", "one two three"), ("y", "one two four"), ("z", "five")]
    assert scan(["five one two four one two three", "one two", ""], items) == [brute(t, items) for t in ["five one two four one two three", "one two", ""]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab.", max_size=12), min_size=1, max_size=6), st.integers(1, 9))
def test_pieces_and_bounds(texts, size):
    data, at = W.utf8(pa.array(texts))
    found = []
    for begin, end in W.pieces(data, at, D._FOLDING, size):
        s, e = W.bounds(D._FOLDING[data[begin:end]], begin, at)
        found += [bytes(data[begin + a:begin + b]).decode() for a, b in zip(s, e, strict=True)]
    assert found == [w for t in texts for w in words(t)]


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 16)
    monkeypatch.setattr(W, "LONG_WORD", 8)
    text = "abc abcabcabcabc abc ab abcabcabcabc c abc xyzxyzxyz xyzxyzxyz"
    data, at = W.utf8(pa.array([text]))
    s, e = W.bounds(D._FOLDING[data], 0, at)
    h = W.Hashes().of(D._FOLDING[data], s, e)
    by = {}
    for w, x in zip(text.split(), h.tolist(), strict=True):
        by.setdefault(w, set()).add(x)
    assert all(len(x) == 1 for x in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def test_very_long_text():
    """20 MB: a window at the very end, one over each border of pieces, and one word of 3 MB."""
    items = [("far", "zero one two three four five six seven eight nine ten")]
    text = "x" * 3_000_000 + " " + ("filler words here " * 20 + items[0][1] + " ") * 40_000
    known = D.WindowSet(items)
    counts, (first, last, _, end, of), who = D.scanned_texts(known, W.Hashes(), pa.array([text, None, items[0][1]], pa.string()))
    assert counts.tolist() == [1 + 40_000 * 71, 0, 11] and len(first) == 40_001 and set(last - first) == {11} and end[of == 0].max() == len(text) - 1
    assert who.tolist() == [[0, 0], [2, 0]]


@pytest.fixture(scope="module")
def tables(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([
        (1, f"before {item.upper()} after", "x", [1]), (1, f"before {item.upper()} after", "x", [1]), (None, "one short item", "y", None), (2, None, None, None), (3, "", "z", None),
        (4, "... !!", None, None), (5, "alpha beta gamma delta epsilon zeta eta theta iota", None, None), (6, item + " " + item, None, None), (7, "clean text of its own", None, None),
    ], "doc_id long, text string, items string, runs array<int>")
    bench = spark.createDataFrame([(2, item), (10, item), (10, item), (None, "one short item"), (3, None), (4, ""), (5, "short item")], "item_id long, text string")
    return docs, bench


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 40])
def test_digests(spark, tables, block_bytes):
    docs, bench = tables
    got = sorted(tuple(r) for r in D.digests(docs, bench, block_bytes).na.fill(0).collect())
    items = [(None if r.item_id is None else str(r.item_id), r.text) for r in bench.collect()]
    want = []
    for r in docs.collect():
        n, hit, who = brute(r.text, items)
        want.append((r.doc_id or 0, n, len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)


def test_removal(spark, tables):
    docs, bench = tables
    spans = D.decontaminated(docs, bench)
    assert spans.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in spans.collect()) == sorted([(1, "before  after"), (1, "before  after"), (0, ""), (2, ""), (3, ""), (4, "... !!"), (5, "alpha beta gamma delta epsilon zeta eta theta iota"), (6, " "), (7, "clean text of its own")])
    kept = D.decontaminated(docs, bench, "documents")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7]
    with pytest.raises(ValueError):
        D.decontaminated(docs, bench, "words")


def test_empty_tables(spark, tables):
    docs, bench = tables
    assert D.digests(docs.limit(0), bench).count() == 0
    assert D.digests(docs, bench.limit(0)).where("contaminated or n_items > 0 or n_hit > 0").count() == 0
    assert D.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_long_items_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_WORDS", 7)
    said = " ".join(f"w{k}" for k in range(40))
    parts = [r.words.split() for r in D.benchmark_parts(spark.createDataFrame([("a", said)], "item_id string, text string")).orderBy("part").collect()]
    windows = lambda w: {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    assert set().union(*map(windows, parts)) == windows(said.split()) and all(len(p) >= 10 for p in parts)

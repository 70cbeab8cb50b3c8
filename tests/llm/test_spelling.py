import random
import zlib
from collections import Counter

import pytest

from skyloom.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    out, form = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [form[w], None, n, len(others), counts[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return sorted((w, *v) for w, v in out.items())


def some_words():
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(500)} | {"a" * k for k in range(6, 20)}
    return {w: rng.choice([5, 6, 30, 31, 200, 1100, 6000]) for w in words}


@pytest.mark.parametrize("shared", [0, 3, 1 << 30])
def test_pairs_equal_brute_force(spark, shared):
    words = list(some_words())
    got = [frozenset((r.a, r.b)) for r in S.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), shared).collect()]
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_variants_equal_brute_force(spark):
    counts = some_words()
    got = sorted(tuple(r) for r in S.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect())
    assert got == brute(counts)
    assert any(r[2] != r[1] and r[1] is not None for r in got)  # a chain of two links at least


def test_documents(spark):
    rng = random.Random(9)
    texts = [(k if k % 7 else None, " ".join(rng.choice(["Colour", "colours", "COLOR", "grüße", "größer", "naïve-ness", "straße", "don't", "x×y÷zabc", "abcdefĀghijkl", "short"]) + rng.choice(["", ",", "1"]) for _ in range(40))) for k in range(60)]
    texts += [(1, None), (2, ""), (3, "!!"), *[(5, "repeated repeated")] * 4]
    docs = spark.createDataFrame([(i, t, "w", 2) for i, t in texts], "doc_id long, text string, word string, n int").repartition(3)
    counts = Counter()
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}
    for i, t in texts:
        for run in "".join(c if c in letters else " " for c in t or "").split():
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert sorted(tuple(r) for r in S.grouped(docs).collect()) == want and len(want) > 5


def test_nothing(spark):
    assert S.grouped(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = S.grouped(spark.createDataFrame([(1, "lonely lonely lonely lonely lonely " * 3)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in alone] == [("lonely", None, "lonely", 15, 0, None)]


def test_very_long_text_and_word(spark):
    rows = [(1, "wonderful " * 500_000 + "w" * 200_000), *[(2, "wonderfull " + "w" * 200_000)] * 5]
    got = {r.word[:12]: r for r in S.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["wonderfull"].form == "wonderful" and got["w" * 12].n == 6 and got["w" * 12].n_near == 0

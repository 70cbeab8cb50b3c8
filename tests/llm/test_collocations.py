import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        dropped = set()
        for q, a in found.items():
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q) and 100 * a >= 100 * found[q[i:j]]:
                        dropped.add(q[i:j])
        rank = []
        for p, a in found.items():
            if p not in dropped:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rank.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for k, (s, a, p, left, right) in enumerate(sorted(rank)[:first]):
            out.append((lang, k + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "The", "new", "york", "city", "é", "x\x01", "x", "a b", "hall"]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", None, "und", "fr", ""]), text + rng.choice(["", " new york city hall", "x x x x x x"])))
    return [*rows, ("en", None), (None, ""), ("fr", " .,; "), *[("en", "all rights are reserved by us")] * 9]


@pytest.mark.parametrize("hot", [50_000, 5])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT_LEAST", hot)
    rows = corpus()
    docs = spark.createDataFrame([(lang, text, "y", 1) for lang, text in rows], "lang string, text string, phrase string, a int").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(docs, least=4).collect())
    assert got == brute(rows, 4) and len(got) > 50
    assert sorted(tuple(r) for r in C.collocations(docs, least=4, first=3).collect()) == brute(rows, 4, 3)


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("en", "too rare")], "lang string, text string")).collect() == []


@pytest.mark.parametrize("size", [3, 17, 200, 1 << 20])
def test_pieces_change_no_count(size):
    rows = [(lang or "und", text or "") for lang, text in corpus()]
    batch = pa.RecordBatch.from_pydict({"_text": [t for _, t in rows], "_lang": [x for x, _ in rows]})
    got, said = Counter(), Counter()
    for ids, spelled, langs, follows, upto in C._Part(batch).walk(4, size):
        names, words = langs.to_pylist(), spelled.to_pylist()
        for i in range(upto):
            said[names[ids[i]], words[ids[i]]] += 1
            for k in range(1, 5):
                if i + k >= len(ids) or not follows[i + k]:
                    break
                got[names[ids[i]], tuple(words[x] for x in ids[i:i + k + 1])] += 1
    want, singles = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            singles.update((lang, x) for x in w)
            want.update((lang, tuple(w[i:i + k])) for k in range(2, 6) for i in range(len(w) - k + 1))
    assert got == want and said == singles


def test_filter_holds_all_and_little_else(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    f = C.Filter(spark.createDataFrame([(int(x),) for x in h] + [(0,), (-1,)], "h long"), "h")
    assert f.has(h.view(np.uint64)).all() and f.has(np.array([0, (1 << 64) - 1], np.uint64)).all()
    assert f.has(rng.integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.1


def test_hashes_are_those_of_spark(spark):
    words = ["a", "é", "word" * 20, "x\x01"]
    got = C._hashes(pa.array(words), pa.array(["en", "", "fr", "und"])).view(np.int64).tolist()
    rows = spark.createDataFrame(list(zip(["en", "", "fr", "und"], words, strict=True)), "lang string, word string")
    assert [r.h for r in rows.select(C.word_hash("lang", "word").alias("h")).collect()] == got


def test_products_beyond_64_bits(spark):
    big = 10**15
    phrases = spark.createDataFrame([("en", "a b", 7 * big)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "a", 8 * big), ("en", "b", 9 * big), ("en", "", 99 * big)], "lang string, word string, f long")
    assert C.scored(phrases, words).first().score == 1000 * 7 * 99 // 72

import pathlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import common, neardup


def shingles(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    out = defaultdict(int)
    for i in range(max(1, len(words) - 4)) if words else []:
        out[tuple(words[i:i + 5])] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t", max_size=40), min_size=1, max_size=6))
def test_shingles_equal_brute_force(texts):
    s = neardup.Shingled(texts)
    for i, t in enumerate(texts):
        want = shingles(t)
        assert sorted(s.count[s.first[i]:s.first[i + 1]].tolist()) == sorted(want.values())
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert set(s.key[s.first[i]:s.first[i + 1]].tolist()).isdisjoint(s.key[s.first[j]:s.first[j + 1]].tolist()) == set(shingles(a)).isdisjoint(shingles(b))
            same = [x for x in a.replace("\t", " ").replace("\n", " ").split(" ") if x] == [x for x in b.replace("\t", " ").replace("\n", " ").split(" ") if x]
            assert ((s.text_keys[0][i], s.text_keys[1][i]) == (s.text_keys[0][j], s.text_keys[1][j])) == same


def test_samples_agree_as_often_as_similarity():
    rng = np.random.default_rng(5)
    weight = np.linspace(0.75, 1, neardup.SKETCH).astype(np.float32)
    for n in (60, 900):
        hits = total = 0
        want = []
        for _ in range(60):
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
            other = list(words)
            for at in rng.choice(n, max(1, n // 45), replace=False):
                other[at] = "x"
            s = neardup.Shingled([" ".join(words), " ".join(other)])
            w = weight[neardup._counters(s.key)] * s.count
            one, two = (slice(s.first[i], s.first[i + 1]) for i in (0, 1))
            want.append(neardup.similarity((s.key[one], w[one]), (s.key[two], w[two])))
            a, b = neardup.signatures(s, weight, neardup.plan_for(0.8))
            hits += len(set(a) & set(b))
            total += max(len(a), len(b))
        assert abs(hits / total - np.mean(np.array(want) ** neardup.ROWS)) < 0.08


def test_long_texts_of_few_shingles_share_bands():
    """A word repeated; and a few shingles that carry most of a text whose other shingles are its own."""
    weight = np.ones(neardup.SKETCH, np.float32)
    rng = np.random.default_rng(3)
    hits = total = 0
    for i in range(40):
        lines = " ".join(" ".join([f"w{i}-{k}"] * 104) for k in range(10))
        own = " ".join(f"o{x}" for x in rng.integers(0, 1 << 40, 200))
        for a, b in ((" ".join([f"v{i}"] * 1004), " ".join([f"v{i}"] * 854)), (lines, lines + " " + own)):
            a, b = neardup.signatures(neardup.Shingled([a, b]), weight, neardup.plan_for(0.8))
            assert set(a) & set(b)
            hits, total = hits + len(set(a) & set(b)), total + neardup.BANDS
    assert abs(hits / total - 0.85**neardup.ROWS) < 0.05


def brute(rows, threshold=0.8):
    """Components of links between texts of enough similarity, with the idf of rare shingles only if none is common."""
    texts = {d: neardup_vector(t or "") for d, t in rows}
    parent = {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = texts[a], texts[b]
            keys = set(x) | set(y)
            shared, every = sum(min(x[k], y[k]) for k in keys), sum(max(x[k], y[k]) for k in keys)
            if (every == 0) or shared / every >= threshold:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def neardup_vector(text):
    return shingles(text)


def test_classes_equal_brute_force(spark, monkeypatch):
    # With equal weights the brute force needs no document frequencies.
    monkeypatch.setattr(neardup, "DAMPING", 0.0)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for group in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 150, 190, 260, 700]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(15):
        rows.append((n, " ".join(word() for _ in range(40)) + "\n" + passage))
        n += 1
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one two"), (1004, "one  two"), (1005, "one two three"), (1006, "long words here " * 20000)]
    df = spark.createDataFrame([(*r, 7) for r in rows] + [(3, rows[3][1], 7), (None, "x", 7)], "doc_id long, text string, class_id int").repartition(5)
    out = neardup.classes(df).collect()
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert len(out) == len(want) + 1 and {d: c for d, c in got.items() if c != want[d]} == {}
    assert neardup.classes(df.limit(0)).collect() == []


def test_large_group_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[(i * 7) % 300] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"q{i}-{k}" for k in range(120))) for i in range(50)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(50))


def test_spread_group_equals_brute_force(spark, monkeypatch):
    """Copies with few and with many changes: some buckets stay open, and are compared as pairs and as blocks."""
    monkeypatch.setattr(neardup, "DAMPING", 0.0)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(150)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for small, sides in ((32, (256, 512)), (2, (16, 24)), (1000, (1, 1))):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "SIDES", sides)
        assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in used}


def test_components_of_nodes_with_two_roots(spark):
    """After one round of this path no root has a root, but nodes hang on two of them."""
    edges = [(3, 4), (4, 6), (6, 9), (7, 9), (2, 7)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys((2, 3, 4, 6, 7, 9), 2)


def weighted_brute(rows, threshold):
    """Classes by damped idf from exact document frequencies, and how near any pair comes to the threshold."""
    grams = {d: shingles(t) for d, t in rows}
    df = defaultdict(int)
    for g in grams.values():
        for k in g:
            df[k] += 1
    log_rare = np.log(neardup.RARE)
    weight = {k: 1 - neardup.DAMPING * (1 - np.log(max(n / len(rows), neardup.RARE)) / log_rare) for k, n in df.items()}
    root = {d: d for d in grams}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids, margin = sorted(grams), 1.0
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = grams[a], grams[b]
            shared = sum(min(x[k], y[k]) * weight[k] for k in x.keys() & y.keys())
            every = sum(n * weight[k] for k, n in x.items()) + sum(n * weight[k] for k, n in y.items()) - shared
            margin = min(margin, abs(shared / every - threshold))
            if shared / every >= threshold:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in ids}, margin


def test_damped_idf_and_other_thresholds_equal_brute_force(spark):
    """With the weights of real use, texts short and long, a passage that most documents share, and thresholds of 0.6, 0.8 and 0.9."""
    for threshold, seed in ((0.8, 1), (0.6, 2), (0.9, 3)):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))  # noqa: B023, E731
        passage = [word() for _ in range(40)]
        rows = []
        for _ in range(30):
            base = [word() for _ in range(rng.choice([60, 110, 180, 230, 500]))]
            for _ in range(rng.choice([1, 2, 4])):
                copy = list(base)
                for _ in range(int(rng.choice([0, 0.2, 0.5, 0.75, 1.6, 2.5]) * (1 - threshold) * len(base) / 10)):
                    copy[rng.randrange(len(copy))] = word()
                rows.append((len(rows), " ".join(copy + (passage if rng.random() < 0.7 else []))))
        want, margin = weighted_brute(rows, threshold)
        got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()}
        assert len(set(want.values())) < len(want) and margin > 1e-5
        assert got == want
    for wrong in (0.3, 1.2):
        with pytest.raises(ValueError, match="thresholds"):
            neardup.plan_for(wrong)


def test_few_documents_are_few_files(spark, monkeypatch):
    """Hundreds of partitions with a few rows each are not as many files, in any step."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    folders, scratch = [], common.scratch
    monkeypatch.setattr(common, "scratch", lambda *a: folders.append(scratch(*a)) or folders[-1])
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(60)]
    rows = [(k * 100 + i, " ".join([*t[:i], "x", *t[i + 1:]])) for k, t in enumerate(texts) for i in (0, 57, 58)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
        got = {r.doc_id: r.class_id for r in out.collect()}
        assert out.rdd.getNumPartitions() <= 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {k: k // 100 * 100 for k, _ in rows}
    assert len(folders) > 5 and all(len(list(pathlib.Path(f).glob("part-*"))) <= 2 for f in folders)

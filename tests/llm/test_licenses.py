import json
import math
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from skyloom.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def families(spark, model, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    return {r.doc_id: [x.family for x in r.found] for r in licenses.scan(df, model).collect()}


def test_templates_and_variants(spark, model):
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    want = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    got = families(spark, model, texts)
    assert sum(got[i] == [f] for i, f in enumerate(want)) >= len(want) - 1
    got = families(spark, model, ["LICENSED UNDER THE MIT LICENSE", "some words\nReleased under the MIT License.\nmore words", None, "", " \n\n", "nothing to see here", "Licensed under the Foo Bar Terms 9.1."])
    assert got[0] == ["mit"] and got[1] == ["mit"] and got[2] == got[3] == got[4] == got[5] == []
    assert got[6] == [licenses.UNKNOWN]


def test_corpus(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = {"apache-2.0": "Apache License, Version 2.0", "mit": "MIT License", "gpl-3.0": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4.0"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.report(docs).collect():
        assert r.licenses == ",".join(sorted(f for f, m in marks.items() if m in texts[r.doc_id]))
        assert r.n_unknown == 0 or re.search("licen", texts[r.doc_id], re.I)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "Released under the MIT License.", 3), (2, "word " * 300000 + "\nReleased under the MIT License.", 3), (2, "x", 3), (2, "x", 3)], "doc_id long, text string, confidence int")
    out = sorted((r.doc_id or 0, r.licenses) for r in licenses.report(df).collect())
    assert out == [(0, "mit"), (1, ""), (2, ""), (2, ""), (2, "mit")]
    assert licenses.report(df.limit(0)).collect() == []


def test_wrapped_notices(spark, model):
    """Notices in lines of 60 to 78 columns, with and without comment marks, are found; their neighbours stay what they are."""
    notices = [("gpl-3.0", licenses.TEMPLATES["gpl-3.0"][2]), ("bsd", licenses.TEMPLATES["bsd"][3]), ("mit", licenses.TEMPLATES["mit"][3]), ("apache-2.0", licenses.TEMPLATES["apache-2.0"][2])]
    want, texts = [], []
    for family, notice in notices:
        for width, mark in ((60, ""), (72, "# "), (78, " * ")):
            body = "\n".join(mark + line for line in textwrap.wrap(notice, width))
            texts.append(f"{mark}some words here\n{mark.rstrip()}\n{body}\n{mark.rstrip()}\nother words")
            want.append(family)
    got = families(spark, model, [*texts, "Released under the MIT License.\nUse of this product is subject to the terms of the end user license agreement."])
    known = {i: sorted({f for f in fs if f != licenses.UNKNOWN}) for i, fs in got.items()}
    assert known == {**{i: [f] for i, f in enumerate(want)}, len(want): ["mit"]}


def scored(model, text):
    """Family by adding up the weights of a paragraph's words and pairs of words, one by one."""
    words = [w for w in re.split(r"(?:[^\w.]|_|\.(?!\d)|(?<!\d)\.)+", text.lower()) if w]
    weights = {e["g"]: e["w"] for slot in json.loads(model.slots) for e in slot}
    sums = list(model.start)
    for g in {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}:
        sums = [a + b for a, b in zip(sums, weights.get(g, [0.0] * len(sums)), strict=True)]
    top = max(sums)
    powers = [math.exp((x - top) / model.temperature) for x in sums]
    p = [x / sum(powers) for x in powers]
    best = max(range(len(p) - 2), key=lambda i: (p[i], -i))
    agree = max((len(set(t) & set(words)) / len(t) for t in json.loads(model.templates)[best]), default=0)
    if p[best] >= licenses.SURE and agree >= licenses.CONFIRM:
        return model.families[best], p[best]
    return (licenses.NONE, p[-1]) if p[-1] >= max(p[best], p[-2]) else (licenses.UNKNOWN, 1 - p[-1])


def test_scores_by_hand(spark, model):
    rng = random.Random(4)
    texts = [t for t, _, _ in licenses.training_rows()][::7] + ["plain words of no kind", "the license of software", *licenses.ORDINARY]
    texts += [" ".join(rng.choices(rng.choice(texts).split(" "), k=8)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", licenses.classified(licenses.words_of(F.col("t")), model).alias("c"))
    for r in df.collect():
        family, sure = scored(model, texts[r.i])
        assert r.c.family == family and abs(r.c.confidence - sure) < 1e-9, texts[r.i]


def test_lines_without_features_are_ordinary(spark, model):
    assert model.cues and scored(model, "zzz qqq")[0] == licenses.NONE
    every = licenses.Model(**{**model.__dict__, "cues": []})
    texts = ["nothing here\nReleased under the MIT License.\nmore", "words only", "Licensed under the Foo Bar Terms 9.1."]
    assert families(spark, every, texts) == families(spark, model, texts)

import zlib
from collections import Counter

import numpy as np

from skyloom.llm import langid

LEARNED = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 3 != 1)


def test_ngrams_by_hand():
    hashes, starts = langid.ngrams(["The the", "", "x 1", "of"])
    assert np.diff(starts).tolist() == [4, 0, 0, 1]  # " the", "the " twice; " of "
    assert len(set(hashes[:4].tolist())) == 2


def test_filter_has_no_false_negative():
    samples = {"a": ["alpha beta gamma " * 5], "b": ["delta epsilon beta " * 5]}
    model = langid.fit(samples)
    for i, lang in enumerate(model.languages):
        masks = model.masks(langid.ngrams(samples[lang])[0])
        assert np.all(masks >> np.uint64(i) & np.uint64(1))


def test_many_languages():
    rng = np.random.default_rng(1)
    words = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)] for i in range(70)}
    model = langid.fit({k: [" ".join(w)] * 4 for k, w in words.items()})
    assert [model.predict([" ".join(w[:20])])[0][0] for w in words.values()] == list(words)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.learning_rows(docs))
    out = langid.predictions(docs.where(langid.held_out(docs.doc_id)), model).join(docs, "doc_id").toPandas()
    assert len(out) > 250 and (out.lang == out.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "123 !", "en", 1.0), (None, "hello there", None, 1.0), (LEARNED, "hello hello hello hello", "en", 2.0), (LEARNED, "hello hello hello hello", "en", 2.0), (5, "ab " * 400000, "en", 0.0)], "doc_id long, text string, lang string, score double")
    model = langid.train(langid.learning_rows(df))
    out = {r.doc_id: r for r in langid.predictions(df, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, LEARNED, None, 5)] == ["und", "und", "und", "en", "en", "en"]
    assert langid.predictions(df.limit(0), model).collect() == []
    assert langid.predictions(df, langid.train(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_each_of_many_languages_is_learned(spark, monkeypatch):
    """With more languages than the sample has room for, each gives fewer documents; the rarest beyond LANGUAGES are not learned."""
    monkeypatch.setattr(langid, "MOST", 120)
    monkeypatch.setattr(langid, "LANGUAGES", 20)
    rows = [(i, f"word{chr(97 + i % 25) * 4} " * 6 + str(i), f"l{i % 25:02d}") for i in range(25 * 40 + 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{i:02d}" for i in range(20)]


def exact(samples, text):
    """Each language's n-grams of a text by sets instead of filters."""
    def grams(t):
        return langid.ngrams([t])[0].tolist()

    seen = {lang: Counter(g for t in ts for g in grams(t)) for lang, ts in samples.items()}
    total = {lang: max(1, sum(c.values())) for lang, c in seen.items()}
    most = {g: max(c[g] / total[lang] for lang, c in seen.items()) for c in seen.values() for g in c}
    held = {lang: {g for g, n in c.items() if n >= langid.LEAST_SEEN and n / total[lang] >= langid.LEAST_SHARE * most[g]} for lang, c in seen.items()}
    own = grams(text)
    return {lang: sum(g in h for g in own) for lang, h in held.items()}


def test_counts_equal_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null").toPandas()
    samples = {lang: g.text.tolist()[:40] for lang, g in docs.groupby("lang")}
    model = langid.fit(samples)
    texts = [t for t in docs.text.tolist() if len(t) > 40][:120]
    _, found = model.counts(texts)
    for t, row, (lang, _) in zip(texts, found, model.predict(texts), strict=True):
        want = exact(samples, t)
        n = len(langid.ngrams([t])[0])
        assert all(abs(row[i] - want[name]) <= 0.02 * n + 6 for i, name in enumerate(model.languages))
        best = sorted(want.values())
        if len(best) < 2 or best[-1] - best[-2] > 0.04 * n + 12:
            assert lang == max(want, key=want.get)

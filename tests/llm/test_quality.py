import math
import random
import re

from skyloom.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_by_hand(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x\nx\n \n \nx y", "a " * 30, "one\x0btwo\x0cthree\x85four five <|> é#", "long word here now then again " * 3000]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n"]) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, None, None, 1)], "doc_id long, text string, lang string, kept int")
    out = {r.doc_id: r for r in quality.judged(df).collect()}
    for i, t in enumerate([*texts]):
        assert tuple(out[i][c] for c in COLUMNS) == brute(t), t
    assert out[None].kept is False and len(out) == len(df.collect())
    assert quality.judged(df.limit(0)).collect() == []


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.judged(docs).join(docs, "doc_id").toPandas()
    for r in out.itertuples():
        assert tuple(getattr(r, c) for c in COLUMNS) == brute(r.text)
    clean = out[~out.base_failed & (out.n_symbols == 0)]
    assert clean.kept.mean() > 0.98
    noisy = out[~out.base_failed & (out.n_symbols > 0.1 * out.word_chars) & (out.n_words > 60)]
    assert len(noisy) > 10 and noisy.kept.mean() < 0.1


def test_distance_by_hand(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality._distance(F.array(F.lit(2.0), F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.25), F.lit(0.25), F.lit(0.5)))).first()[0]
    p, q = [0.5, 0.5, 0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_small_and_null_languages_equal_sql(spark, tmp_path):
    """Documents of no language, or of one with few words, are held against all documents, as the SQL says."""
    import duckdb

    from skyloom.llm import oracles

    rng = random.Random(8)
    prose = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(rng.randint(20, 200), "etaoinshr"), "en") for i in range(60)] + [(100 + i, prose(150, "àéîoçbdfg"), "xx") for i in range(3)]
    rows += [(200 + i, prose(120, "etaoin"), None) for i in range(10)] + [(300, "9 8 7 6 " * 3 + prose(30, "123456"), None), (301, prose(150, "()!?;:"), "xx"), (302, None, None), (303, prose(140, "etaoin"), "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(f"SELECT doc_id, base_failed, kept FROM ({oracles.OP3})").fetchall()}
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == want and got[200][1] and not got[300][1] and not got[301][1]

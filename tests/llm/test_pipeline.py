import random

import corpus_pipeline
from skyloom.llm import bpe, mixing, neardup, quality


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n)) + "."


def documents(spark):
    rng = random.Random(9)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(60)]
    rows = [(i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i] if i % 2 else base[i].replace(" the ", " a ", 1), "en", "src3", 1) for i in range(20)]
    rows += [(200, None, "en", "src1", 0), (201, "", None, None, None), (202, "one two", "en", "src1", 7), (203, "same words " * 200, "en", "src2", 5), (0, base[0], "en", "src0", len(base[0])), (None, base[1], "en", "src1", 3), (204, prose(rng, 30_000), "en", "src4", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    rows, docs = documents(spark)
    columns = corpus_pipeline.COLUMNS
    texts = {r[0]: r[1] for r in rows}
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at.collect()
        if name != "bpe":
            assert at.columns == columns
    assert {r.doc_id for r in seen["quality"]} == {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert not {200, 201, 202, 203} & {r.doc_id for r in seen["quality"]}
    assert {r.doc_id for r in seen["language"]} == {r.doc_id for r in seen["quality"]}
    kept = [r.doc_id for r in seen["neardup"] if r.doc_id is not None]
    assert len(kept) == len(set(kept)) and not {100 + i for i in range(20)} & set(kept) and set(range(60)) <= set(kept)
    before = spark.read.parquet(str(tmp_path / "neardup"))
    copies = {(r.doc_id): r.copies for r in mixing.mixed(before, mixing.STANDARD).collect()}
    got = {}
    for r in seen["mixing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert got == copies
    codec = bpe.codec(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in seen["bpe"]) == sorted((r.doc_id or -1, len(codec.encode(r.text)) // 4) for r in seen["mixing"])
    assert neardup.THRESHOLD == 0.8


def test_empty_and_whole_run(spark, tmp_path):
    _, docs = documents(spark)
    for name, frame in (("none", docs.limit(0)), ("some", docs)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (out.count() == 0) == (name == "none")


def test_each_row_is_judged_on_its_own(spark):
    """Rows without an id are rejected like others; a good row stays if a rejected one has its id."""
    rng = random.Random(12)
    good = [prose(rng, 120) for _ in range(12)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(good[:9])]
    rows += [(None, "one two", "en", "src1", 7), (None, "same words " * 200, "en", "src1", 5), (0, "one two", "en", "src1", 7)]
    rows += [(None, good[9], "en", "src1", 1), (None, good[10], "en", "src1", 1), (None, good[10].replace(" the ", " a ", 1), "en", "src1", 1), (None, good[1], "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in after) == sorted((r[0] is None, r[0] or 0, r[1]) for r in rows if len(r[1]) > 20 and "same words" not in r[1])
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(after, docs.schema), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == list(range(9))
    assert len([r for r in kept if r.doc_id is None]) == 2 and good[9] in {r.text for r in kept}
    odd = spark.createDataFrame([(None, "1234 5678 " * 40, "en", "src1", 1)], docs.schema)
    assert corpus_pipeline.language_id(spark, docs.limit(9).unionByName(odd), "").where("text like '1234%'").count() == 0

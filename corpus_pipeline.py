"""A corpus pipeline of five stages over ``documents``: quality rules, language identification, near-duplicates,
source mixing and BPE encoding. Each stage works on all that its predecessor kept, which lies written as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, langid, mixing, neardup, quality
from skyloom.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least language score of a document that stays.
LEAST_SCORE = 0.2
#: Row keys up to which a stage's decisions go to the documents; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _rows(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, ``_row``, written so that it stays: ids can be null or occur more than once."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "pipeline-rows")


def _rejected(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not listed."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "_row", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go, each judged on its own."""
    rows = _rows(docs)
    judged = quality.judged(rows.drop("doc_id"), id_col="_row")
    return _rejected(rows, stored(judged.where("not kept").select(F.col("doc_id").alias("_row")), "pipeline-ids"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a recognisable language go, each judged on its own."""
    rows = _rows(docs)
    model = langid.train(langid.learning_rows(docs), key=F.col("doc_id"))
    found = langid.predictions(rows, model, id_col="_row")
    return _rejected(rows, stored(found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select(F.col("doc_id").alias("_row")), "pipeline-ids"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one with the smallest id, a row without an id only if none has one."""
    rows = _rows(docs)
    classes = stored(neardup.classes(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "class_id"), "pipeline-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    kept = classes.join(rows.select("_row", "doc_id"), "_row").groupBy("class_id").agg(F.min(order).alias("m")).select(F.col("m._row").alias("_row"))
    return _rejected(rows, stored(classes.select("_row").join(kept, "_row", "left_anti"), "pipeline-ids"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's part of the mix; documents taken twice are there twice."""
    taken = mixing.mixed(docs, mixing.STANDARD)
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("language", language_id), ("neardup", near_duplicates), ("mixing", source_mixing), ("bpe", encoding)]
#: Near-duplicates and language filters can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Grounding of cited values: every reference of a brief is resolved in the document it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import claimed, followed, parsed_path, scalars_match

def resolved(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """``path, truth, kind`` (of the scalar, ``truth`` as text) of all cited paths that lead to a scalar. ``artifacts``: root, document (JSON text), a row a document.

    A path's steps are arrays of (kind, name, value), so that any number of paths is resolved by a join of paths with the
    document they name; a malformed path leads nowhere."""
    paths = refs.select("path").distinct().withColumn("_p", parsed_path(F.col("path"))).where("_p is not null")
    both = paths.select("path", F.col("_p.root").alias("root"), F.col("_p.steps").alias("steps")).join(artifacts, "root")
    return both.select("path", followed(F.col("document"), F.col("steps")).alias("t")).where("t is not null").select("path", F.col("t.text").alias("truth"), F.col("t.kind").alias("kind"))


def verified(briefs: DataFrame, refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Briefs with the references that resolve, their values replaced by the documents'; those left without any are dropped.
    ``briefs``: brief_id. ``refs``: brief_id, path, value."""
    good = refs.join(resolved(artifacts, refs), "path")
    kept = good.groupBy("brief_id").agg(F.sort_array(F.collect_set(F.struct("path", F.col("truth").alias("value")))).alias("refs"))
    return briefs.join(kept, "brief_id")


def audited(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``brief_id, ok``: whether all references of a brief resolve to what it says; nothing is repaired. References with a true
    ``stale`` are of an earlier run, whose documents are gone: they are skipped."""
    refs = refs.where(~F.coalesce("stale", F.lit(False))) if "stale" in refs.columns else refs
    truth = refs.join(resolved(artifacts, refs), "path", "left")
    return truth.groupBy("brief_id").agg(F.bool_and(F.coalesce(scalars_match(claimed(F.col("value")), F.struct("kind", F.col("truth").alias("text"))), F.lit(False))).alias("ok"))


def grounded(briefs: DataFrame, books: DataFrame, stages: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Briefs whose effect and interval are the ledger's for their ward, or none; of the stage and scenario that they cite only
    names that exist stay. ``briefs``: brief_id, ward_id, stage_transition, scenario. ``books``: ward_id, effect, ci_low, ci_high."""
    real = briefs.join(books.select("ward_id", "effect", "ci_low", "ci_high"), "ward_id", "left")
    a = real.join(stages.select("stage_transition", F.lit(True).alias("_a")).distinct(), "stage_transition", "left")
    b = a.join(scenarios.select("scenario", F.lit(True).alias("_b")).distinct(), "scenario", "left")
    return b.select("brief_id", "ward_id", "effect", "ci_low", "ci_high", F.when(F.col("_a"), F.col("stage_transition")).alias("stage_transition"), F.when(F.col("_b"), F.col("scenario")).alias("scenario"))

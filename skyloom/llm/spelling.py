"""Spelling variants: words one edit apart, joined by even partition (the pigeonhole principle), in DataFrame operations.

A word of m characters is indexed by two segments, its first half and the rest. One edit leaves one of them whole, so a
word of equal length has a segment at the same place, and a word one longer has the first half at the same place or the
second one shifted by one. What stands besides the shared segment is then compared, and pairs that both segments find are
counted once. A segment that many words share is taken together with a half of what stands besides it: the edit lies
there, so the same holds again, and no list of candidates is left out.

Forms rise in count at least fivefold from word to word, so chains are short: as many rounds of
doubling follow them as the largest count allows.

Defined results: null and empty texts have no words. A null id is the empty text in the hash. Rows with the same id and
text count each. Ties go to the word that comes first in code-point order. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

#: Fixed values of the contract: letters of a run, least length and occurrences, what the hash is divided by, how much more frequent a form is.
LETTERS, LEAST_LENGTH, LEAST_COUNT, EVERY, RATIO = "A-Za-zÀ-ÿ", 6, 5, 199, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of a segment from which on its candidates share a part of the other segment too.
SHARED = 64


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", altered: bool = True, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of words long and frequent enough; ``altered``: with the contract's deletions."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))
    if altered:
        each = each.withColumn("h", F.crc32(F.concat("_id", F.lit(":"), F.col("run")).cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        each = each.withColumn("run", F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run")))
    counts = each.select(F.col("run").alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


def _halves(text: Column, shift: int) -> list[tuple[Column, Column]]:
    """The two segments of ``text`` and what stands besides each; ``shift`` 1: those of the texts one shorter that it may hold."""
    half = F.floor((F.length(text) - shift) / 2).cast("int")
    part = lambda a, n: F.substring(text, a, n)
    return [(part(F.lit(1), half), part(half + 1, F.length(text))), (part(half + 1 + shift, F.length(text)), part(F.lit(1), half + shift))]


def _entries(words: DataFrame, shift: int) -> DataFrame:
    """A row for each segment of each word: ``m`` (length of the indexed word), ``seg`` and ``rest``."""
    entries = F.array(*(F.struct(F.lit(k).alias("k"), seg.alias("seg"), rest.alias("rest")) for k, (seg, rest) in enumerate(_halves(F.col("word"), shift))))
    return words.select("word", "n", (F.length("word") - shift).alias("m"), F.inline(entries)).withColumn("shift", F.lit(shift))


def _divided(entries: DataFrame, shared: DataFrame) -> DataFrame:
    """Entries of segments that many share, once for each half of what stands besides."""
    subs = lambda shift: F.array(*(F.struct(F.lit(k + 1).alias("j"), seg.alias("sub")) for k, (seg, _) in enumerate(_halves(F.col("rest"), shift))))
    plain = F.array(F.struct(F.lit(0).alias("j"), F.lit("").alias("sub")))
    found = entries.join(sized(shared), ["m", "k", "seg"], "left")
    return found.select("word", "n", "m", "k", "seg", "rest", "shift", F.inline(F.when(F.col("many").isNull(), plain).when(F.col("shift") == 0, subs(0)).otherwise(subs(1))))


def near_pairs(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: each two words one edit apart, once; ``words``: ``word`` (distinct) and ``n``."""
    index = _entries(words, 0)
    probes = index.unionByName(_entries(words, 1))
    many = stored(probes.groupBy("m", "k", "seg").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > shared), "spelling-shared")
    left = _divided(index, many).select("m", "k", "seg", "j", "sub", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
    right = _divided(probes, many).select("m", "k", "seg", "j", "sub", "shift", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
    met = left.join(right, ["m", "k", "seg", "j", "sub"]).where((F.col("shift") == 1) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a_rest", "b_rest", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``form``, ``form_n``, ``root``, ``n_near``; ``words`` is a written table."""
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    out = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(most, ratio)) + 1)  # links of a chain, at most
    to = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = stored(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return out.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame) -> DataFrame:
    """The contract's rows: words of ``docs`` with its deletions."""
    return variants(stored(word_counts(docs), "spelling-words"))

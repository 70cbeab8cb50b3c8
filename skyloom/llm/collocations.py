"""Phrase collocation mining by contiguous pattern growth.

Phrases of two to five words that occur often are found as PrefixSpan finds sequences, with neighbouring words only:

1. Words are counted for each language. Only frequent words can be part of a frequent phrase.
2. Pairs of frequent neighbours are counted by hash: pairs whose hash is frequent are a superset of the frequent ones.
3. Each place where such a pair begins is projected: the pair with the words that may follow it, as far as pairs go on
   being frequent, up to five words. Equal projections of a batch are one row with a count.
4. A prefix's projections go to one task, in order. Walking them in order is growing the prefix to the right, depth
   first: what a deeper prefix has gathered is given out when the walk leaves it. Only the open prefixes are in memory.
5. Phrases are scored by their worst cut, and those that a longer phrase with as many occurrences holds are dropped.

Both filters are tables of bits of a bounded size, so that they can be sent to all tasks; what they let through wrongly is
counted like the rest and falls at the threshold. A pair that makes up a large part of the corpus is dealt by three words
instead of two, and its own count put together from its parts.

Defined results: null and empty texts have no words. Null language: ``und``. Repeated rows each count. Ids aren't read.
Scores use decimals of 38 digits; more is an error and not a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import batches_of, bounded_batches, give_back, sized, stored

#: Fixed values of the contract: what ends a piece, what parts words, most words of a phrase.
BREAKS, SPACES, LONGEST = [*b".,;:!?", *range(10, 14)], list(b"\x20\x09"), 5
_FOLDING = W.table(BREAKS + SPACES)
_BREAK = np.isin(np.arange(256), BREAKS)
#: Least occurrences of a phrase, and phrases returned of a language.
LEAST, FIRST = 100, 2000
#: Bits of a filter: sixteen an entry, 2^28 (32 MB) at most.
MOST_BITS = 28
#: A pair is dealt by three words from this share of all words on, and from so many occurrences on at least.
HOT_SHARE, HOT_LEAST = 500, 50_000
#: Bytes of texts whose counts are put together before they leave Python.
TOGETHER = 4 << 20

_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])


class _Part:
    """The words of a piece of a batch: ``ids`` into ``spelled`` and ``langs``, and which follow the one before."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.data, self.at = W.utf8(batch.column("_text"))
        lang = batch.column("_lang").dictionary_encode()
        self.lang_of, self.lang_names = np.asarray(lang.indices).astype(np.int64), lang.dictionary

    def walk(self, ahead: int, size: int = TOGETHER) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, int]]:
        """Pieces as ids, spellings and languages by id, whether a word follows the one before in its piece, and at how many
        places windows may begin: the last ``ahead`` words come again with the next piece."""
        keep = (np.zeros(0, np.int64),) * 2
        for begin, end in W.pieces(self.data, self.at, _FOLDING, size):
            s, e = W.bounds(_FOLDING[self.data[begin:end]], begin, self.at)
            starts, ends = np.concatenate([keep[0], s + begin]), np.concatenate([keep[1], e + begin])
            over = end == len(self.data)
            upto = len(starts) if over else max(0, len(starts) - ahead)
            if len(starts):
                low = starts[0]
                text = np.searchsorted(self.at, starts, "right") - 1
                pause = np.searchsorted(np.flatnonzero(_BREAK[self.data[low:end]]) + low, starts)
                follows = np.zeros(len(starts), np.bool_)
                follows[1:] = (text[1:] == text[:-1]) & (pause[1:] == pause[:-1])
                yield *self._numbered(starts, ends, self.lang_of[text]), follows, upto
            keep = (starts[upto:], ends[upto:])

    def _numbered(self, starts, ends, lang) -> tuple[np.ndarray, pa.Array, pa.Array]:
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        low, high = starts[0], ends[-1]
        inside = np.zeros(high - low + 1, np.int8)
        inside[starts - low] += 1
        np.subtract.at(inside, ends - low, 1)  # a text's last word may touch the next one's first
        letters = _FOLDING[self.data[low:high]][np.cumsum(inside[:-1], dtype=np.int8) > 0]
        spelled = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        pairs, ids = np.unique(np.asarray(spelled.indices).astype(np.int64) * len(self.lang_names) + lang, return_inverse=True)
        return ids, spelled.dictionary.take(pa.array(pairs // len(self.lang_names))), self.lang_names.take(pa.array(pairs % len(self.lang_names)))


def _hashes(spelled: pa.Array, langs: pa.Array) -> np.ndarray:
    """As :func:`word_hash` has them."""
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in pc.binary_join_element_wise(langs, spelled.cast(pa.string()), "\n").cast(pa.binary()).to_pylist()), np.uint64, len(spelled))


def word_hash(lang: str, word: str) -> Column:
    return F.xxhash64(F.concat(F.col(lang), F.lit("\n"), F.col(word)))


def _pairs(h: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return W.mixed(h[first] * np.uint64(0xD1342543DE82EF95) + h[second])


class Filter:
    """A table of bits, asked by 64-bit hashes: all that were put in are found, and few others."""

    def __init__(self, hashes: DataFrame, column: str) -> None:
        n = hashes.count()
        self.bits = min(MOST_BITS, max(15, (16 * n).bit_length()))
        place = F.shiftrightunsigned(F.col(column), 64 - self.bits) + 1
        blocks = hashes.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b"))
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in blocks.toLocalIterator():  # 2^28 bits at most
            part = np.frombuffer(bytes(r.b), np.uint8)[:len(self.table)]
            self.table[(r.block - 1) * 4096:(r.block - 1) * 4096 + len(part)] = part

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - self.bits)
        return (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _mapped(rows: DataFrame, schema: str, work: Callable[[_Part], Iterator[pa.RecordBatch]]) -> DataFrame:
    bounded_batches(rows.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(_Part(batch))
        give_back()

    return rows.mapInArrow(mapped, schema)


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``f``; the empty word stands for all words of its language."""
    def work(part):
        for ids, spelled, langs, _, upto in part.walk(0):
            n = np.bincount(ids[:upto], minlength=len(spelled))
            names, which = np.unique(np.asarray(langs.dictionary_encode().indices), return_inverse=True)
            total = pa.array(np.bincount(which, weights=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), spelled.cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([langs.dictionary_encode().dictionary.take(pa.array(names)).cast(pa.string()), pa.array([""] * len(names)), total], ["lang", "word", "n"])

    return _mapped(rows, "lang string, word string, n bigint", work).groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _places(part: _Part, words: Filter) -> Iterator[tuple]:
    """Where pairs of frequent words begin, and the pairs' hashes (0 elsewhere)."""
    for ids, spelled, langs, follows, upto in part.walk(LONGEST - 1):
        h = _hashes(spelled, langs)
        known = words.has(h)[ids]
        begins = np.flatnonzero(known[:-1] & known[1:] & follows[1:])
        pair = np.zeros(len(ids), np.uint64)
        pair[begins] = _pairs(h, ids[begins], ids[begins + 1])
        yield ids, spelled, langs, begins, pair, upto


def pair_counts(rows: DataFrame, words: Filter) -> DataFrame:
    """``h`` and ``n``: occurrences of neighbouring frequent words by the hash of the pair."""
    held = rows.sparkSession.sparkContext.broadcast(words)

    def work(part):
        for _, _, _, begins, pair, upto in _places(part, held.value):
            h, n = np.unique(pair[begins[begins < upto]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return _mapped(rows, "h bigint, n bigint", work).groupBy("h").agg(F.sum("n").alias("n"))


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal rows, and the groups' sizes."""
    code = columns[0]
    for c in columns[1:]:  # numbers stay below the count of rows, so products stay below 2^63
        _, code = np.unique(code * (c.max() + 2) + c + 1 if len(c) else code, return_inverse=True)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return first, n


def projections(rows: DataFrame, words: Filter, pairs: Filter, hot: np.ndarray) -> DataFrame:
    """``lang``, ``deal`` (the prefix that chooses the task), ``depth`` (its words), ``window`` (two to five words, a space
    behind each) and ``n``."""
    held = rows.sparkSession.sparkContext.broadcast((words, pairs, hot))

    def work(part):
        known, often, most = held.value
        for ids, spelled, langs, begins, pair, upto in _places(part, known):
            good = np.zeros(len(ids) + LONGEST, np.bool_)
            good[begins] = often.has(pair[begins])
            at = np.flatnonzero(good[:upto])
            taken, on = [ids[at], ids[at + 1]], np.ones(len(at), np.bool_)
            for k in range(2, LONGEST):
                on = on & good[at + k - 1]
                taken.append(np.where(on, ids[np.minimum(at + k, len(ids) - 1)], -1))
            first, n = _grouped(taken)
            if not len(first):
                continue
            spaced = pc.binary_join_element_wise(spelled.cast(pa.string()), "", " ")
            word = [spaced.take(pa.array(t[first], mask=t[first] < 0)) for t in taken]
            glue = pc.JoinOptions(null_handling="replace", null_replacement="")
            join = lambda parts: pc.binary_join_element_wise(*parts, "", options=glue)
            is_hot = np.isin(pair[at[first]], most)
            deal = pc.if_else(pa.array(is_hot), join(word[:3]), join(word[:2]))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(taken[0][first])).cast(pa.string()), deal, pa.array(np.where(is_hot, 3, 2).astype(np.int32)), join(word), pa.array(n)], ["lang", "deal", "depth", "window", "n"])

    return _mapped(rows, "lang string, deal string, depth int, window string, n bigint", work)


def grown(projected: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang``, ``phrase``, ``a`` of all phrases with ``least`` occurrences, each prefix grown in the task it is dealt to."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lang, path, counts, dealt = None, [], [], 2

        def left(depth):
            """What is deeper than ``depth`` words is complete."""
            while len(path) > depth:
                a = counts.pop()
                if len(path) >= 2 and (a >= least or len(path) < dealt):
                    yield lang, " ".join(path), a
                path.pop()

        for batch in batches:
            for name, window, n, depth in zip(*(batch.column(c).to_pylist() for c in ("lang", "window", "n", "depth")), strict=True):
                words = window.split(" ")
                words.pop()
                same = 0
                if name == lang:
                    for x, y in zip(path, words, strict=False):
                        if x != y:
                            break
                        same += 1
                yield from left(same)
                lang, dealt = name, depth
                for word in words[same:]:
                    path.append(word)
                    counts.append(0)
                for k in range(len(words)):
                    counts[k] += n
        yield from left(0)

    ordered = projected.repartition("lang", "deal").select("lang", "window", "n", "depth").sortWithinPartitions("lang", "window")
    whole = ordered.mapInArrow(lambda batches: batches_of(walk(batches), _PHRASES), "lang string, phrase string, a bigint")
    return whole.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Phrases with ``l``, ``r``, ``n`` and ``score`` of their worst cut, without those that a longer one stands for."""
    totals = words.where("word = ''").select("lang", F.col("f").alias("n"))
    counts = words.where("word <> ''").select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    size = F.size(F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    side = lambda name, to: counts.select("lang", F.col("part").alias(name), F.col("f").alias(to))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(sized(totals), "lang")
    big = lambda c: F.col(c).cast("decimal(17,0)")
    # Products of 38 digits; the quotient fits a long, as a is no more than l and r.
    over, under = F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n")), big("l") * big("r")
    cuts = cuts.withColumn("_over", over).withColumn("_under", under).withColumn("score", F.expr("_over div _under"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("w")).select("lang", "phrase", "w.a", "w.l", "w.r", "w.n", "w.score")
    # A longer phrase with as many occurrences: one word longer is enough, as counts fall with length.
    long = phrases.where(size >= 3).select("a", "lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', -(size(split(phrase, ' ')) - 1))"), F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)"))).alias("phrase"))
    held = long.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return worst.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases (``lang``, ``phrase``, ``a``) and the frequent words (``lang``, ``word``, ``f``), written tables."""
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"))
    words = stored(word_counts(rows).where((F.col("f") >= least) | (F.col("word") == "")), "collocation-words")
    total = words.where("word = ''").agg(F.sum("f")).first()[0] or 0
    known = Filter(words.where("word <> ''").select(word_hash("lang", "word").alias("h")), "h")
    pairs = stored(pair_counts(rows, known).where(F.col("n") >= least), "collocation-pairs")
    # Fewer than HOT_SHARE pairs can be as frequent as that.
    hot = np.array([r.h for r in pairs.where(F.col("n") >= max(HOT_LEAST, total // HOT_SHARE)).select("h").collect()], np.int64).view(np.uint64)
    return stored(grown(projections(rows, known, Filter(pairs, "h"), hot), least), "collocation-phrases"), words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST) -> DataFrame:
    """Each language's ``first`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    found, words = phrases(docs, text_col, lang_col, least)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = stored(scored(found, words), "collocation-scores").withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # Ranks in two levels, so that no task orders all of a language's phrases.
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

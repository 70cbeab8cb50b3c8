"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has a mask of languages in each slot. The masks in an n-gram's ``HASHES`` slots,
combined by *and*, give all languages that contain the n-gram, plus a few false ones. A text's n-grams that
contain each language are counted from the masks; as the share of slots that have a language's bit is known,
so is its rate of false hits, which is taken off. The language with the largest corrected count is chosen.

The filter's size and the sample it is fitted on are bounded (``SAMPLE_DOCS`` documents of at most
``SAMPLE_CHARS`` characters for each language); prediction reads every whole text.

Defined results: ``und`` and score 0 for a null text or one without a letter, or if nothing was learned. With
no hit at all the most frequent language of the sample is given, with score 0. Equal counts go to the
language first in the alphabet. Repeated rows and null ids are predicted like any other row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, hashed_sample, keeps, rows_of

#: Characters in an n-gram; the places before and after a word count as one.
SIZE = 4
#: Hash functions of the filter, and slots for each n-gram it holds.
HASHES, SLOTS_PER_NGRAM = 3, 8
#: Bounds of the sample.
SAMPLE_DOCS, SAMPLE_CHARS = 800, 10_000
#: An n-gram belongs to a language if it was seen this often there, and at least this part as often as where it is most usual.
LEAST_SEEN, LEAST_SHARE = 3, 0.1
#: Documents of the sample in all languages together, and languages that are learned: the most frequent ones.
MOST, LANGUAGES = 100_000, 2_000
#: Characters of text that a task works on at once.
_CHUNK = 400_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and for each text where its own begin (one more for the end)."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    kept[ends - 1] = True
    symbols = np.where(letter, points, 0)[kept].astype(np.uint64)
    symbols = np.concatenate([np.zeros(1, np.uint64), symbols, np.zeros(SIZE, np.uint64)])
    starts = np.concatenate([[0], np.cumsum(kept)[ends - 1]])
    n = len(symbols) - SIZE
    h = np.zeros(n, np.uint64)
    for k in range(SIZE):
        h += symbols[k:n + k] * _MULTIPLIERS[k]
    inside = np.ones(n, bool)
    for k in range(1, SIZE - 1):
        inside &= symbols[k:n + k] != 0
    counts = np.concatenate([[0], np.cumsum(inside)])
    return _mixed(h[inside]), counts[np.minimum(starts, n)]


@dataclass
class Filter:
    languages: list[str]
    #: The most frequent language, for texts without any hit.
    usual: int
    #: Masks of languages by slot; a power of two of slots, and 64 languages a column.
    slots: np.ndarray

    def __post_init__(self):
        bits = [(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() if len(self.slots) else 0.0 for i in range(len(self.languages))]
        self.false_rate = np.array(bits, float) ** HASHES

    def masks(self, hashes: np.ndarray, column: int = 0) -> np.ndarray:
        out = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in _places(hashes, len(self.slots)):
            out &= self.slots[at, column]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its n-grams, and for each language the corrected number of those it contains."""
        hashes, starts = ngrams(texts)
        total = np.diff(starts)
        found = np.zeros((len(texts), len(self.languages)))
        for column in range(self.slots.shape[1]):
            masks = self.masks(hashes, column)
            for i in range(64 * column, min(64 * column + 64, len(self.languages))):
                ones = np.concatenate([[0], np.cumsum(masks >> np.uint64(i % 64) & np.uint64(1))])
                found[:, i] = ones[starts[1:]] - ones[starts[:-1]].astype(float)
        corrected = (found - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)
        return total, np.clip(corrected, 0, None)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        while some:
            size, take = 0, 0
            while take < len(some) and (not take or size + len(texts[some[take]]) <= _CHUNK):
                size += len(texts[some[take]])
                take += 1
            part, some = some[:take], some[take:]
            total, found = self.counts([texts[i] for i in part])
            best = found.argmax(axis=1)
            for i, n, row, b in zip(part, total, found, best, strict=True):
                out[i] = (self.languages[b], float(min(1.0, row[b] / n))) if n and row[b] > 0 else (self.languages[self.usual], 0.0)
        return out


def _places(hashes: np.ndarray, slots: int):
    for k in range(HASHES):
        yield (hashes >> np.uint64(20 * k)) & np.uint64(slots - 1) if 20 * k + slots.bit_length() <= 65 else _mixed(hashes + np.uint64(k)) & np.uint64(slots - 1)


def fit(samples: dict[str, list[str]]) -> Filter:
    """A filter from texts of each language."""
    languages = sorted(samples)
    seen, shares = {}, {}
    for lang in languages:
        hashes = np.concatenate([np.zeros(0, np.uint64), *(ngrams(samples[lang][i:i + 200])[0] for i in range(0, len(samples[lang]), 200))])
        grams, n = np.unique(hashes, return_counts=True)
        seen[lang], shares[lang] = (grams, n), n / max(1, len(hashes))
    if not languages:
        return Filter([], 0, np.zeros((0, 1), np.uint64))
    every = np.unique(np.concatenate([g for g, _ in seen.values()]))
    most = np.zeros(len(every))
    for lang in languages:
        at = np.searchsorted(every, seen[lang][0])
        most[at] = np.maximum(most[at], shares[lang])
    held = {}
    for lang in languages:
        grams, n = seen[lang]
        held[lang] = grams[(n >= LEAST_SEEN) & (shares[lang] >= LEAST_SHARE * most[np.searchsorted(every, grams)])]
    size = len(np.unique(np.concatenate(list(held.values()))))
    slots = np.zeros((1 << max(10, (size * SLOTS_PER_NGRAM - 1).bit_length() if size else 0), (len(languages) + 63) // 64), np.uint64)
    for i, lang in enumerate(languages):
        for at in _places(held[lang], len(slots)):
            slots[at, i // 64] |= np.uint64(1 << (i % 64))
    return Filter(languages, max(range(len(languages)), key=lambda i: (len(samples[languages[i]]), -i)), slots)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None) -> Filter:
    """Fits a filter on a bounded sample of the rows with a text and a language, drawn by a hash of ``key`` and text. With many
    languages each gives fewer documents, so that none of the ``LANGUAGES`` is left out."""
    picked = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.col(text_col) if key is None else key).alias("k"))
    fitting = picked.where((F.col("text") != "") & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    sizes = fitting.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES).collect()
    table = fitting.sparkSession.createDataFrame([(r.lang, r["_n"]) for r in sizes], "lang string, _n long")
    first = hashed_sample(fitting, min(SAMPLE_DOCS, MOST // max(1, len(sizes))), F.col("k"), F.col("text"), by="lang", sizes=F.broadcast(table))
    samples: dict[str, list[str]] = {}
    for r in first.select("lang", "text").orderBy("lang", "text").collect():
        samples.setdefault(r.lang, []).append(r.text)
    return fit(samples)


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predictions(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        keeps("langid", _letters.cache_clear)

        def rows():
            ids, texts, size = [], [], 0
            for d, t in rows_of(batches, "doc_id", "text"):
                ids.append(d)
                texts.append(t)
                size += len(t or "")
                if size >= _CHUNK or len(ids) >= 1024:
                    yield from ((i, *p) for i, p in zip(ids, shared.value.predict(texts), strict=True))
                    ids, texts, size = [], [], 0
            yield from ((i, *p) for i, p in zip(ids, shared.value.predict(texts), strict=True))

        return batches_of(rows(), _PREDICTED)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())

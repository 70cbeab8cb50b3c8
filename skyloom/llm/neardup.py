"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Documents are multisets of five-word shingles. A shingle weighs its count times a damped idf: 1 for those in at
most ``RARE`` of all documents, down to ``1 - DAMPING`` for those in all of them, so that passages which many
documents share link fewer documents, while a group of copies stays about as alike as its plain shingles are.
Document frequencies come from a count sketch of constant size over all documents.

ICWS draws samples that two documents share with the probability of their weighted Jaccard similarity. Long
documents draw one sample in each of as many bins of their shingles (empty bins borrow), short ones draw
each sample from all their shingles; those between do both, so that any two documents of the threshold or more share a way.
In bins each repeat of a shingle is an element of its own, by its number, which leaves the similarity as it is: so
the bins of a long text are filled evenly, even if a word or a passage repeated is all there is to it.
``ROWS`` samples make a band; documents with an equal band are candidates.

Candidates are verified by their exact weighted Jaccard similarity, without all pairs of a bucket: first each
member with its bucket's smallest document; then, only in buckets that are not yet one class, the members outside
the bucket's largest class with those of other classes: as pairs in buckets of up to ``SMALL`` members, block by
block over an index of shingles, giving out nothing but links, in larger ones. So each pair of a bucket is verified
or in one class, and no link between classes is lost. Copies of a text are one node from the start. Classes are the connected components.

Defined results: one row for each id. Texts with equal words are copies; those of under five words are one
shingle, those without a word (nulls too) are copies of each other. Rows with one id are one document, whose texts
all link it. A null id gets a null class. Ties go to the smaller id: a class is named by its smallest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, in_few, keeps, rows_of, stored

SHINGLE, THRESHOLD, LEAST_THRESHOLD = 5, 0.8, 0.5
#: Samples in a band, the fewest bands, and the chance that two documents of just the threshold share no band.
ROWS, BANDS, MISSED = 4, 20, 3e-5
#: Shingles up to which documents draw from all of them; the part of idf that is damped away at most.
FULL, DAMPING = 200, 0.25
#: Counters of the sketch, parts that it is summed in, and the share of documents up to which a shingle is rare.
SKETCH, PARTS, RARE = 1 << 21, 64, 1e-3
#: Members that one task compares with a bucket's first document; rows up to which a list of ids is broadcast.
BLOCK, BROADCAST_ROWS = 256, 500_000
#: Members of a bucket up to which its open pairs are listed; documents in the two sides of a block of a larger one.
SMALL, SIDES = 32, (256, 512)
#: Characters of text that a task works on at once.
_CHUNK = 250_000
#: Characters of the documents in a block of a large bucket, on average.
BLOCK_CHARS = 4_000_000
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE, _U = 0x9E3779B97F4A7C15, np.uint64


@dataclass(frozen=True)
class Plan:
    """How samples are drawn for a threshold: bands of ROWS samples, and the number of shingles from which on bins are used.

    Two documents of the threshold differ in their number of shingles by a factor of threshold * (1 - DAMPING) at most, so
    bins begin below FULL by more than that: then two such documents always draw in a way that both have."""

    bands: int
    bins_from: float

    @property
    def samples(self) -> int:
        return self.bands * ROWS


def plan_for(threshold: float) -> Plan:
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"near-duplicates are found for thresholds of {LEAST_THRESHOLD} to 1")
    chance = min(threshold, 0.999) ** ROWS
    return Plan(max(BANDS, math.ceil(math.log(MISSED) / math.log(1 - chance))), FULL * min(0.55, 0.9 * threshold * (1 - DAMPING)))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans, by sums of prefixes; independent of where a span lies."""
    size = 1 << max(16, int(len(values)).bit_length())
    power, inverse = _powers(size)
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum(values * power[:len(values)])])
    return (prefix[end] - prefix[start]) * inverse[start]


class Shingled:
    """Some texts' distinct shingles: ``doc`` (place of the text), ``key`` (48 bits), ``count``, sorted by both; and two hashes of each text's words."""

    def __init__(self, texts: list[str]):
        data = [t.encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
        blank = _SPACES[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(raw) and not blank[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        word = _mix(_spans(raw.astype(_U) + _U(1), start, end) + (end - start).astype(_U))
        last = np.cumsum([len(d) + 1 for d in data])
        of = np.searchsorted(last, start, "right")
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        self.words = np.diff(first)
        two = [_spans(_mix(word + _U(k)), first[:-1], first[1:]) for k in (1, 2)]
        self.text_keys = np.where(self.words > 0, _mix(two[0] + self.words.astype(_U)), 0).view(np.int64), np.where(self.words > 0, _mix(two[1] ^ _U(_BASE)), 0).view(np.int64)
        n = max(0, len(word) - SHINGLE + 1)
        inside = of[:n] == of[len(of) - n:] if n else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        short = np.flatnonzero((self.words > 0) & (self.words < SHINGLE))
        starts, ends = np.concatenate([at, first[short]]), np.concatenate([at + SHINGLE, first[short] + self.words[short]])
        h = _mix(_spans(word, starts, ends) + (ends - starts).astype(_U)) >> _U(16)
        if len(texts) > 1 << 16:
            raise ValueError("too many texts at once")
        both, self.count = np.unique((of[starts].astype(_U) << _U(48)) | h, return_counts=True)
        self.doc, self.key = (both >> _U(48)).astype(np.int64), both & _U((1 << 48) - 1)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def _counters(key: np.ndarray) -> np.ndarray:
    return (key & _U(SKETCH - 1)).astype(np.int64)


def damped_idf(counts: np.ndarray, documents: int) -> np.ndarray:
    """Each counter's weight."""
    share = np.clip(counts / max(1, documents), RARE, 1)
    return (1 - DAMPING * (1 - np.log(share) / np.log(RARE))).astype(np.float32)


def _draw(key: np.ndarray, log_weight: np.ndarray, salt: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """ICWS of each shingle: the value whose least one is drawn, and the name of the sample."""
    seed = _mix(key * _U(0xD1342543DE82EF95) + _U(salt))
    halves = []
    for k in range(3):
        x = _mix(seed + _U(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)))
        halves += [((x >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32, ((x & _U(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32]
    r, c, beta = -np.log(halves[0] * halves[1]), -np.log(halves[2] * halves[3]), halves[4]
    t = np.floor(log_weight / r + beta)
    return np.log(c) - r * (t - beta) - r, _mix(seed ^ (t.astype(np.int64).astype(_U) * _U(_BASE)))


def _least(group: np.ndarray, value: np.ndarray, name: np.ndarray, groups: int) -> np.ndarray:
    """For each group the name that goes with its least value; 0 for none."""
    least = np.full(groups, np.inf)
    np.minimum.at(least, group, value)
    won = value == least[group]
    out = np.full(groups, np.iinfo(np.uint64).max, _U)
    np.minimum.at(out, group[won], name[won])
    return np.where(np.isinf(least), _U(0), out)


@lru_cache(maxsize=2)
def _lenders(samples: int) -> np.ndarray:
    """For each bin the order in which it borrows from others."""
    return np.array([np.random.default_rng(j).permutation(samples) for j in range(samples)])


def _bands(samples: np.ndarray, way: int) -> np.ndarray:
    out = np.zeros((len(samples), samples.shape[1] // ROWS), _U)
    for k in range(ROWS):
        out = _mix(out * _U(_BASE) + samples[:, k::ROWS])
    return _mix(out + np.arange(out.shape[1], dtype=_U)[None, :] * _U(0xA24BAED4963EE407) + _U(way)).view(np.int64)


def signatures(s: Shingled, weight: np.ndarray, plan: Plan) -> list[list[int]]:
    """The bands of each text."""
    docs, samples = len(s.words), plan.samples
    w = weight[_counters(s.key)] * s.count
    size = np.bincount(s.doc, s.count, docs)
    bands: list[list[int]] = [[] for _ in range(docs)]
    long, short = size >= plan.bins_from, (size > 0) & (size <= FULL)
    if long.any():
        pick = long[s.doc]
        times = s.count[pick]
        key, of = np.repeat(s.key[pick], times), np.repeat((np.cumsum(long) - 1)[s.doc[pick]], times)
        number = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)
        key[number > 0] = _mix(key[number > 0] + number[number > 0].astype(_U) * _U(_BASE))
        value, name = _draw(key, np.log(weight[_counters(np.repeat(s.key[pick], times))]), 1)
        place = (_mix(key + _U(0x5851F42D4C957F2D)) >> _U(32)) * _U(samples) >> _U(32)
        some = _least(of * samples + place.astype(np.int64), value, name, int(long.sum()) * samples).reshape(-1, samples)
        full = some != 0
        for j in range(samples):
            need = ~full[:, j]
            if need.any():
                order = _lenders(samples)[j]
                lender = order[full[need][:, order].argmax(axis=1)]
                some[need, j] = _mix(some[need, lender] + _U((j + 1) * _BASE % (1 << 64)))
        for i, b in zip(np.flatnonzero(long).tolist(), _bands(some, 1).tolist(), strict=True):
            bands[i] += b
    if short.any():
        pick = short[s.doc]
        key, of, log_w = s.key[pick], (np.cumsum(short) - 1)[s.doc[pick]], np.log(w[pick])
        some = np.empty((int(short.sum()), samples), _U)
        for j in range(samples):
            value, name = _draw(key, log_w, j + 2)
            some[:, j] = _least(of, value, name, len(some))
        for i, b in zip(np.flatnonzero(short).tolist(), _bands(some, 2).tolist(), strict=True):
            bands[i] += b
    return bands


def _free() -> None:
    _powers.cache_clear()
    _lenders.cache_clear()


def _chunks(rows):
    """Lists of rows whose last column, the text, is about _CHUNK characters in all."""
    keeps("neardup", _free)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if size >= _CHUNK or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_PART = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def sketch(docs: DataFrame) -> np.ndarray:
    """Counters of all documents' distinct shingles. Each task gives its counters in parts, which are summed in two rounds."""
    spread = SKETCH // PARTS

    def counted(batches):
        counts = np.zeros(SKETCH, np.int64)
        for rows in _chunks(rows_of(batches, "text")):
            np.add.at(counts, _counters(Shingled([t or "" for (t,) in rows]).key), 1)
        if counts.any():
            pack, task = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
            yield from ((p, task % 16, pack.compress(_slim(counts[p * spread:(p + 1) * spread]))) for p in range(PARTS))

    def summed(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part, salt, data in rows_of(batches, "part", "salt", "counts"):
            found = _wide(zstandard.ZstdDecompressor().decompress(data))
            sums[part, salt] = sums[part, salt] + found if (part, salt) in sums else found
        pack = zstandard.ZstdCompressor(level=1)
        yield from ((p, 0, pack.compress(_slim(c))) for (p, _), c in sums.items())

    kind = "part int, salt int, counts binary"
    out = docs.select("text").mapInArrow(lambda b: batches_of(counted(b), _PART, 8), kind)
    for keys in (("part", "salt"), ("part",)):
        out = out.repartition(*keys).mapInArrow(lambda b: batches_of(summed(b), _PART, 8), kind)
    counts = np.zeros(SKETCH, np.int64)
    for r in out.collect():  # PARTS rows, SKETCH counters in all
        counts[r.part * spread:(r.part + 1) * spread] = _wide(zstandard.ZstdDecompressor().decompress(bytes(r.counts)))
    return counts


def _slim(counts: np.ndarray) -> bytes:
    kind = next(k for k in ("u1", "u2", "u4", "u8") if counts.max(initial=0) <= np.iinfo(k).max)
    return kind.encode() + counts.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:2].decode(), offset=2).astype(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("chars", pa.int64()), ("bands", pa.list_(pa.int64()))])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted keys, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    shared = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def verified(docs: DataFrame, pairs: DataFrame, weight, threshold: float, documents: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, of so many documents. Pairs are dealt by a, in blocks of about BLOCK if it has many."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("doc_id"), F.lit(1).alias("k"))
    leaders = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc_id"), F.lit(0).alias("k"))
    need = stored(members.unionByName(leaders), "neardup-need", documents)
    # The ids needed are few beside the texts: up to a known number they go to the texts, beyond it both are shuffled.
    texts = docs.join(F.broadcast(need) if need.count() <= BROADCAST_ROWS else need, "doc_id")
    dealt = texts.select("a", "block", "k", "doc_id", "text").repartition("a", "block").sortWithinPartitions("a", "block", "k", "doc_id")

    def run(batches):
        leader, held = None, []
        for rows in _chunks(rows_of(batches, "a", "block", "k", "doc_id", "text")):
            s = Shingled([r[-1] or "" for r in rows])
            w = weight.value[_counters(s.key)] * s.count
            for i, (a, block, k, b, _) in enumerate(rows):
                span = slice(s.first[i], s.first[i + 1])
                mine = s.key[span], w[span]
                if (a, block) != leader:
                    leader, held = (a, block), []
                if k == 0:
                    held.append(mine)
                elif (found := max(similarity(x, mine) for x in held)) >= threshold:
                    yield a, b, found

    return dealt.mapInArrow(lambda b: batches_of(run(b), _EDGE), "a long, b long, similarity double")


def compared(docs: DataFrame, buckets: DataFrame, weight, threshold: float, documents: int) -> DataFrame:
    """Links between classes in large buckets ``band, node, chars, root, main``: documents outside the main class against all,
    a block of either at a time. Of many links that join the same classes one is given out for each block."""
    outside = F.when(F.col("root") != F.col("main"), 1)
    chars = F.when(F.col("root") != F.col("main"), F.col("chars"))
    # By number or by size, whichever gives more blocks: a block's texts lie in memory together.
    parts = lambda n, size, side: F.greatest(F.ceil(n / side), F.ceil(F.coalesce(size, F.lit(0)) / BLOCK_CHARS)).cast("int")
    blocks = buckets.groupBy("band").agg(parts(F.count(outside), F.sum(chars), SIDES[0]).alias("rows"), parts(F.count(F.lit(1)), F.sum("chars"), SIDES[1]).alias("columns"))
    dealt = buckets.join(blocks, "band")
    own, every = (F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("rows", "columns"))
    mine = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    xs = dealt.where("root <> main").select("band", mine("rows", 1).alias("i"), every.alias("j"), F.lit(0).alias("side"), F.col("node").alias("doc_id"), "root")
    ys = dealt.select("band", own.alias("i"), mine("columns", 2).alias("j"), F.lit(1).alias("side"), F.col("node").alias("doc_id"), "root")
    need = stored(xs.unionByName(ys), "neardup-blocks", documents)
    if need.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long, similarity double")
    wanted = need.select("doc_id").distinct()
    texts = docs.join(F.broadcast(wanted) if need.count() <= BROADCAST_ROWS else wanted, "doc_id", "left_semi")
    units = need.join(texts, "doc_id").select("band", "i", "j", "side", "doc_id", "root", "text").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side")

    def run(batches):
        keeps("neardup", _free)
        unit, held = None, []
        for row in rows_of(batches, "band", "i", "j", "side", "doc_id", "root", "text"):
            if row[:3] != unit:
                yield from _links(held, weight.value, threshold)
                unit, held = row[:3], []
            held.append(row[3:])
        yield from _links(held, weight.value, threshold)

    return units.mapInArrow(lambda b: batches_of(run(b), _EDGE), "a long, b long, similarity double")


def _links(rows: list[tuple], weight: np.ndarray, threshold: float):
    """(a, b, similarity) that join classes, of rows (side, id, class, text): side 0 against side 1."""
    if not rows:
        return
    s = Shingled([r[-1] or "" for r in rows])
    w = weight[_counters(s.key)] * s.count
    total = np.bincount(s.doc, w, len(rows))
    side = np.array([r[0] for r in rows])
    pick = side[s.doc] == 1
    order = np.argsort(s.key[pick], kind="stable")
    keys, of, ws = s.key[pick][order], s.doc[pick][order], w[pick][order]
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    for x in np.flatnonzero(side == 0).tolist():
        span = slice(s.first[x], s.first[x + 1])
        lo, hi = np.searchsorted(keys, s.key[span], "left"), np.searchsorted(keys, s.key[span], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        shared = np.bincount(of[at], np.minimum(np.repeat(w[span], n), ws[at]), len(rows))
        found = shared / (total[x] + total - shared)
        for y in np.flatnonzero((found >= threshold) & (side == 1)).tolist():
            a, b = root(rows[x][2]), root(rows[y][2])
            if a != b:
                joined[max(a, b)] = min(a, b)
                yield rows[x][1], rows[y][1], float(found[y])


def components(edges: DataFrame, documents: int | None = None) -> DataFrame:
    """``node, root`` (its component's least node) of all nodes with an edge, by alternating large and small stars. ``documents``: nodes at most."""
    e = edges.select("a", "b").where("a <> b").distinct()
    while True:
        every = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        least = every.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = every.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        e = stored(small.where("a <> b").distinct(), "neardup-stars", documents)
        # Stars only: each node has one root, and no node that has a root is one.
        several = e.groupBy("a").count().where("count > 1").select("a")
        if several.unionByName(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")).isEmpty():
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id`` of every document."""
    spark: SparkSession = docs.sparkSession
    plan = plan_for(threshold)
    picked = _picked(docs, id_col, text_col)
    named = picked.where("doc_id is not null")
    documents = named.count()
    weight = spark.sparkContext.broadcast(damped_idf(sketch(named), documents))

    def signed(batches):
        for rows in _chunks(rows_of(batches, "doc_id", "text")):
            s = Shingled([t or "" for _, t in rows])
            yield from zip([d for d, _ in rows], s.text_keys[0].tolist(), s.text_keys[1].tolist(), [len(t or "") for _, t in rows], signatures(s, weight.value, plan), strict=True)

    texts = stored(named.mapInArrow(lambda b: batches_of(signed(b), _SIGNED, 512), "doc_id long, hi long, lo long, chars long, bands array<long>"), "neardup-signed")
    nodes = stored(texts.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "chars", "bands")).alias("m")).select("hi", "lo", F.col("m.doc_id").alias("node"), F.col("m.chars").alias("chars"), F.col("m.bands").alias("bands")), "neardup-nodes", documents)
    buckets = nodes.select("node", "chars", F.explode("bands").alias("band"))
    first = buckets.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("band", "a")
    shared = stored(buckets.join(first, "band"), "neardup-buckets", documents)
    pairs = stored(shared.where("node <> a").select("a", F.col("node").alias("b")).distinct(), "neardup-pairs", documents)
    # Rows with one id but several texts are one document from the start.
    same = texts.join(nodes.select("hi", "lo", "node"), ["hi", "lo"]).select("doc_id", "node").distinct()
    same = stored(same, "neardup-same", documents)
    apart = same.where("doc_id <> node").join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = stored(verified(named, pairs, weight, threshold, documents).select("a", "b").union(apart), "neardup-links", documents)
    roots = components(links, documents)

    rooted = shared.join(roots, "node", "left").select("band", "node", "chars", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("band", "root").count()
    main = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("count", "root")).alias("m")).where("n > 1").select("band", F.col("m.root").alias("main"))
    counts = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("members"))
    open_ = stored(rooted.join(main.join(counts, "band"), "band"), "neardup-open", documents)
    few = open_.where(F.col("members") <= SMALL)
    outside = few.where("root <> main").select("band", F.col("node").alias("x"), F.col("root").alias("xr"))
    across = outside.join(few, "band").where("root <> xr and (root = main or x < node)").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    more = verified(named, stored(across.join(pairs, ["a", "b"], "left_anti"), "neardup-pairs", documents), weight, threshold, documents)
    more = more.unionByName(compared(named, open_.where(F.col("members") > SMALL).select("band", "node", "chars", "root", "main"), weight, threshold, documents)).select("a", "b")
    more = stored(more, "neardup-links", documents)
    final = roots if more.isEmpty() else components(more.union(roots.select("root", "node")), documents)
    out = same.join(final, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("class_id"))
    return in_few(out.unionByName(picked.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))), documents)


def kept_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids to keep: one of each class."""
    return classes(docs, id_col, text_col).where("doc_id = class_id").select("doc_id")

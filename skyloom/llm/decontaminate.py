"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over whole documents.

A window is ten consecutive words of an item; an item of fewer words is one window of its own length. The hashes of all
windows go to each task, behind a table of bits; a document's windows are hashed by a rolling sum, those that the table
lets through are looked up, and each that is found is compared byte by byte with the item's words. What overlaps is one
run, and runs or whole documents can be removed.

The set is bounded: a benchmark of more than ``BLOCK_BYTES`` is taken in blocks, each sent to the tasks and scanned in
its turn, and the runs that blocks find in a document are put together by a key of the row. An item that is long is cut
into parts that share nine words.

Defined results: a null or empty text has no words and no items, nor has one of separators alone. Rows with one
``item_id`` are one item; items without an id hit words but are neither named nor counted. An empty benchmark hits
nothing. Documents are judged row by row, so repeated ids and ids that are null stay rows of their own; columns beside
the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import bounded_batches, sized, stored

#: Fixed values of the contract: words of a window; what parts words, as a pattern and as bytes.
WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLDING = W.table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of benchmark words in a block, and words in a part of an item.
BLOCK_BYTES, PART_WORDS = 8 << 20, 20_000
#: Windows compared byte by byte at once; most bits of the table that is asked before the set.
VERIFY, TABLE_BITS = 20_000, 24

_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_RUNS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


class WindowSet:
    """The windows of one block: for each length, window hashes in order, their words, and the items that hold them."""

    def __init__(self, parts: list[tuple[str | None, str]]) -> None:
        """``parts``: item id and words joined by a space."""
        ids = sorted({i for i, _ in parts if i is not None}, key=lambda i: i.encode())
        self.ids, code = ids, {i: k for k, i in enumerate(ids)}
        data, at = W.utf8(pa.array([t for _, t in parts], pa.string()))
        folded = _FOLDING[data]
        starts, ends = W.bounds(folded, 0, at)
        owner = np.searchsorted(at, starts, "right") - 1
        codes = np.array([code.get(i, -1) for i, _ in parts], np.int64)[owner] if len(parts) else np.zeros(0, np.int64)
        spelled = pa.array([folded[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()).dictionary_encode()
        number = np.asarray(spelled.indices).astype(np.int32)
        vocabulary = spelled.dictionary.to_pylist()
        self.letters = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.sizes = np.array([len(w) for w in vocabulary], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        hashes = W.Hashes().of(folded, starts, ends)
        length = np.minimum(np.bincount(owner, minlength=len(parts)), WINDOW)[owner] if len(parts) else owner
        self.by_length = {}
        for n in map(int, np.unique(length)):
            whole = np.flatnonzero(length[:len(length) - n + 1] == n)
            whole = whole[owner[whole] == owner[whole + n - 1]]
            spelling, which = np.unique(number[whole[:, None] + np.arange(n)], axis=0, return_inverse=True)
            which = which.ravel()
            of = np.zeros(len(spelling), np.uint64)
            of[which] = rolled(hashes, n)[whole]
            order = np.argsort(of, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            pairs = np.unique(np.stack([place[which], codes[whole]], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            bits = min(TABLE_BITS, max(12, math.ceil(math.log2(8 * len(of)))))
            let = np.zeros(1 << bits, np.bool_)
            let[of >> np.uint64(64 - bits)] = True
            self.by_length[n] = (bits, let, of[order], spelling[order], np.searchsorted(pairs[:, 0], np.arange(len(of) + 1)), pairs[:, 1])

    def same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """Which of the windows that begin at word ``at`` have just the words of ``spelling``."""
        n, out = spelling.shape[1], np.zeros(len(at), np.bool_)
        for a in range(0, len(at), VERIFY):
            word, own = (at[a:a + VERIFY, None] + np.arange(n)), spelling[a:a + VERIFY]
            sizes = self.sizes[own]
            even = np.flatnonzero((ends[word] - starts[word] == sizes).all(axis=1))
            if not len(even):
                continue
            sizes, word, own = sizes[even].ravel(), word[even].ravel(), own[even].ravel()
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            unlike = _FOLDING[data[np.repeat(starts[word], sizes) + step]] != self.letters[np.repeat(self.begins[own], sizes) + step]
            each = np.add.reduceat(unlike, np.concatenate([[0], np.cumsum(sizes)[n - 1:-1:n]]), dtype=np.int64)
            out[a + even[each == 0]] = True
        return out

    def found(self, data, starts, ends, hashes, text) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the words at which its windows begin, and which windows those are."""
        for n, (bits, let, of, spelling, _, _) in self.by_length.items():
            if len(starts) < n:
                continue
            asked = rolled(hashes, n)
            at = np.flatnonzero(let[asked >> np.uint64(64 - bits)] & (text[:len(text) - n + 1] == text[n - 1:]))
            low = np.searchsorted(of, asked[at], "left")
            for _ in range(len(of)):  # windows of one hash stand side by side: mostly one
                held = (low < len(of)) & (of[np.minimum(low, len(of) - 1)] == asked[at])
                at, low = at[held], low[held]
                if not len(at):
                    break
                good = self.same(data, starts, ends, at, spelling[low])
                yield n, at[good], low[good]
                low = low + 1


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of ``n`` words."""
    out = hashes[:max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k:len(hashes) - n + 1 + k]
    return W.mixed(out)


def joined(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that overlap as one; ``last`` is exclusive. No run of one text overlaps one of another."""
    order = np.argsort(first, kind="stable")
    first, last, start, end, text = (x[order] for x in (first, last, start, end, text))
    far = np.maximum.accumulate(last) if len(last) else last
    new = np.flatnonzero(np.concatenate([[True], first[1:] >= far[:-1]])) if len(first) else np.zeros(0, np.int64)
    most = lambda x: np.maximum.reduceat(x, new) if len(new) else x
    return first[new], most(last), start[new], most(end), text[new]


def scanned_texts(known: WindowSet, hasher: W.Hashes, column: pa.Array, size: int = W.PIECE) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Words by text; the runs of hit words; pairs of text and item code."""
    data, at = W.utf8(column)
    counts, longest = np.zeros(len(column), np.int64), max(known.by_length, default=1)
    runs, items = [tuple(np.zeros(0, np.int64) for _ in range(5))], [np.zeros((0, 2), np.int64)]
    before = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    seen = 0
    for begin, end in W.pieces(data, at, _FOLDING, size):
        folded = _FOLDING[data[begin:end]]
        s, e = W.bounds(folded, begin, at)
        text = np.searchsorted(at, s + begin, "right") - 1
        counts += np.bincount(text, minlength=len(counts))
        # The last words of the piece before, as windows may begin there.
        starts, ends, hashes, text = (np.concatenate(x) for x in zip(before, (s + begin, e + begin, hasher.of(folded, s, e), text), strict=True))
        base = seen - len(before[0])
        seen += len(s)
        hits = []
        for n, first, which in known.found(data, starts, ends, hashes, text):
            hits.append((base + first, base + first + n, starts[first], ends[first + n - 1], text[first]))
            _, _, _, _, open_, owners = known.by_length[n]
            pair = np.unique(np.stack([text[first], which], 1), axis=0)
            many = open_[pair[:, 1] + 1] - open_[pair[:, 1]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            items.append(np.stack([np.repeat(pair[:, 0], many), owners[np.repeat(open_[pair[:, 1]], many) + step]], 1))
        if hits:
            runs.append(joined(*(np.concatenate(x) for x in zip(*hits, strict=True))))
            items = [np.unique(np.concatenate(items), axis=0)]
        keep = slice(max(0, len(starts) - longest + 1), None)
        before = (starts[keep], ends[keep], hashes[keep], text[keep])
    first, last, start, end, text = joined(*(np.concatenate(x) for x in zip(*runs, strict=True)))
    # Places from the text's own beginning.
    words_before = np.concatenate([[0], np.cumsum(counts)])[text]
    return counts, (first - words_before, last - words_before, start - at[text], end - at[text], text), items[0]


def _scan(rows: DataFrame, parts: list[tuple[str | None, str]], key: str, all_rows: bool) -> DataFrame:
    """``key``, ``n_words``, ``runs`` and ``items`` of rows with columns ``key`` and ``_text``; only rows with hits unless ``all_rows``."""
    spark = rows.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(WindowSet(parts))
    kind = rows.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = held.value, W.Hashes()
        ids = pa.array(known.ids, pa.string())
        for batch in batches:
            counts, (first, last, start, end, text), items = scanned_texts(known, hasher, batch.column("_text"))
            every = np.arange(batch.num_rows + 1)
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, every), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (first, last, start, end)], fields=list(_RUN)))
            named = pa.ListArray.from_arrays(pa.array(np.searchsorted(items[:, 0], every), pa.int32()), ids.take(pa.array(items[:, 1])))
            out = pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts), runs, named], [key, "n_words", "runs", "items"])
            yield out if all_rows else out.filter(pa.array(np.bincount(text, minlength=batch.num_rows) > 0))

    return rows.select(key, "_text").mapInArrow(scan, f"`{key}` {kind}, n_words bigint, runs {_RUNS}, items array<string>")


def benchmark_parts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items as ``item`` (string), ``part`` and ``words``, joined by a space; parts of a long item share nine words."""
    found = F.array_remove(F.split(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), SEPARATORS), "")
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), found.alias("w")).where(F.size("w") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)), F.lit(PART_WORDS))
    parts = F.transform(begins, lambda b: F.array_join(F.slice("w", b, F.lit(PART_WORDS + WINDOW - 1)), " "))
    return named.select("item", F.posexplode(parts).alias("part", "words"))


def scanned(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's ``key``, ``n_words``, ``runs`` (words ``first`` to ``last``, bytes ``start`` to ``end``, ends exclusive) and ``items``.

    The runs are in order and don't overlap, the items are distinct. The columns are those four: others aren't read."""
    rows = docs.select(F.col(key).alias(key), F.col(text_col).cast("string").alias("_text"))
    parts = stored(benchmark_parts(benchmark, item_col, item_text), "decontaminate-items")
    size = parts.agg(F.sum(F.octet_length("words") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("item", "part", "words"), F.lit(blocks))
    listed = lambda k: [(r.item, r.words) for r in parts.where(block == k).select("item", "words").distinct().collect()]  # noqa: E731  bounded: a block
    if blocks == 1:
        return _scan(rows, listed(0), key, True)
    keyed = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    found = None
    for k in range(blocks):
        one = _scan(keyed, listed(k), "_row", False).drop("n_words")
        found = one if found is None else found.unionByName(one)
    found = stored(found, "decontaminate-hits")
    each = found.select("_row", F.inline("runs"))
    order = Window.partitionBy("_row").orderBy("first", "last")
    far = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = each.withColumn("new", F.coalesce((F.col("first") >= far).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = placed.groupBy("_row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("first", "last", "start", "end"))).alias("runs"))
    items = found.select("_row", F.explode("items").alias("i")).groupBy("_row").agg(F.collect_set("i").alias("items"))
    counts = _scan(keyed, [], "_row", True).select("_row", "n_words")
    every = keyed.select("_row", key).join(counts, "_row").join(sized(stored(runs.join(items, "_row", "left"), "decontaminate-runs")), "_row", "left")
    return every.select(key, "n_words", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + (r["last"] - r["first"]))


def digests(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The contract's row of each document."""
    found = scanned(docs, benchmark, block_bytes=block_bytes)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit_words(F.col("runs")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all their columns, without the contaminated documents (``remove="documents"``) or without the hit runs of
    words in their texts (``"spans"``: from a run's first word to its last, what stands around stays)."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove spans or documents")
    names, row = docs.columns, "_decontaminated_row"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-docs")
    hit = stored(scanned(rows, benchmark, row, text_col, block_bytes=block_bytes).where(F.size("runs") > 0).select(F.col(row), F.col("runs").alias("_decontaminated_runs")), "decontaminate-found")
    if remove == "documents":
        return rows.join(sized(hit), row, "left_anti").select(*names)
    gaps = F.transform("_decontaminated_runs", lambda r, k: F.struct(
        F.when(k > 0, F.get("_decontaminated_runs", k - 1)["end"]).otherwise(F.lit(0)).alias("a"), r["start"].alias("b")))
    part = lambda a, b: f"substring(cast(`{text_col}` as binary), cast({a} as int) + 1, cast({b} - {a} as int))"
    rest = F.expr(f"cast(concat(array_join(transform(_decontaminated_gaps, g -> decode({part('g.a', 'g.b')}, 'UTF-8')), ''), "
                  f"decode(substring(cast(`{text_col}` as binary), cast(element_at(_decontaminated_runs, -1).end as int) + 1), 'UTF-8')) as string)")
    out = rows.join(sized(hit), row, "left").withColumn("_decontaminated_gaps", gaps)
    return out.withColumn(text_col, F.when(F.col("_decontaminated_runs").isNull(), F.col(text_col)).otherwise(rest)).select(*names)


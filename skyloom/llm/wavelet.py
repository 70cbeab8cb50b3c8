"""Token ids on disk: one wavelet matrix per shard.

A shard holds the ids of consecutive documents as succinct bit-planes, most significant bit first. On each
plane the tokens keep their order, except that those with a 0 go before those with a 1 on the next one.
With counts of ones before each block, *access*, *rank* (occurrences before a place) and *select* (place of
the k-th occurrence) read one or a few blocks of each plane, straight from the compressed file.

File: ``MAGIC``, length of the header, header (JSON), then the parts it gives offsets of: the document table
and for each plane its blocks of ``BLOCK`` bits, each a Zstandard frame, with offsets and counts of ones.
Trailing bytes are ignored.

Defined results: documents are in ascending order of doc_id, nulls first, equal ids by text; a null text is
an empty one, which still gets the end id. A shard has at most ``shard_tokens`` tokens, or one document.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, keeps, rows_of, stored, written_files

MAGIC = b"SKYWAVE1"
BLOCK = 1 << 17
#: Words kept with their ids in each worker; beyond it those stay that the last texts had. Bytes of texts that are encoded
#: at once, and of words that the library is asked for at once.
CACHE, AT_ONCE, ASKED = 1_000_000, 12_000_000, 400_000


# Words that are one pre-token of the vocabulary each (letters that no normal form changes, or ASCII punctuation).
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-/:-@\[-`{-~]+"
_ONE = f"^(?:{_LETTERS}|{_MARKS})$"


class WordEncoder:
    """Whole texts to ids by the tokenizers library, which is asked once for each new word.

    The vocabulary's pre-tokens never hold white space, and its normalizer changes nothing across it, so the ids of a
    text are those of its words between ASCII white space one after the other. ASCII words are taken in lower case, as the
    library does, and marks after letters are words of their own, as they are pre-tokens of their own. Many words are
    asked for together: those that are one pre-token each parted by spaces, and the answer where a token ends a word;
    others parted by a special token, at which the library cuts a text before all else. Words with a special token of
    their own are asked for alone. Words are told apart, and their ids put together, by columns.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self.size = self._library.get_vocab_size(with_added_tokens=True)
        self._ends = np.zeros(self.size, bool)
        self._ends[[i for t, i in self._library.get_vocab().items() if t.endswith("</w>")]] = True
        added = self._library.get_added_tokens_decoder()
        self._special = "|".join(map(re.escape, [t.content for t in added.values()]))
        # A token between words that takes nothing from them.
        self._parting = next(((i, t.content) for i, t in added.items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)), None)
        self._words = pa.array([], pa.string())
        self._start, self._count, self._pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _ask_words(self, words: pa.Array, parting: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and how many each has."""
        if parting is not None:
            ids = self._ask(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), parting)[0].as_py())
            if parting == " ":
                ends = np.flatnonzero(self._ends[ids]) + 1
                if len(ends) == len(words) and ends[-1] == len(ids):
                    return ids, np.diff(ends, prepend=0)
            else:
                parted = ids == self._parting[0]
                ends = np.append(np.flatnonzero(parted), len(ids))
                if len(ends) == len(words):
                    return ids[~parted], np.diff(ends, prepend=-1) - 1
        each = [self._ask(w) for w in words.to_pylist()]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, words: pa.Array) -> None:
        one = _matching(words, _ONE)
        own = ~one & _matching(words, self._special) if self._special else np.zeros(len(words), bool)
        pools, counts, places = [], [], []
        for group, parting in ((one, " "), (~one & ~own, self._parting and self._parting[1]), (own, None)):
            at = np.flatnonzero(group)
            places.append(at)
            for part in _pieces(words.take(pa.array(at)), ASKED):
                ids, count = self._ask_words(part, parting)
                pools.append(ids)
                counts.append(count)
        count = np.concatenate(counts)
        start = np.empty(len(words), np.int64)
        start[np.concatenate(places)] = np.cumsum(count) - count + len(self._pool)
        size = np.empty(len(words), np.int64)
        size[np.concatenate(places)] = count
        self._start, self._count = np.concatenate([self._start, start]), np.concatenate([self._count, size])
        self._pool = np.concatenate([self._pool, *pools])

    def _keep(self, places: np.ndarray) -> None:
        """Forgets all words but those at the places."""
        ids = self._pool[_runs(self._start[places], self._count[places])]
        self._words, self._pool, self._count = self._words.take(pa.array(places)), ids, self._count[places]
        self._start = np.cumsum(self._count) - self._count

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after the other, and where each text's end."""
        split = pc.ascii_split_whitespace(texts)
        words, parts = _parted(split.flatten())
        known = len(self._words)
        # The known words come first and are distinct, so that they keep their places; new ones get the next.
        both = pa.concat_arrays([self._words, words]).dictionary_encode()
        at, self._words = both.indices.to_numpy()[known:], both.dictionary
        if len(self._words) > known:
            self._learn(self._words.slice(known))
        count = self._count[at]
        ids = self._pool[_runs(self._start[at], count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(parts)])[np.cumsum(pc.list_value_length(split).to_numpy())]]
        if len(self._words) > CACHE:
            self._keep(np.unique(at))
        return ids, ends

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_column(pa.array([t or "" for t in texts], pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def _matching(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


def _parted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words with marks after letters as words of their own, and how many each has become; ASCII in lower case."""
    ascii_ = pc.string_is_ascii(words)
    plain = pc.and_not(ascii_, pc.match_substring(words, "<|"))  # upper-case letters keep what is no special token from being one
    words = pc.if_else(plain, pc.ascii_lower(words), words)
    stem = pc.ascii_rtrim(words, string.punctuation)
    letters = pc.and_(plain, pc.ascii_is_alpha(stem)).to_numpy(zero_copy_only=False).copy()
    size, whole = pc.binary_length(stem).to_numpy(), pc.binary_length(words).to_numpy()
    other = np.flatnonzero(~ascii_.to_numpy(zero_copy_only=False) & (size < whole))
    letters[other] = _matching(stem.take(pa.array(other)), f"^{_LETTERS}$")
    at = np.flatnonzero(letters & (size < whole))
    # A word's letters and marks lie one after the other: only a border between them is new.
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    borders = np.insert(offsets, at + 1, offsets[at] + size[at])
    parts = np.ones(len(words), np.int64)
    parts[at] = 2
    return pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), words.buffers()[2]), parts


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(start - (ends - count), count)
    places += np.arange(total)
    return places


def _pieces(texts: pa.Array, size: int):
    """The column in pieces of about so many bytes, of one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _kind(levels: int) -> type:
    """The narrowest type that holds the ids."""
    return np.uint16 if levels <= 16 else np.uint32


def build(ids: np.ndarray, doc_ids: list[int | None], doc_sizes: list[int], part: int, seq: int, levels: int) -> bytes:
    """The bytes of a shard."""
    pack = zstandard.ZstdCompressor(level=1)
    body: list[bytes] = []
    at = 0

    def put(data: bytes) -> list[int]:
        nonlocal at
        frame = pack.compress(data)
        body.append(frame)
        at += len(frame)
        return [at - len(frame), len(frame)]

    table = np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(doc_sizes, "<u8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    header = {"tokens": len(ids), "docs": len(doc_ids), "part": part, "seq": seq, "levels": levels, "block": BLOCK, "table": put(table), "planes": []}
    kind = _kind(levels)
    values = ids.astype(kind)
    for level in range(levels):
        ones = (values & kind(1 << (levels - 1 - level))) != 0
        packed = np.packbits(ones, bitorder="little")
        frames, counts = [], [0]
        for n in range(0, len(ids), BLOCK):
            frames.append(put(packed[n // 8:(n + BLOCK) // 8].tobytes()))
            counts.append(counts[-1] + int(np.count_nonzero(ones[n:n + BLOCK])))
        header["planes"].append({"frames": frames, "ones": counts})
        values = np.concatenate([values.compress(~ones), values.compress(ones)])
    head = json.dumps(header, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *body])


class Shard:
    """Reader of one shard's bytes. Blocks are decompressed as they are asked for, and few are kept."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("this is no shard")
        size = struct.unpack_from("<Q", data, 8)[0]
        self.header = json.loads(data[16:16 + size])
        self._data, self._at = memoryview(data), 16 + size
        self.n, self.levels = self.header["tokens"], self.header["levels"]
        self.zeros = [self.n - p["ones"][-1] for p in self.header["planes"]]
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, where: list[int]) -> bytes:
        at = self._at + where[0]
        return zstandard.ZstdDecompressor().decompress(self._data[at:at + where[1]])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and sizes of the documents, in order."""
        raw, k = self._part(self.header["table"]), self.header["docs"]
        ids, sizes, null = np.frombuffer(raw, "<i8", k), np.frombuffer(raw, "<u8", k, 8 * k), np.frombuffer(raw, np.uint8, k, 16 * k)
        return [None if x else int(i) for i, x in zip(ids, null, strict=True)], sizes.astype(np.int64)

    def _bits(self, level: int, block: int) -> np.ndarray:
        found = self._blocks.get((level, block))
        if found is None:
            if len(self._blocks) >= 4 * self.levels:
                self._blocks.clear()
            raw = np.frombuffer(self._part(self.header["planes"][level]["frames"][block]), np.uint8)
            found = self._blocks[level, block] = np.unpackbits(raw, bitorder="little", count=min(BLOCK, self.n - block * BLOCK))
        return found

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, rest = divmod(i, BLOCK)
        before = self.header["planes"][level]["ones"][block] if block < len(self.header["planes"][level]["ones"]) else self.n - self.zeros[level]
        return before + (int(np.count_nonzero(self._bits(level, block)[:rest])) if rest else 0)

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            bit, ones = int(self._bits(level, i // BLOCK)[i % BLOCK]), self._ones(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """On the last plane, where the token's occurrences begin and where those before place i end."""
        begin, end = 0, i
        for level in range(self.levels):
            a, b = self._ones(level, begin), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        if token < 0 or token >> self.levels:
            return 0
        begin, end = self._range(token, min(max(i, 0), self.n))
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        counts = np.array(self.header["planes"][level]["ones"])
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(level, block) == bit)[k - counts[block]])

    def ids(self) -> np.ndarray:
        """All tokens, from the last plane up: each plane tells how the one below was dealt."""
        kind = _kind(self.levels)
        values = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            raw = b"".join(self._part(f) for f in self.header["planes"][level]["frames"])
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=self.n).view(bool)
            above, z = np.empty_like(values), self.zeros[level]
            above[np.flatnonzero(~ones)] = values[:z]
            above[np.flatnonzero(ones)] = values[z:] | kind(1 << (self.levels - 1 - level))
            values = above
        return values


_FILE = pa.schema([("content", pa.binary())])
_DOC = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _ended(encoder: WordEncoder, held: list[tuple[pa.Array, pa.Array]], end_id: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    ids, ends = encoder.encode_column(pa.concat_arrays([t for _, t in held]))
    return [d for names, _ in held for d in names.to_pylist()], np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def write(docs: DataFrame, vocabulary: str, end_id: int, shard_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes the documents, each followed by ``end_id``, and writes shards; returns their folder.

    Documents are dealt by ranges of their id and sorted within; a range gives one or more shards, numbered
    (range, running number) in the order of ids.
    """

    def encoded(encoder, batches):
        """(ids of documents, their tokens with the end ids, where each document's end), some MB of texts at a time."""
        held, size = [], 0
        for batch in batches:
            names, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text"))
            at = 0
            for piece in _pieces(pc.fill_null(texts, ""), AT_ONCE):
                held.append((names.slice(at, len(piece)), piece))
                at, size = at + len(piece), size + piece.nbytes
                if size >= AT_ONCE:
                    yield _ended(encoder, held, end_id)
                    held, size = [], 0
        if held:
            yield _ended(encoder, held, end_id)

    def shards(batches):
        keeps("wavelet", word_encoder.cache_clear)
        encoder = word_encoder(vocabulary)
        levels = max(encoder.size - 1, end_id, 1).bit_length()
        part, seq = TaskContext.get().partitionId(), 0
        names, sizes, parts, held = [], [], [], 0
        for doc_ids, ids, ends in encoded(encoder, batches):
            begin = done = 0
            for doc_id, end in zip(doc_ids, ends.tolist(), strict=True):
                if names and held + end - begin > shard_tokens:
                    parts.append(ids[done:begin])
                    yield (build(np.concatenate(parts), names, sizes, part, seq, levels),)
                    names, sizes, parts, held, seq, done = [], [], [], 0, seq + 1, begin
                names.append(doc_id)
                sizes.append(end - begin)
                held, begin = held + end - begin, end
            parts.append(ids[done:])
        if names:
            yield (build(np.concatenate(parts), names, sizes, part, seq, levels),)

    spark = docs.sparkSession
    bounded_batches(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The beginning of the text parts the rows of one id (or of none) among tasks; what is ordered within is the whole text.
    ordered = (named.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.substring("text", 1, 64))
               .sortWithinPartitions("doc_id", "text"))
    files = ordered.mapInArrow(lambda b: batches_of(shards(b), _FILE, 1), "content binary")
    return written_files(files, "wavelet", "\n")


def read_documents(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the shards in a folder."""

    def decoded(batches):
        for (content,) in rows_of(batches, "content"):
            shard = Shard(content)
            ids, (names, sizes) = shard.ids().astype("<u4"), shard.documents()
            ends = np.cumsum(sizes)
            for name, end, size in zip(names, ends.tolist(), sizes.tolist(), strict=True):
                yield shard.header["part"], shard.header["seq"], name, end - size, size, zlib.crc32(ids[end - size:end])

    files = spark.read.format("binaryFile").load(folder).select("content")
    docs = stored(files.mapInArrow(lambda b: batches_of(decoded(b), _DOC), "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long"), "wavelet-docs")
    # One row a shard: the running sum over shards is a sum over a list of files, not over documents.
    sizes = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", "seq", (F.sum("size").over(Window.orderBy("part", "seq")) - F.col("size")).alias("before"))
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")

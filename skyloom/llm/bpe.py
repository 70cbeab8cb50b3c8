"""BPE encoding and decoding with exact merges in linear time.

Encoder: an Aho-Corasick automaton over the vocabulary gives, for each position of a pre-token, the
longest token that starts there. Tokens are placed from left to right; a token is kept if it and its
left neighbour are *compatible*, that is if merging the two tokens' bytes by rank gives just these two
again. Otherwise the next shorter token that is a prefix is tried, and with none left the encoder takes
back the last token. A position found impossible is marked and never tried again, so the work is linear
in the length. The result equals merging pairs by rank. Decoder: all tokens' bytes lie in one array;
a table of offsets gives each token's part.

Defined results: a null text is an empty one (no tokens); special strings in a text become their own ids,
as in the vocabulary file's library; repeated rows give repeated rows; ids may be null.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, keeps, rows_of

# The public byte-level pre-tokenizer's pattern; \s is spelled out as the Unicode White_Space set.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Chunks, other pre-tokens and pairs kept in each worker. When half of them are new, those before are let go; what recurs is kept.
CHUNKS, PIECES, PAIRS = 220_000, 40_000, 250_000
_find = regex.compile(PATTERN).findall
#: The same pattern for texts below U+0250 without fractions and raised digits, where plain classes say the same.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_find_latin = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
_beyond_latin = re.compile(r"[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search
#: White space beside a space: pre-tokens may then begin elsewhere than at single spaces.
_wide_space = re.compile(rf" [{_SPACE}]|[{_SPACE}] |^[{_SPACE}]|[{_SPACE}]$").search


def pretokens(text: str) -> list[str]:
    return _find(text) if _beyond_latin(text) else _find_latin(text)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Store(dict):
    """Strings to their ids' bytes, made when missing; bounded: a new generation takes over what it needs of the last one."""

    def __init__(self, make, size: int):
        super().__init__()
        self._make, self._half, self._last = make, size // 2, {}

    def __missing__(self, key: str) -> bytes:
        ids = self._last.get(key)
        if ids is None:
            ids = self._make(key)
        if len(self) >= self._half:
            self._last = dict(self)
            self.clear()
        if len(key) <= 256:
            self[key] = ids
        return ids


class BytePairCodec:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in model["vocab"].items() if t not in added}
        size = max([*ids.values(), *added.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in ids.items():
            self.token[i] = bytes(alphabet[c] for c in t)
        #: The two parts of each merged token, and by pairs (left << 20 | right) what they merge to.
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        #: Position in the order of merges; bytes come first.
        self.rank = [-1] * size
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            self.merged[ids[a] << 20 | ids[b]] = whole
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = n, ids[a], ids[b]
        by_bytes = {t: i for i, t in enumerate(self.token) if t}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in by_bytes.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The longest other token that a token starts with, or -1.
        self.shorter = [-1] * size
        for t, i in by_bytes.items():
            self.shorter[i] = next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1)
        #: The pair table, filled as pairs occur: whether two tokens stay two when their bytes are merged by rank.
        self._fits: dict[int, bool] = {}
        self.length = [len(t) for t in self.token]
        for t, i in added.items():
            self.token[i] = t.encode()
        self.added = added
        self._special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        #: By chunk between single spaces, for the space before it too, and by pre-token without a space before it.
        self._chunks = _Store(self._chunk_ids, CHUNKS)
        self._cache = _Store(self._piece_ids, PIECES)
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.token])]).astype(np.int64)

    def _stays(self, a: int, b: int) -> bool:
        # Undo the merges at the border, the latest first. A pair across the border would have been merged if
        # its rank comes before the merges that used up its two parts. Equal ranks go from left to right: a
        # merge inside the left token comes before the one across the border, one inside the right token after.
        rank, merged, left, right = self.rank, self.merged, self.left, self.right
        rank_a, rank_b = rank[a], rank[b]
        used_a = used_b = len(rank)
        while True:
            whole = merged.get(a << 20 | b)
            if whole is not None:
                mine = rank[whole]
                if mine < used_a and mine <= used_b:
                    return False
            if rank_a > rank_b:
                used_a, a = rank_a, right[a]
                rank_a = rank[a]
            elif rank_b >= 0:
                used_b, b = rank_b, left[b]
                rank_b = rank[b]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        chars = data.decode("latin-1")
        size = len(chars)
        longest = [-1] * size
        length = self.length
        for end, i in self.automaton.iter(chars):
            # Ends come in order, so a later match from the same start is longer.
            longest[end - length[i] + 1] = i
        if -1 in longest:
            raise ValueError("the vocabulary lacks a byte of this text")
        open_ = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, candidate, last = 0, longest[0], -1
        shorter, fits = self.shorter, self._fits
        while True:
            while candidate >= 0:
                end = at + length[candidate]
                if open_[end]:
                    if last < 0:
                        break
                    pair = last << 20 | candidate
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        ok = fits[pair] = self._stays(last, candidate)
                    if ok:
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at = end
                if at == size:
                    return out
                last, candidate = candidate, longest[at]
            else:
                open_[at] = 0
                candidate = out.pop()
                at -= length[candidate]
                last = out[-1] if out else -1

    def _piece_ids(self, piece: str) -> bytes:
        return struct.pack(f"<{len(out := self.encode_piece(piece.encode('utf-8', 'replace')))}I", *out)

    def _chunk_ids(self, chunk: str) -> bytes:
        first, *rest = pretokens(" " + chunk)
        if not rest:
            return self._piece_ids(first)
        return b"".join([self._chunks[first[1:]] if len(first) > 1 else self._cache[first], *map(self._cache.__getitem__, rest)])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._special is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[part].to_bytes(4, "little") if part in self.added else self._plain(part) for part in self._special.split(text) if part)

    def _plain(self, text: str) -> bytes:
        if _wide_space(text):
            return b"".join(map(self._cache.__getitem__, pretokens(text)))
        # No pre-token goes on over a single space, so the chunks between them are encoded one by one.
        first, *rest = text.split(" ")
        return b"".join([*map(self._cache.__getitem__, pretokens(first)), *map(self._chunks.__getitem__, rest)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64, copy=False)
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        end = np.cumsum(size)
        if not len(ids) or not end[-1]:
            return b""
        at = np.repeat(start - (end - size), size)
        at += np.arange(end[-1])
        return self.blob[at].tobytes()


@lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: each document's token ids, 4 bytes each, little-endian."""

    def run(batches):
        keeps("bpe", codec.cache_clear)
        c = codec(vocabulary)
        return batches_of(((d, c.encode(t)) for d, t in rows_of(batches, "doc_id", "text")), _ENCODED, 512)

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of what ``encode`` returned."""

    def run(batches):
        keeps("bpe", codec.cache_clear)
        c = codec(vocabulary)
        return batches_of(((d, c.decode(np.frombuffer(i or b"", "<u4"))) for d, i in rows_of(batches, "doc_id", "ids")), pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), 512)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes each document in one pass."""

    def digests(c: BytePairCodec, doc_id, text):
        ids = c.encode(text)
        decoded = c.decode(np.frombuffer(ids, "<u4"))
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def run(batches):
        keeps("bpe", codec.cache_clear)
        c = codec(vocabulary)
        return batches_of((digests(c, d, t) for d, t in rows_of(batches, "doc_id", "text")), _DIGEST)

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

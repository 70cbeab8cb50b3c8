"""Words of many texts at once: texts stay the bytes of an Arrow column, words are places in it.

A word is a maximal run of bytes that a table of 256 entries maps to other than zero; the table also folds case. All
separators here are single ASCII bytes, so a word's bytes are always whole characters. Texts of any length are walked
in pieces of about ``PIECE`` bytes, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of texts worked on at once, and of those hashed at once; longer words are hashed one by one.
PIECE, BLOCK, LONG_WORD = 2 << 20, 1 << 17, 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def table(separators: bytes | list[int]) -> np.ndarray:
    """The byte table for words parted by ``separators``: 0 for them, else the byte with A to Z in lower case."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[list(separators)] = 0
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after the other, and where each text begins, with the end of the last. Null: empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, folding: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that cut no word: they end where a text ends, or else behind a separator."""
    begin, n = 0, len(data)
    while begin < n:
        end = begin + size
        if end >= n:
            end = n
        elif (text := int(at[np.searchsorted(at, end, "right") - 1])) > begin:
            end = text
        else:
            there = np.flatnonzero(folding[data[begin:end]] == 0)
            if len(there):
                end = begin + int(there[-1]) + 1
            else:  # one word longer than a piece
                stop = int(at[np.searchsorted(at, end, "left")])
                while end < stop and folding[data[end]]:
                    there = np.flatnonzero(folding[data[end:min(stop, end + size)]] == 0)
                    end = end + int(there[0]) if len(there) else min(stop, end + size)
        yield begin, end
        begin = end


def bounds(folded: np.ndarray, begin: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes from ``begin`` on, given folded; a text's beginning parts words too."""
    inside = np.zeros(len(folded) + 2, np.bool_)
    inside[1:-1] = folded != 0
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = at[(at > begin) & (at < begin + len(folded))] - begin
    starts[edge] |= folded[edge] != 0
    ends[edge - 1] |= folded[edge - 1] != 0
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Hashes:
    """64-bit hashes of words: sums of bytes times powers, as differences of one running sum."""

    def __init__(self) -> None:
        n = BLOCK + LONG_WORD
        self.powers = np.cumprod(np.full(n, _BASE, _U), dtype=_U)
        self.inverse = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), _U), dtype=_U)

    def of(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), _U)
        long = np.flatnonzero(ends - starts > LONG_WORD)
        first = 0
        while first < len(starts):
            last = int(np.searchsorted(starts, starts[first] + BLOCK, "left"))
            inner = long[np.searchsorted(long, first):np.searchsorted(long, last)]
            if len(inner) and inner[0] > first:
                last = int(inner[0])
            if len(inner) and inner[0] == first:
                out[first], first = xxhash.xxh64_intdigest(folded[starts[first]:ends[first]].tobytes()), first + 1
                continue
            low = starts[first]
            part = folded[low:ends[last - 1]].astype(_U)
            part *= self.powers[:len(part)]
            summed = np.zeros(len(part) + 1, _U)
            np.cumsum(part, out=summed[1:])
            s = starts[first:last] - low
            out[first:last] = (summed[ends[first:last] - low] - summed[s]) * self.inverse[s]
            first = last
        return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))

"""Words and byte strings of many texts as numpy arrays.

Texts of a batch stand in one byte buffer.  Hashes of words, and of any byte
range, come from prefix sums of a polynomial over random values of the bytes,
modulo 2**64; a final mix spreads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftline.llm.shared import hold

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random odd base, its inverse modulo 2**64, and a random value for each byte.
BASE = int(_RNG.integers(1 << 62, 1 << 63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = _RNG.integers(1 << 63, (1 << 64) - 1, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    hold("powers", _powers.clear)
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = -(-n // (1 << 18)) * (1 << 18)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty.  Offsets start at 0."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Prefix:
    """Hashes of byte ranges of a buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges, not yet mixed with their lengths."""
        return mix64((self.sums[end] - self.sums[begin]) * self.back[begin])

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of the ranges of one length at every position."""
        return mix64((self.sums[length:] - self.sums[: len(self.sums) - length]) * self.back[: len(self.sums) - length])


#: Byte classes: a word byte is True.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of the texts of a column, with A-Z in lower case."""

    def __init__(self, column: pa.Array, is_word: np.ndarray):
        raw, self.offsets = buffer_of(column)
        self.data = LOWER[raw]
        inside = is_word[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets[:-1]] = True  # a text ends every word before it
        edge[n] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Index of the first word of each text, and of one past the last.
        self.bounds = np.searchsorted(self.begin, self.offsets)
        self.hash = mix64(Prefix(self.data).ranges(self.begin, self.end) + (self.end - self.begin).astype(np.uint64)) if n else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.begin)

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.begin[i:j], self.end[i:j])]

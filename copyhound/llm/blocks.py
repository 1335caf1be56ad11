"""Vectorised text blocks: the words and space-led pieces of many texts at once, hashed in numpy.

The operators run these inside `mapInArrow`. A block is a bounded slice of the texts of an Arrow batch, held as
one byte array with the offsets of its texts, so a task's memory follows the block (or its longest text), not the
partition. Hashes are 64-bit polynomials over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes that begin a character which is certainly not white space.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
SOLID[0xC3:0xF5] = True
SOLID[[0xE1, 0xE2, 0xE3]] = False
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
PRINTED = np.zeros(256, bool)
PRINTED[0x21:0x7F] = True
PUNCTUATION = PRINTED & ~LETTER
PUNCTUATION[48:58] = False
_BYTE = [np.random.default_rng(k).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1) for k in (11, 12)]
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` bytes each; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for the slices of a column."""
    data, off = flat(column)
    for i, j in slices(off, limit):
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK_BYTES + 4096)
        base = _BASES[which] | 1
        inverse = pow(base, -1, 1 << 64)

        def table(b: int) -> np.ndarray:
            out = np.ones(n, np.uint64)
            done = 1
            while done < n:
                step = min(done, n - done)
                out[done:done + step] = out[:step] * _U(pow(b, done, 1 << 64))
                done += step
            return out

        have = (table(base), table(inverse))
        if n <= 4 * BLOCK_BYTES:  # tables for one very long text aren't kept
            _POW[which] = have
    return have


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(which, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[which][data] * power[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def runs(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the runs of solid bytes, cut at the texts' offsets, and for each text the number of runs before it
    (one more entry)."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(solid))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the words `[^\\x20\\x09-\\x0D]+`, and for each text the number of words before it (one more entry)."""
    return runs(~WHITE[data], off)


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts where the pattern of a byte-level vocabulary always ends a unit, whatever stands around:

    before a space that a solid character follows; between an ASCII letter and ASCII punctuation; before and after
    a line feed that stands alone between solid characters. Returns (start, end) of the pieces and, for each text,
    the number of pieces before it (one more entry)."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        solid = SOLID[data]
        cut[:-2] = (data[:-1] == 0x20) & solid[1:]
        cut[1:-1] |= LETTER[data[:-1]] & PUNCTUATION[data[1:]]
        lone = (data[1:-1] == 0x0A) & PRINTED[data[:-2]] & solid[2:]
        cut[1:-2] |= lone
        cut[2:-1] |= lone
    cut[off] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    return start, end, np.searchsorted(start, off)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated ranges first[i] .. first[i] + size[i] - 1."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - size), size)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 for an empty range."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class HashTable:
    """64-bit keys to entry numbers 0, 1, 2, ..., looked up and filled a whole array at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entries of the keys, -1 for a key that isn't there."""
        mask = _U((1 << self.bits) - 1)
        slot = (keys & mask).astype(np.int64)
        out = self.entry[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            found = self.entry[slot[open_]]
            out[open_] = found
            open_ = open_[(found >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet, numbered on from the last entry."""
        if (self.count + len(keys)) * 2 > len(self.keys):
            old, numbers = self.keys[self.entry >= 0], self.entry[self.entry >= 0]
            while (self.count + len(keys)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._place(old, numbers)
        self._place(keys, np.arange(self.count, self.count + len(keys), dtype=np.int32))
        self.count += len(keys)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys & _U(mask)).astype(np.int64)
        while len(keys):
            free = self.entry[slot] < 0
            tried = np.where(free, slot, -1)
            self.entry[tried[free]] = numbers[free]  # of keys that want one slot, one gets it
            won = free.copy()
            won[free] = self.entry[slot[free]] == numbers[free]
            self.keys[slot[won]] = keys[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + 1) & mask

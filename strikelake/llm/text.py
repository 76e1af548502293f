"""Vectorised reading of Arrow string columns: word bounds and 64-bit word hashes over raw UTF-8.

A batch is cut into chunks of whole texts of about ``CHUNK`` bytes, so that the arrays stay small whatever
the batch size of the session is; a longer text is a chunk of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 4_000_000
_PAD = 8  # bytes behind the data that 8-byte loads may touch
_LONG = 64  # words beyond so many bytes are hashed one by one

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set within the given ranges, both ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


# Words that white space divides, and words of ASCII letters, digits and all that is not ASCII.
BLANK_WORDS = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORDS = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


@dataclass
class Chunk:
    """Texts ``lo`` to ``hi`` of a batch; ``offsets`` bound each text within ``data``, which is padded."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        piece = data[offsets[lo]:offsets[hi]]
        padded = np.zeros(len(piece) + _PAD, np.uint8)
        padded[:len(piece)] = LOWER[piece] if lower else piece
        yield Chunk(lo, hi, padded, offsets[lo:hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Byte bounds of every word; words ``first[i]`` to ``first[i + 1]`` belong to text ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(chunk: Chunk, table: np.ndarray) -> Words:
    n = chunk.size
    inside = table[chunk.data[:n]]
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(chunk.offsets), np.int64))
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    bounds = chunk.offsets[:-1]
    before[bounds[bounds < n]] = False  # a word never goes on into the next text
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    bounds = chunk.offsets[1:] - 1
    after[bounds[bounds >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal for equal bytes, wherever they stand."""
    length = ends - starts
    h = mix(length.astype(np.uint64) * _GOLD + np.uint64(1))
    at8 = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    left = np.flatnonzero((length > 0) & (length <= _LONG))
    done = 0
    while len(left):
        rest = length[left] - done
        word = at8[starts[left] + done] & _KEEP[np.minimum(rest, 8)]
        h[left] = mix((h[left] ^ word) + _GOLD)
        done += 8
        left = left[rest > 8]
    long = np.flatnonzero(length > _LONG)
    view = memoryview(data)
    h[long] = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return h


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and the index of each run's first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        whole = (whole ^ hashes[k:n - width + 1 + k]) * (_MIX_A + np.uint64(2 * k)) + _GOLD
        whole ^= whole >> np.uint64(29)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n - width + 1] == text[width - 1:])
    return mix(whole[at]), at


def repeated(values: np.ndarray) -> np.ndarray:
    """Flags of the values that occur more than once."""
    if len(values) < 2:
        return np.zeros(len(values), bool)
    s = np.sort(values)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values

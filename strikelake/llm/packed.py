"""Rows of packed arrays: what tasks send to a bucket goes as one row of bytes per kind, not as a row per value."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard

SCHEMA = "bucket bigint, kind int, x binary, y binary, z binary, s binary"
BATCH = 4_000_000
NAMES = ["bucket", "kind", "x", "y", "z", "s"]


def row(bucket: int, kind: int, *values: bytes | None) -> pa.RecordBatch:
    values = [*values, *[None] * (4 - len(values))]
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int64()), pa.array([kind], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], names=NAMES)


def several(bucket: Sequence[int], kind: int, values: Iterable[Sequence[bytes]]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with its values, in batches of about ``BATCH`` bytes."""
    held, size, done = [], 0, 0
    for k, row_values in enumerate(values):
        held.append([*row_values, *[None] * (4 - len(row_values))])
        size += sum(map(len, row_values))
        if size >= BATCH or k == len(bucket) - 1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[done:k + 1], pa.int64()), pa.array([kind] * len(held), pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*held))], names=NAMES)
            held, size, done = [], 0, k + 1


# A state for every value costs more than a small value does.
@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def press(value: bytes) -> bytes:
    return _compressor().compress(value)


def unpress(value: bytes) -> bytes:
    return _decompressor().decompress(value)


def rows(bucket: np.ndarray, kind: int, *columns: np.ndarray, press: bool = False) -> Iterator[pa.RecordBatch]:
    """One row per bucket with its share of the columns as bytes, in their order, compressed if ``press``."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(edge[1:], len(bucket))
    form = _compressor().compress if press else bytes
    parts = [pa.array([form(c[i:j].tobytes()) for i, j in zip(edge, ends)], pa.binary()) for c in columns]
    parts += [pa.nulls(len(edge), pa.binary())] * (4 - len(parts))
    yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int64)), pa.array(np.full(len(edge), kind, np.int32)), *parts], names=NAMES)

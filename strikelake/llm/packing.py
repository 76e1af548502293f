"""Token ids packed best-fit-decreasing into fixed-length rows and written as binary matrices.

Texts become byte-level BPE ids. A text falls apart at ASCII white space into stretches that the pattern of the
vocabulary never crosses, so each distinct stretch of a task is encoded once and kept; that changes no id. A document
longer than a row is split into pieces without losing a token. Pieces go, longest first, into the open row with the
least sufficient space, found by a segment tree over capacities; a new row opens if none fits.

Packing needs no shuffle: every task packs its documents in blocks of about ``BLOCK_TOKENS``, so memory is bounded by
the block (or by one longer text) and a block leaves at most its own last rows partly empty. The output is one row
per matrix of at most ``MATRIX_ROWS`` packed rows: ids, position ids that restart with every segment, and cumulative
segment lengths over the flattened matrix, all as little-endian bytes, with the list of (doc_id, offset, length) of the
segments in order. Padding at a row's end is a segment of its own without a document.

Defined results: null and empty texts have only the end mark; repeated rows are packed each; a null doc_id is kept;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.llm import text as tx

# Where the vocabulary files lie; the driver reads them and the tasks get their content.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW = 2048  # tokens of a packed row
MATRIX_ROWS = 64
BLOCK_TOKENS = 2_000_000
KEPT_STRETCHES = 300_000  # encoded stretches that a task remembers

_BLANK = tx.byte_set((0x20, 0x20), (0x09, 0x0D))
SCHEMA = ("rows int, ids binary, position_ids binary, cu_seqlens binary, n_tokens bigint, "
          "segments array<struct<doc_id:bigint,offset:bigint,length:int,row:int>>")


class Encoder:
    """Byte-level BPE with a memory of encoded stretches."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _learn(self, hashes: np.ndarray, stretches: list[str]) -> None:
        coded = [self.coder.encode_ordinary(s) for s in stretches]
        count = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((t for c in coded for t in c), self.kind, int(count.sum()))
        self.known.update(zip(hashes.tolist(), range(len(self.count), len(self.count) + len(count))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk in a row, and where each text begins."""
        starts, first = stretches(chunk)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(chunk.offsets), np.int64)
        ends = np.append(starts[1:], chunk.size)
        values, at, of = np.unique(tx.hash_ranges(chunk.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_STRETCHES:
            self._reset()
        keys = values.tolist()
        new = np.array([k not in self.known for k in keys])
        if new.any():
            spots = at[new]
            data = chunk.data.tobytes()
            self._learn(values[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[spots], ends[spots])])
        seat = np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[of]
        count = self.count[seat]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.start[seat] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[first]


def stretches(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin, and the first stretch of each text: at a text's start, and at white space that follows
    something surely not white space (ASCII, or a letter of two bytes led by 0xC3)."""
    n = chunk.size
    data = chunk.data[:n]
    blank = _BLANK[data]
    begins = np.zeros(n, bool)
    if n:
        begins[1:] = blank[1:] & ~blank[:-1] & (data[:-1] < 0x80)
        begins[2:] |= blank[2:] & (data[:-2] == 0xC3) & (data[1:-1] >= 0x80)
        bounds = chunk.offsets[:-1]
        begins[bounds[bounds < n]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, chunk.offsets)


class Capacities:
    """Open rows by the space left in them; a segment tree finds the least space that suffices."""

    def __init__(self, size: int):
        self.leaf = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaf)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        i = space + self.leaf
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, row) of an open row with the least space of at least ``need``."""
        i = need + self.leaf
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up until a right neighbour holds rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaf:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        space = i - self.leaf
        row = self.rows[space].pop()
        if not self.rows[space]:
            i = space + self.leaf
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return space, row


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows as lists of piece numbers, by best fit decreasing. Lengths are 1 to ``size``."""
    order = np.argsort(-lengths, kind="stable")
    rows: list[list[int]] = []
    open_rows = Capacities(size)
    for k in order.tolist():
        n = int(lengths[k])
        found = open_rows.take(n) if n < size else None
        space, row = found or (size, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(k)
        if space > n:
            open_rows.put(space - n, row)
    return rows


def _matrices(ids: np.ndarray, pieces: list[tuple], size: int, end: int) -> Iterator[pa.RecordBatch]:
    """Packed matrices of one block. Pieces are (doc_id, offset in the document, start in ``ids``, length)."""
    rows = best_fit(np.array([p[3] for p in pieces], np.int64), size)
    for top in range(0, len(rows), MATRIX_ROWS):
        part = rows[top:top + MATRIX_ROWS]
        matrix = np.full((len(part), size), end, ids.dtype)
        position = np.zeros((len(part), size), np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4"))
        bounds, segments, total = [0], [], 0
        for r, row in enumerate(part):
            at = 0
            for k in row:
                doc, offset, start, n = pieces[k]
                matrix[r, at:at + n] = ids[start:start + n]
                position[r, at:at + n] = np.arange(n)
                segments.append({"doc_id": doc, "offset": offset, "length": n, "row": r})
                at += n
                bounds.append(r * size + at)
            total += at
            if at < size:
                position[r, at:] = np.arange(size - at)
                bounds.append((r + 1) * size)
        yield pa.RecordBatch.from_pydict({
            "rows": pa.array([len(part)], pa.int32()), "ids": [matrix.tobytes()], "position_ids": [position.tobytes()],
            "cu_seqlens": [np.array(bounds, "<i4").tobytes()], "n_tokens": pa.array([total], pa.int64()),
            "segments": pa.array([segments], pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()),
                                                                 ("length", pa.int32()), ("row", pa.int32())])))})


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = ROW, block: int = BLOCK_TOKENS) -> DataFrame:
    """Packed matrices of the documents' ids, each text closed by the end mark (the first free id, also the padding)."""
    ranks = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(ranks)
        held: list[np.ndarray] = []
        pieces: list[tuple] = []
        n = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for chunk in tx.chunks(batch.column(1)):
                ids, first = coder.encode(chunk)
                for i in range(chunk.hi - chunk.lo):
                    own = np.append(ids[first[i]:first[i + 1]], ids.dtype.type(coder.end))
                    held.append(own)
                    pieces += [(doc_ids[chunk.lo + i], at, n + at, min(size, len(own) - at)) for at in range(0, len(own), size)]
                    n += len(own)
                    if n >= block:
                        yield from _matrices(np.concatenate(held), pieces, size, coder.end)
                        held, pieces, n = [], [], 0
        if n:
            yield from _matrices(np.concatenate(held), pieces, size, coder.end)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """One Parquet row per matrix; a reader needs one row at a time."""
    packed.write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def unpack(packed: DataFrame, vocabulary: str = VOCABULARY, size: int = ROW) -> DataFrame:
    """``doc_id, text`` from packed matrices: the pieces of a document are put together by their offsets.
    Needs unique ids; the end mark is dropped."""
    ranks = Path(vocabulary).read_bytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = Encoder(ranks).kind
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, last = np.frombuffer(row["ids"], kind).reshape(row["rows"], size), 0, -1
                out = []
                for s in row["segments"]:
                    at = at if s["row"] == last else 0
                    last = s["row"]
                    out.append((s["doc_id"], s["offset"], ids[last, at:at + s["length"]].astype("<u4").tobytes()))
                    at += s["length"]
                doc, offset, piece = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(offset, pa.int64()), pa.array(piece, pa.binary())],
                                                 names=["doc_id", "offset", "piece"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(ranks)
        for batch in batches:
            texts = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["piece"] for p in parts), "<u4")
                texts.append(coder.coder.decode(ids[ids != coder.end].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    pieces = packed.mapInArrow(cut, "doc_id bigint, offset bigint, piece binary")
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
    return whole.mapInArrow(decode, "doc_id bigint, text string")

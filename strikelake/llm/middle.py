"""Fill-in-the-middle samples by a piece table.

A document is a row of descriptors (buffer, start, end) over two buffers that never change: the texts as they came and
the sentinels. Cutting at two token bounds splits the only descriptor into prefix, middle and suffix; an arrangement puts
a sentinel's descriptor before each part and permutes the parts. Characters move only when an output is asked for, and
hashes take in one descriptor after the other. ``restore`` works from an output and its form alone: it cuts the output at
its sentinels, drops their descriptors and permutes the parts back.

A token is white space and the word behind it, or the white space at the end. Which tokens bound the middle, and the
form, follow from a hash of the seed and the id, so a document comes out alike wherever it stands. No row is shuffled.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel, stay plain; a null id counts
as an empty one; texts of any length are cut whole; repeated rows come out alike; columns beside id and text are not
carried, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strikelake.llm import text as tx

# Seed, shares in percent and sentinels of the checked query.
SEED, RATE, SPM_SHARE = 42, 50, 80
SENTINELS = ("<P>", "<M>", "<S>")  # of prefix, middle and suffix

PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
ARRANGEMENTS = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
TEXT, MARKS = 0, 1  # buffers

SCHEMA = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, "
          "output_sha256 string")
RESTORED = "restored string, restored_sha256 string"


@dataclass
class PieceTable:
    """Descriptors of documents that have equally many: ``rows[document, piece]`` is (buffer, start, end)."""

    buffers: tuple[memoryview, memoryview]
    rows: np.ndarray

    @classmethod
    def whole(cls, buffers: tuple[memoryview, memoryview], start: np.ndarray, end: np.ndarray) -> PieceTable:
        """One descriptor per document: all of its text."""
        rows = np.zeros((len(start), 1, 3), np.int64)
        rows[:, 0, 1], rows[:, 0, 2] = start, end
        return cls(buffers, rows)

    def cut(self, at: np.ndarray) -> PieceTable:
        """Every document's first text descriptor that reaches place ``at`` of the buffer becomes two."""
        n, pieces, _ = self.rows.shape
        fits = (self.rows[:, :, 0] == TEXT) & (self.rows[:, :, 1] <= at[:, None]) & (at[:, None] <= self.rows[:, :, 2])
        hit, doc = fits.argmax(axis=1), np.arange(n)
        source = np.arange(pieces + 1)[None, :] - (np.arange(pieces + 1)[None, :] > hit[:, None])
        rows = self.rows[doc[:, None], source]
        rows[doc, hit, 2] = at
        rows[doc, hit + 1, 1] = at
        return PieceTable(self.buffers, rows)

    def permute(self, order: tuple[int, ...]) -> PieceTable:
        """Pieces in another order; those that ``order`` leaves out are dropped."""
        return PieceTable(self.buffers, self.rows[:, list(order)])

    def marked(self, marks: np.ndarray) -> PieceTable:
        """A descriptor of the sentinel buffer before each piece; ``marks`` has their bounds in order."""
        n, pieces, _ = self.rows.shape
        rows = np.empty((n, 2 * pieces, 3), np.int64)
        rows[:, 0::2, 0], rows[:, 0::2, 1:] = MARKS, marks
        rows[:, 1::2] = self.rows
        return PieceTable(self.buffers, rows)

    def stream(self, doc: int) -> Iterator[memoryview]:
        """The bytes of a document, descriptor by descriptor, without a copy."""
        for buffer, start, end in self.rows[doc].tolist():
            yield self.buffers[buffer][start:end]

    def bytes(self, doc: int) -> bytes:
        return b"".join(self.stream(doc))

    def sha256(self, doc: int) -> str:
        h = hashlib.sha256()
        for piece in self.stream(doc):
            h.update(piece)
        return h.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(i) for i in np.argsort(order))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from a hash of seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))


def _mark_bounds(sentinels: tuple[str, str, str]) -> tuple[bytes, np.ndarray]:
    raw = [s.encode() for s in sentinels]
    ends = np.cumsum([len(r) for r in raw])
    return b"".join(raw), np.stack([ends - [len(r) for r in raw], ends], axis=1)


def _transform_chunk(chunk: tx.Chunk, ids: list[int | None], seed: int, rate: int, spm_share: int,
                     sentinels: tuple[str, str, str], keep_output: bool) -> pa.RecordBatch:
    docs, off = len(ids), chunk.offsets
    marks, bounds = _mark_bounds(sentinels)
    raw_marks = [s.encode() for s in sentinels]
    buffers = (memoryview(chunk.data), memoryview(marks))
    words = tx.words(chunk, tx.BLANK_WORDS)
    last = np.where(words.counts > 0, words.ends[np.maximum(words.first[1:] - 1, 0)] if len(words.ends) else 0, off[:-1])
    n = words.counts + (last < off[1:])
    chars = np.zeros(chunk.size + 1, np.int64)
    np.cumsum((chunk.data[:chunk.size] & 0xC0) != 0x80, out=chars[1:])

    def place(doc: int, units: int) -> int:
        """Where the first ``units`` tokens of a document end."""
        if units == 0:
            return int(off[doc])
        if units > words.counts[doc]:
            return int(off[doc + 1])
        return int(words.ends[words.first[doc] + units - 1])

    forms, cuts = [], np.zeros((docs, 2), np.int64)
    for i, doc_id in enumerate(ids):
        h1, h2, h3, h4 = draws(seed, doc_id)
        if off[i] == off[i + 1] or h3 % 100 >= rate or any(m in chunk.raw(i) for m in raw_marks):
            forms.append(PLAIN)
            continue
        forms.append(SPM if h4 % 100 < spm_share else PSM)
        units = int(n[i]) + 1
        cuts[i] = [place(i, u) for u in sorted((h1 % units, h2 % units))]

    form = np.array(forms, object)
    outputs, hashes = [None] * docs, [None] * docs
    for name in (PLAIN, PSM, SPM):
        own = np.flatnonzero(form == name)
        table = PieceTable.whole(buffers, off[own], off[own + 1])
        if name != PLAIN:
            order = ARRANGEMENTS[name]
            table = table.cut(cuts[own, 0]).cut(cuts[own, 1]).permute(order).marked(bounds[list(order)])
        for k, i in enumerate(own.tolist()):
            hashes[i] = table.sha256(k)
            if keep_output:
                outputs[i] = table.bytes(k)
    cut_ = form != PLAIN
    start, a, b = off[:-1], cuts[:, 0], cuts[:, 1]
    prefix = np.where(cut_, chars[np.where(cut_, a, 0)] - chars[start], 0)
    middle = np.where(cut_, chars[np.where(cut_, b, 0)] - chars[np.where(cut_, a, 0)], 0)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
        pa.array(prefix, pa.int64(), mask=~cut_), pa.array(middle, pa.int64(), mask=~cut_),
        pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE,
              sentinels: tuple[str, str, str] = SENTINELS, keep_output: bool = True) -> DataFrame:
    """Every document with its form, bounds, output and the output's hash; ``rate`` percent are cut, ``spm_share`` percent
    of these begin with the suffix. Without ``keep_output`` the outputs are hashed from descriptors and never made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in tx.chunks(batch.column(1)):
                yield _transform_chunk(chunk, ids[chunk.lo:chunk.hi], seed, rate, spm_share, sentinels, keep_output)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)


def _restore_chunk(chunk: tx.Chunk, forms: list[str], sentinels: tuple[str, str, str]) -> tuple[list[bytes], list[str]]:
    buffers, off = (memoryview(chunk.data), memoryview(b"")), chunk.offsets
    form = np.array(forms, object)
    texts, hashes = [b""] * len(forms), [""] * len(forms)
    for name in (PLAIN, PSM, SPM):
        own = np.flatnonzero(form == name)
        table = PieceTable.whole(buffers, off[own], off[own + 1])
        if name != PLAIN:
            order = ARRANGEMENTS[name]
            raw = [chunk.raw(i) for i in own.tolist()]
            at = np.zeros(len(own), np.int64)
            for k, part in enumerate(order):
                mark = sentinels[part].encode()
                # The texts hold no sentinel, so the next one found is the one put there.
                at = np.array([r.index(mark, a) for r, a in zip(raw, at.tolist())], np.int64)
                if k:
                    table = table.cut(off[own] + at)
                table = table.cut(off[own] + at + len(mark))
                at = at + len(mark)
            table = table.permute((1, 3, 5)).permute(inverse(order))
        for k, i in enumerate(own.tolist()):
            texts[i], hashes[i] = table.bytes(k), table.sha256(k)
    return texts, hashes


def restore(samples: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Add the text before the transformation, made from ``output`` and ``form``, and its hash."""
    names = samples.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(names.index("form")).to_pylist()
            for chunk in tx.chunks(batch.column(names.index("output"))):
                texts, hashes = _restore_chunk(chunk, forms[chunk.lo:chunk.hi], sentinels)
                own = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())],
                    names=[*names, "restored", "restored_sha256"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInArrow(run, f"{shape}, {RESTORED}")


def digest(docs: DataFrame) -> DataFrame:
    """Form, bounds and hashes of every document, without the texts."""
    return restore(transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")

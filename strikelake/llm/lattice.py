"""SentencePiece encoding as a relational lattice, and decoding.

Texts are split before every space and around control characters, which no piece spans, into words; a word holds its
leading space, and a text's first word the one that SentencePiece puts before a text. Each distinct word becomes a
lattice: its substrings up to the longest piece are exploded, equi-joined to the piece table, and the matching edges
grouped by word; a character that no piece covers gets an edge of its UTF-8 bytes. A higher-order ``aggregate`` folds
Viterbi over the edges by their ends: at every position the best score and the last piece that reaches it. The score of a path is
the sum of its pieces' log-probabilities, as the unigram algorithm has it. A merge-based table has ranks in their place
(0, -1, -2, ...), which the law of Zipf and Mandelbrot turns into logarithms, -ln(rank + ``SHIFT``); ids can there differ
from those of merging step by step, the decoded text can't.

A corpus has far fewer distinct words than words. Tasks turn their documents in chunks of about ``CHUNK`` bytes into
a dictionary and the documents as dictionary numbers. Only the dictionaries are shuffled by word, the results go back
packed per chunk, and the documents, a byte or two a word, meet them there. A frequent word has one row per chunk, so no
group is larger than the number of chunks; nothing grows with a document's or a source's share.

A word beyond ``LONGEST`` code points is cut around its characters that no piece has, where no edge can cross, so texts without
spaces in scripts the table lacks come out as from their whole lattice. Only a stretch of more than ``LONGEST`` covered characters
is cut between two of them, and its parts are encoded by themselves.

Defined results: null and empty texts have no ids; a repeated row is encoded each time; a null doc_id is kept; extra
columns are ignored; an empty table gives no rows. A text's own U+2581 goes through its bytes, so every text comes back.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.llm import text as tx
from strikelake.llm.components import stored

# Where the model file lies; the driver reads it, tasks get its pieces.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
CHUNK = 12_000_000
PACK_ROWS = 100_000  # words that a task packs at once
LONGEST = 2048
UNKNOWN = 10.0  # how far below the worst piece an uncovered character scores
SHIFT = 1000.0
BYTES = 1 << 24  # codes from here on are code points
LOW = 30  # bits of a length's complement and a code
PLACE = 12  # bits of a place in a word
WORDS = 1_500_000  # bytes of texts per partition of words
MARK = "▁"

VOCABULARY, DOCUMENTS = range(2)
PACKED = "chunk bigint, kind int, numbers binary, counts binary, ids binary, doc_id array<bigint>"


class Pieces:
    """Pieces that can stand in a word, by text with a plain space; and all ids' bytes."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.rows: list[tuple[str, int, float]] = []
        self.bytes: list[bytes] = []
        self.fallback = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            plain = piece.replace(MARK, " ")
            self.bytes.append(plain.encode())
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.fallback[value], self.bytes[i] = i, bytes([value])
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes[i] = b""
            elif " " not in plain[1:] and all(c >= " " for c in plain):
                self.rows.append((plain, i, float(sp.get_score(i))))
        if all(s <= 0 and s == int(s) for _, _, s in self.rows):  # ranks of merges
            self.rows = [(p, i, -math.log(SHIFT - s)) for p, i, s in self.rows]
        self.longest = max(len(p) for p, _, _ in self.rows)
        # Whole numbers, so that sums are exact, and so small that 33 bits hold the worst path of a longest word.
        worst = min(s for _, _, s in self.rows) - UNKNOWN
        scale = 2 ** min(20, math.floor(math.log2((1 << 33) / (LONGEST * -worst))))
        self.unknown = round(worst * scale)
        self.rows = [(p, i, round(s * scale)) for p, i, s in self.rows]
        known = {c for p, _, _ in self.rows for c in p}
        # Flags of the code points that some piece has; no piece spans any other.
        self.covered = np.zeros(0x110000, bool)
        self.covered[[ord(c) for c in known]] = True


@lru_cache(maxsize=4)
def pieces(model: str = MODEL) -> Pieces:
    return Pieces(model)


# --- lattice ---------------------------------------------------------------------------------------

def encode_words(words: DataFrame, table: Pieces) -> DataFrame:
    """``word, ids`` of distinct words in ``word``; if the words are partitioned by word, nothing is shuffled.

    The piece table is as large as the vocabulary, whatever the corpus, and is broadcast. An edge is one number:
    its end, its start, and in ``LOW`` bits its length's complement and its piece, or beyond ``BYTES`` the code point of a
    character that no piece covers.
    """
    spark = words.sparkSession
    piece = F.broadcast(spark.createDataFrame([(p, i) for p, i, _ in table.rows], "piece string, id int"))
    ends = words.withColumn("n", F.length("word")).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n"))))
    spans = ends.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.col("n") - F.col("at") + 1))))
    edges = spans.withColumn("piece", F.substring("word", F.col("at"), F.col("len"))).join(piece, "piece", "left")
    edges = edges.where("id IS NOT NULL OR len = 1")
    code = F.coalesce("id", F.ascii("piece") + BYTES).cast("bigint")
    start = (F.col("at") - 1).cast("bigint")
    edge = F.shiftleft(start + F.col("len"), LOW + PLACE) + F.shiftleft(start, LOW) + F.shiftleft(31 - F.col("len").cast("bigint"), 25) + code
    grouped = edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))
    codes = grouped.select("word", viterbi(F.col("edges"), F.length("word"), table).alias("codes"))
    return codes.select("word", _spelled(F.col("codes"), table).alias("ids"))


def viterbi(edges, n, table: Pieces):
    """Codes of the best path over ``n`` positions; of equal paths the one of the shorter last piece.

    The fold goes over the edges once, sorted by their ends, the longest first. It keeps one number per position: the best
    score, and in ``LOW`` bits the last piece's length (its complement, so that the shorter is greater) and its code. The first
    edge of a position, there is always one of a character, adds its number; a better one later on replaces it. A second
    fold walks back along the lengths.
    """
    by_id = [0] * len(table.bytes)
    for _, i, s in table.rows:
        by_id[i] = s
    scores = F.from_json(F.lit(json.dumps(by_id)), "array<bigint>")

    def step(best, e):
        end, code = F.shiftright(e, LOW + PLACE).cast("int"), e.bitwiseAND((1 << 25) - 1).cast("int")
        before = F.get(best, F.shiftright(e, LOW).bitwiseAND((1 << PLACE) - 1).cast("int"))
        own = F.when(code < BYTES, F.get(scores, code)).otherwise(F.lit(table.unknown))
        reached = F.shiftleft(F.shiftright(before, LOW) + own, LOW) + e.bitwiseAND((1 << LOW) - 1)
        return (F.when(F.size(best) == end, F.concat(best, F.array(reached)))
                .when(F.element_at(best, -1) < reached, F.concat(F.slice(best, F.lit(1), end), F.array(reached)))
                .otherwise(best))

    best = F.aggregate(F.sort_array(edges), F.expr("array(0L)"), step)
    walk = F.from_json(F.lit('{"skip":0,"codes":[]}'), "struct<skip:bigint,codes:array<int>>")

    def back(acc, b):
        here = F.struct((30 - F.shiftright(b, 25).bitwiseAND(31)).alias("skip"), F.concat(F.array(b.bitwiseAND((1 << 25) - 1).cast("int")), acc["codes"]).alias("codes"))
        return F.when(acc["skip"] == 0, here).otherwise(F.struct((acc["skip"] - 1).alias("skip"), acc["codes"].alias("codes")))

    return F.aggregate(F.reverse(F.slice(best, F.lit(2), n)), walk, back, lambda acc: acc["codes"])


def _spelled(codes, table: Pieces):
    """Ids of codes: a code point becomes the ids of its UTF-8 bytes."""
    fallback = F.from_json(F.lit(json.dumps(table.fallback)), "array<int>")

    def spell(c):
        point = c - BYTES
        tail = [F.lit(128) + F.shiftright(point, 6 * k).bitwiseAND(63) for k in range(3)]
        bytes_ = (F.when(point < 0x80, F.array(point))
                  .when(point < 0x800, F.array(F.shiftright(point, 6) + 0xC0, tail[0]))
                  .when(point < 0x10000, F.array(F.shiftright(point, 12) + 0xE0, tail[1], tail[0]))
                  .otherwise(F.array(F.shiftright(point, 18) + 0xF0, tail[2], tail[1], tail[0])))
        return F.when(c < BYTES, F.array(c)).otherwise(F.transform(bytes_, lambda b: F.get(fallback, b)))

    return F.when(F.exists(codes, lambda c: c >= BYTES), F.flatten(F.transform(codes, spell))).otherwise(codes)


# --- documents as dictionary numbers ---------------------------------------------------------------

def _varint(values: np.ndarray) -> bytes:
    """Unsigned numbers as 7 bits a byte, the low ones first."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        more = size > k
        out[at[more] + k] = ((v[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[more] > k + 1) * np.uint8(128))
    return out.tobytes()


def _unvarint(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, b[:-1] < 128))
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


def _cuts(data: np.ndarray, points: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Where a long word, whose code points begin at ``points``, is cut."""
    codes = np.frombuffer(data[points[0]:].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    apart = ~covered[codes]
    here = apart.copy()
    here[1:] |= apart[:-1]
    here[0] = True
    begins = np.flatnonzero(here)
    size = np.diff(np.append(begins, len(codes)))
    # Uncovered characters in a row stay together as long as they fit.
    lone, stretches = [], []
    for b, n in zip(begins.tolist(), size.tolist()):
        if not stretches or n > 1 or not apart[b] or b - lone[-1] >= LONGEST or not apart[b - 1]:
            lone.append(b)
            stretches.extend(range(b, b + n, LONGEST))
    return points[np.array(stretches[1:], np.int64)]


def _words(chunk: tx.Chunk, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's bytes with a space before each text, where words begin, and each text's first word."""
    bounds = chunk.offsets
    filled = np.diff(bounds) > 0
    data = np.insert(chunk.data[:chunk.size], bounds[:-1][filled], 0x20)
    bounds = bounds + np.concatenate([[0], np.cumsum(filled)])
    begins = data <= 0x20
    begins[1:] |= data[:-1] < 0x20
    starts = np.flatnonzero(begins)
    length = np.diff(np.append(starts, len(data)))
    cuts = []
    for i in np.flatnonzero(length > LONGEST):
        own = data[starts[i]:starts[i] + length[i]]
        points = starts[i] + np.flatnonzero((own & 0xC0) != 0x80)
        if len(points) > LONGEST:
            cuts.append(_cuts(data[:starts[i] + length[i]], points, covered))
    if cuts:
        starts = np.sort(np.concatenate([starts, *cuts]))
    return np.append(data, np.zeros(8, np.uint8)), starts, np.searchsorted(starts, bounds)


def _dictionary(chunk: tx.Chunk, covered: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A name of the chunk by its content, its bytes, bounds of its distinct words from frequent to rare, the words as
    numbers and each text's first word."""
    data, starts, first = _words(chunk, covered)
    ends = np.append(starts[1:], len(data) - 8)
    _, at, of, n = np.unique(tx.hash_ranges(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    name = xxhash.xxh3_64_intdigest(data.tobytes(), seed=xxhash.xxh3_64_intdigest(chunk.offsets.tobytes()))
    at = at[order]
    return name - (1 << 63), data, starts[at], ends[at], rank[of], first


def _emit_vocabulary(batches: Iterator[pa.RecordBatch], covered: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> chunk, number, word."""
    for batch in batches:
        for chunk in tx.chunks(batch.column(1), limit=CHUNK):
            name, data, starts, ends, _, _ = _dictionary(chunk, covered)
            for lo in range(0, len(starts), 50_000):
                a, b = starts[lo:lo + 50_000], ends[lo:lo + 50_000]
                size = b - a
                to = np.concatenate([[0], np.cumsum(size)])
                body = data[np.repeat(a - to[:-1], size) + np.arange(to[-1])]
                word = pa.StringArray.from_buffers(len(a), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(body))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), name, np.int64)), pa.array(np.arange(
                    lo, lo + len(a), dtype=np.int32)), word], names=["chunk", "number", "word"])


def _emit_documents(batches: Iterator[pa.RecordBatch], covered: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> one packed row per chunk."""
    for batch in batches:
        for chunk in tx.chunks(batch.column(1), limit=CHUNK):
            name, _, _, _, numbers, first = _dictionary(chunk, covered)
            ids = batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([name], pa.int64()), pa.array([DOCUMENTS], pa.int32()), pa.array([_varint(numbers)], pa.binary()),
                pa.array([_varint(np.diff(first))], pa.binary()), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(pa.int64()))],
                names=["chunk", "kind", "numbers", "counts", "ids", "doc_id"])


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``size``, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, number, ids) -> packed rows per chunk: numbers as steps, counts of ids, and the ids."""
    for rows in _gathered(batches, PACK_ROWS):
        chunk, number = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)
        lists = rows.column(2)
        edge = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy().astype(np.int64)
        order = np.lexsort((number, chunk))
        for group in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            if not len(group):
                continue
            count = edge[group + 1] - edge[group]
            to = np.cumsum(count) - count
            ids = flat[np.repeat(edge[group] - to, count) + np.arange(count.sum())]
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk[group[0]]], pa.int64()), pa.array([VOCABULARY], pa.int32()),
                pa.array([_varint(np.diff(number[group], prepend=0))], pa.binary()), pa.array([_varint(count)], pa.binary()),
                pa.array([_varint(ids)], pa.binary()), pa.array([None], pa.list_(pa.int64()))],
                names=["chunk", "kind", "numbers", "counts", "ids", "doc_id"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by chunk and kind -> doc_id, n_tokens, ids."""
    now, parts, table = None, [], None
    for batch in batches:
        for row in range(batch.num_rows):
            chunk, kind, numbers, counts, ids, doc_id = (c[row].as_py() for c in batch.columns)
            if chunk != now:
                now, parts, table = chunk, [], None
            if kind == VOCABULARY:
                parts.append((np.cumsum(_unvarint(numbers)), _unvarint(counts), _unvarint(ids).astype(np.int32)))
                continue
            if table is None:
                number = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
                count = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
                flat = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.int32)])
                size = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
                start = np.full(len(size), -1, np.int64)
                size[number], start[number] = count, np.cumsum(count) - count
                table = size, start, flat
            size, start, flat = table
            words, per_text = _unvarint(numbers), _unvarint(counts)
            if len(words) and (words.max() >= len(size) or start[words].min() < 0):
                raise RuntimeError("a chunk's words are missing: the documents were read in another order; store them first")
            first = np.concatenate([[0], np.cumsum(per_text)])
            for lo in range(0, len(doc_id), 500):  # some texts at a time
                hi = min(lo + 500, len(doc_id))
                own = words[first[lo]:first[hi]]
                n = size[own]
                to = np.concatenate([[0], np.cumsum(n)])
                out = flat[np.repeat(start[own] - to[:-1], n) + np.arange(to[-1])]
                offsets = to[first[lo:hi + 1] - first[lo]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_id[lo:hi], pa.int64()), pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document. ``docs`` must give the same rows in the same order each time
    it is read, as a stored table does; else the job fails rather than mixing chunks."""
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // WORDS))
    covered = pieces(model).covered
    vocabulary = body.mapInArrow(lambda batches: _emit_vocabulary(batches, covered), "chunk bigint, number int, word string").repartition(parts, "word")
    # One row per word; with all columns in it, the words are shuffled once for this and for the join.
    distinct = vocabulary.groupBy("word").agg(F.min("chunk").alias("_chunk"), F.min("number").alias("_number"))
    coded = encode_words(distinct.where("_chunk IS NOT NULL AND _number IS NOT NULL").select("word"), pieces(model))
    # The partitions are small to bound the memory of a lattice. A task takes several one after another and packs them
    # together: a file each would cost more than their rows, as executors without Hadoop's native code start processes for every file.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = vocabulary.join(coded, "word").select("chunk", "number", "ids").coalesce(tasks).mapInArrow(_pack_words, PACKED)
    with _hashed(spark):
        back = stored(packed, "words")
    both = back.unionByName(body.mapInArrow(lambda batches: _emit_documents(batches, covered), PACKED))
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(
        _assemble, "doc_id bigint, n_tokens bigint, ids array<int>")


@contextmanager
def _hashed(spark: SparkSession) -> Iterator[None]:
    """Grouping by hash instead of sorting all edges: a partition has few enough words for that."""
    name, many = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "10000000"
    before = spark.conf.get(name)
    spark.conf.set(name, many)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of ids: the pieces' bytes in a row without the first space."""
    table = pieces(model).bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join([table[i] for i in ids])[1:].decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")

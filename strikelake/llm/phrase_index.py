"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` turns the documents of every task into shards of a positional index: for each term the sorted
positions at which it stands, one row per shard, partitioned by document as in a search cluster. Nothing is
shuffled, a hot term is spread over all shards, and a shard holds about ``text.CHUNK`` bytes of texts (or one
longer text). ``search`` takes the test items to the shards: for every window of ``WINDOW`` item words it
starts from the shard's shortest postings list among the window's terms and intersects it with the
offset-adjusted lists of the others, from rare to frequent. What is left are the exact occurrences. Proximity
matches ask the same lists whether an item's rarest terms stand within ``NEAR`` words.

The test items are a stated query set: they are sent to the tasks in blocks of at most ``BLOCK_BYTES``, as
many passes as that takes, so the bound of a broadcast holds for every size of the test table. The index
stores the postings of terms that the items use; pass ``terms=None`` to store all. With several blocks the whole
index is stored once and searched block after block; a row is named by its shard and its place in it.

Defined results: null and empty texts have no words and no hits; null, empty or wordless items have no
windows; equal texts of several items each count, an item id counts once per document; every row of the
documents gives one row, in one block or several; extra columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelake.llm import text as tx
from strikelake.llm.components import stored

WINDOW = 10
NEAR = 64  # words within which a proximity match finds an item's rarest terms
NEAR_TERMS = 4
BLOCK_BYTES = 32_000_000  # texts of test items that are sent to the tasks at once

INDEX_SCHEMA = "shard string, doc_id array<bigint>, first binary, terms binary, heads binary, positions binary"
HITS_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>, near_items array<bigint>, hits binary"
KEY_SCHEMA = "shard string, place int"  # names a row of the documents in a stored index


@dataclass
class Items:
    """Windows of the test items as rows of term hashes; a shorter item is one short window."""

    ids: np.ndarray
    terms: np.ndarray  # distinct hashes, sorted
    groups: list[tuple[np.ndarray, np.ndarray]]  # by window width: (windows as term numbers, item numbers)
    lists: list[np.ndarray]  # per item its distinct term numbers


def read_items(rows: pa.Table) -> Items:
    """Items as windows. ``rows`` has ``item_id`` and ``text``."""
    ids, hashes = rows.column("item_id").to_pylist(), []
    for chunk in tx.chunks(rows.column("text"), lower=True):
        w = tx.words(chunk, tx.ALNUM_WORDS)
        h = tx.hash_ranges(chunk.data, w.starts, w.ends)
        hashes += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    by_width: dict[int, tuple[list, list]] = {}
    lists = []
    for k, h in enumerate(hashes):
        at = np.searchsorted(terms, h)
        lists.append(np.unique(at))
        if len(at):
            width = min(WINDOW, len(at))
            rows_, of = by_width.setdefault(width, ([], []))
            rows_.append(np.lib.stride_tricks.sliding_window_view(at, width))
            of.append(np.full(len(at) - width + 1, k))
    groups = []
    for rows_, of in by_width.values():
        pair = np.unique(np.column_stack([np.concatenate(rows_), np.concatenate(of)]), axis=0)
        groups.append((pair[:, :-1], pair[:, -1]))
    return Items(np.array(ids, object), terms, groups, lists)


def build_index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """Shards of a positional index, one row each; ``terms`` restricts it to these term hashes.

    ``shard`` is a name made up when the shard is built, so it holds for a stored index.
    ``first`` bounds each document's words, ``heads`` each term's stretch of ``positions``: int64 and uint64
    arrays as little-endian bytes. Positions count the words of the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in tx.chunks(batch.column(1), lower=True):
                shard = shard_of(chunk, terms)
                yield pa.RecordBatch.from_arrays([
                    pa.array([uuid.uuid4().hex]), pa.array([ids.slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([a.tobytes()], pa.binary()) for a in shard),
                ], names=["shard", "doc_id", "first", "terms", "heads", "positions"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, INDEX_SCHEMA)


def shard_of(chunk: tx.Chunk, terms: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """``first``, ``terms``, ``heads`` and ``positions`` of one shard."""
    w = tx.words(chunk, tx.ALNUM_WORDS)
    h = tx.hash_ranges(chunk.data, w.starts, w.ends)
    if terms is None:
        at = np.argsort(h, kind="stable")
        known, edge = np.unique(h[at], return_index=True)
    elif not len(terms):
        at, edge, known = np.zeros(0, np.int64), np.zeros(0, np.int64), h[:0]
    else:
        number = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        at = np.flatnonzero(terms[number] == h)
        number = number[at]
        order = np.argsort(number.astype(np.uint16) if len(terms) < 65536 else number, kind="stable")
        number, at = number[order], at[order]
        edge = np.flatnonzero(np.diff(number, prepend=-1))
        known = terms[number[edge]]
    return w.first.astype(np.int64), known, np.append(edge, len(at)).astype(np.int64), at.astype(np.int32)


class Shard:
    """One row of the index, with its postings addressed by the items' term numbers."""

    def __init__(self, first: np.ndarray, known: np.ndarray, heads: np.ndarray, positions: np.ndarray, items: Items):
        self.first, self.positions = first, positions.astype(np.int64)
        self.low = np.zeros(len(items.terms), np.int64)
        self.count = np.zeros(len(items.terms), np.int64)
        if len(known) and len(items.terms):
            at = np.minimum(np.searchsorted(known, items.terms), len(known) - 1)
            there = known[at] == items.terms
            self.low[there] = heads[at[there]]
            self.count[there] = heads[at[there] + 1] - heads[at[there]]
        # All postings as one sorted list of (term, position), for membership by binary search.
        self.span = np.int64(self.first[-1] + 1)
        which = np.repeat(np.arange(len(items.terms)), self.count)
        stretch = np.arange(len(which)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.keys = which * self.span + self.positions[np.repeat(self.low, self.count) + stretch]

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.span + position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (position >= 0) & (position < self.span) & (self.keys[at] == key)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows that occur and the positions of their first words, every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.keys):
            return none, none
        lengths = self.count[windows]
        order = np.argsort(lengths, axis=1, kind="stable")
        alive = np.flatnonzero(lengths.min(axis=1) > 0)
        rare = windows[alive, order[alive, 0]]
        n = self.count[rare]
        which = np.repeat(alive, n)
        stretch = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[np.repeat(self.low[rare], n) + stretch] - order[which, 0]
        for step in range(1, windows.shape[1]):  # from rare to frequent
            offset = order[which, step]
            stays = self.has(windows[which, offset], start + offset)
            which, start = which[stays], start[stays]
        doc = np.searchsorted(self.first, start, "right")
        inside = (start >= 0) & (start + windows.shape[1] <= self.first[np.minimum(doc, len(self.first) - 1)])
        return which[inside], start[inside]

    def near(self, terms: np.ndarray) -> np.ndarray:
        """Documents in which the item's rarest terms stand within ``NEAR`` words of the rarest one."""
        if not len(terms) or not self.count[terms].min():
            return np.zeros(0, np.int64)
        order = terms[np.argsort(self.count[terms], kind="stable")][:NEAR_TERMS]
        seat = self.positions[self.low[order[0]]:self.low[order[0]] + self.count[order[0]]]
        doc = np.searchsorted(self.first, seat, "right")
        for term in order[1:]:
            other = self.positions[self.low[term]:self.low[term] + self.count[term]]
            low = np.maximum(seat - NEAR, self.first[doc - 1])
            high = np.minimum(seat + NEAR, self.first[doc] - 1)
            stays = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            seat, doc = seat[stays], doc[stays]
        return np.unique(doc - 1)


    def hits(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags of the hit words, how many each document has, and the distinct (document, item) pairs."""
        change = np.zeros(int(self.first[-1]) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for windows, of in items.groups:
            which, start = self.phrases(windows)
            np.add.at(change, start, 1)
            np.add.at(change, start + windows.shape[1], -1)
            pairs.append(np.column_stack([np.searchsorted(self.first, start, "right") - 1, of[which]]))
        hit = np.cumsum(change)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        return hit, total[self.first[1:]] - total[self.first[:-1]], np.unique(np.concatenate(pairs), axis=0)


def search(index: DataFrame, items: Items) -> DataFrame:
    """Per document: its shard and place in it, word and hit counts, ids of items with exact and with proximity
    matches, and the hit words as a bit set over the document's words (``hits``, null without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kinds = {"first": np.int64, "terms": np.uint64, "heads": np.int64, "positions": np.int32}
                s = Shard(*(np.frombuffer(row[k], kind) for k, kind in kinds.items()), items)
                n = len(row["doc_id"])
                hit, counts, pairs = s.hits(items)
                found: list[dict] = [{} for _ in range(n)]  # ids may repeat in the test table
                for doc, item in pairs:
                    found[doc][items.ids[item]] = None
                close: list[dict] = [{} for _ in range(n)]
                for k, terms in enumerate(items.lists):
                    for doc in s.near(terms):
                        close[doc][items.ids[k]] = None
                bits = [np.packbits(hit[s.first[i]:s.first[i + 1]]).tobytes() if counts[i] else None for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(row["doc_id"], pa.int64()), pa.array(np.diff(s.first)), pa.array(counts.astype(np.int64)),
                    pa.array([[*x] for x in found], pa.list_(pa.int64())), pa.array([[*x] for x in close], pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                ], names=["shard", "place", "doc_id", "n_words", "n_hit", "items", "near_items", "hits"])

    return index.mapInArrow(run, f"{KEY_SCHEMA}, {HITS_SCHEMA}")


def _item_blocks(benchmark: DataFrame) -> tuple[int, Iterator[Items]]:
    """How many blocks of at most about ``BLOCK_BYTES`` the test items make, by a hash of the id, and the blocks."""
    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = 1 + int(size // BLOCK_BYTES)

    def read() -> Iterator[Items]:
        for k in range(n):
            block = own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else own
            yield read_items(block.toArrow())

    return n, read()


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The test items in blocks of at most about ``BLOCK_BYTES``; all rows of an id are in one block."""
    return _item_blocks(benchmark)[1]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``search`` over all blocks of the items. One block, the usual case, needs no shuffle. With more, the whole
    index is stored and searched block after block, and each row's parts are put together by its shard and place."""
    n, blocks = _item_blocks(benchmark)
    if n == 1:
        items = next(blocks)
        return search(build_index(docs, items.terms), items).drop("shard", "place")
    index, whole = stored(build_index(docs), "index"), None
    for items in blocks:
        part = search(index, items)
        if whole is None:  # the first part has every row, the others those with matches
            whole = stored(part, "hits")
        else:
            whole = whole.unionByName(stored(part.where("n_hit > 0 OR size(near_items) > 0"), "hits"))
    return (whole.groupBy("shard", "place")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                 F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"),
                 F.collect_list("hits").alias("hits"))
            .drop("shard", "place").mapInArrow(_union_bits, HITS_SCHEMA))


def _union_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bits = [], []
        for sets in batch.column("hits").to_pylist():
            whole = None
            for b in sets:
                b = np.frombuffer(b, np.uint8)
                whole = b if whole is None else whole | b
            counts.append(0 if whole is None else int(np.unpackbits(whole).sum()))
            bits.append(None if whole is None else whole.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(counts, pa.int64()), batch.column("items"),
             batch.column("near_items"), pa.array(bits, pa.binary())],
            names=["doc_id", "n_words", "n_hit", "items", "near_items", "hits"])


def digest(found: DataFrame) -> DataFrame:
    """The hit table with its items as a digest."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their own columns. Each task indexes and searches its own
    documents, so nothing is shuffled; with several blocks of items they pass one filter after another."""
    seat = docs.columns.index("text")
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = [Shard(*shard_of(c, items.terms), items).hits(items)[1] for c in tx.chunks(batch.column(seat), lower=True)]
                if counts:
                    yield batch.filter(pa.array(np.concatenate(counts) == 0))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

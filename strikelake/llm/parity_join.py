"""Exact Jaccard join of word shingles by parity sketches.

A set of 64-bit shingle hashes is dealt into blocks by its hashes' leading bits, and every block keeps the XOR
of its hashes: the parity sketch. A shingle that only one of two sets has changes one block, so the number of
differing blocks is at most the symmetric difference, which is at most (a + b) / 7 when two sets of sizes a
and b have a Jaccard similarity of 0.75. Hence the pigeonhole join: of its non-empty blocks, in an order that
all sets share, each set emits the first d + 1, with d the largest possible difference in its size band;
two sets that link then share an emitted block. Bands are powers of 4; a set whose partner may lie in the next
band emits there too. Sets below 64 shingles have one block per shingle.

Emitted blocks travel as packed arrays dealt by a hash of the block. Where at most ``GROUP`` sets share a
block, all their pairs are candidates. A larger group gives only a star (each set with the smallest one). Once
the stars are verified, a group within one component needs nothing more (near copies); in any other group
the block is *common* (a passage that many documents share): common blocks move to the end of the order, and
the sets that had one emit their next blocks instead, among themselves, until every set has emitted d + 1 that
aren't common. A set without so many emits its common blocks as a last resort, compared across components.
So no group is expanded in full for being hot, and no pair is lost.

Candidates are checked by a second sketch, one parity bit per hash value, whose Hamming distance is a lower
bound of the same difference, and then verified on whole shingle sets. One link per set is verified first; pairs
that these links already join need no verification.

Copies (equal sets) are one node throughout, named by a 64-bit hash of the set. Hash collisions aside
(64 bits for shingles and sets), the result is exact; the chance that a set has fewer than d + 1 non-empty
blocks is below 1e-12 at 64 shingles and falls with the size.

Defined results: null, empty or wordless texts have an empty set and link with nothing; rows without a
``doc_id`` link with nothing and get a null ``component_id``; repeated rows each get a row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.llm import packed
from strikelake.llm import text as tx
from strikelake.llm.components import components, stored

WIDTH = 5  # words of a shingle
SMALL = 64  # shingles below which every shingle is its own block
GROUP = 16  # sets sharing a block up to which all their pairs are candidates
FLUSH = 2_000_000  # emitted blocks that a task packs at once
BUCKET = 1_000_000  # emitted blocks that one bucket should hold
OFTEN = 8  # sets of a window that share a block which is then tried last
MOST = 200_000  # blocks of that kind that are sent to the tasks, 8 bytes each

# Kinds of rows: emitted blocks, members of groups too large for one chunk, documents, last resorts; and in the results:
# candidate pairs, members of large groups, documents.
BLOCK, OVER, DOC, LAST = range(4)
PAIR, HOT, MEMBER = range(3)
FOUND = "kind int, x bigint, y bigint, z bigint, s binary"


def shingle_sets(chunk: tx.Chunk) -> list[np.ndarray]:
    """Per text of a chunk read with ``lower=True`` its distinct shingle hashes, sorted."""
    w = tx.words(chunk, tx.BLANK_WORDS)
    h = tx.hash_ranges(chunk.data, w.starts, w.ends)
    whole, at = tx.windows(h, w.first, WIDTH)
    bound = np.searchsorted(at, w.first)
    out = []
    for i in range(len(w.first) - 1):
        s = whole[bound[i]:bound[i + 1]]
        if not len(s) and w.first[i + 1] > w.first[i]:  # fewer words than a shingle: all of them as one
            s = np.zeros(1, np.uint64)
            for k, word in enumerate(h[w.first[i]:w.first[i + 1]]):
                s = tx.mix(s ^ tx.mix(np.array([word + np.uint64(k + 1)], np.uint64)))
        s = np.sort(s)
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def set_name(s: np.ndarray) -> int:
    """A 64-bit name of a set of sorted hashes; equal sets have equal names."""
    return int(tx.mix(np.array([np.bitwise_xor.reduce(tx.mix(s + tx._GOLD)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _bands(n: int) -> list[tuple[int, int, int]]:
    """For a set of ``n`` shingles: (band, blocks, d) of each band that it emits in; no blocks: one each."""
    out, low, band = [], 0, 0
    high = SMALL
    while n >= high:
        low, high, band = high, high * 4, band + 1
    partner = min(high - 1, 4 * n // 3)
    out.append((band, 2 * low, (n + partner) // 7))
    if 4 * n >= 3 * high:
        out.append((band + 1, 2 * high, n // 3))
    return out


def in_order(names: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Block names, which are sorted, with those of the sorted list ``often`` moved to the end."""
    if not len(often):
        return names
    late = often[np.minimum(np.searchsorted(often, names), len(often) - 1)] == names
    return np.concatenate([names[~late], names[late]])


def blocks(s: np.ndarray, role: tuple[int, int, int]) -> np.ndarray:
    """Names of all non-empty blocks in the shared order: those of several shingles first, then by hash."""
    band, m, _ = role
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    if not m:
        return np.sort(tx.mix(s ^ salt))
    seat = s >> np.uint64(65 - m.bit_length())
    edge = np.flatnonzero(np.append(True, seat[1:] != seat[:-1]))
    parity = np.bitwise_xor.reduceat(tx.mix(s + salt), edge)
    alone = np.diff(np.append(edge, len(s))) == 1
    name = tx.mix(parity ^ tx.mix(seat[edge] ^ salt)) >> np.uint64(1)
    return np.sort(name | (alone.astype(np.uint64) << np.uint64(63)))


def _bits(n: int) -> int:
    """A power of two of at least 64 and above ``n``, at most twice ``n`` beyond that."""
    return max(64, 1 << int(n).bit_length())


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits, one per leading hash bits."""
    bits = _bits(len(s))
    count = np.bincount((s >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits)
    return np.packbits(count & 1)


def _folded(a: np.ndarray, size: int) -> np.ndarray:
    """The sketch at fewer bits: neighbouring leading-bit cells fall together, their parities add."""
    bits = np.unpackbits(a)
    return bits if len(bits) == size else np.bitwise_xor.reduce(bits.reshape(size, -1), axis=1)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference."""
    size = 8 * min(len(a), len(b))
    return int((_folded(a, size) ^ _folded(b, size)).sum())


class _Emitter:
    """Gathers emitted blocks of a task and packs them, at most ``group + 1`` sets of a block each time."""

    def __init__(self, buckets: int, group: int):
        self.buckets, self.group, self.keys, self.nodes, self.n = buckets, group, [], [], 0

    def add(self, keys: np.ndarray, node: int) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.nodes.append(np.full(len(keys), node, np.int64))
        self.n += len(keys)
        if self.n >= FLUSH:
            yield from self.flush()

    def deal(self, keys: np.ndarray) -> np.ndarray:
        return (tx.mix(keys) % np.uint64(self.buckets)).astype(np.int64)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, nodes = np.concatenate(self.keys), np.concatenate(self.nodes)
        self.keys, self.nodes, self.n = [], [], 0
        keys, nodes, edge = _grouped(keys, nodes)
        size = np.diff(np.append(edge, len(keys)))
        place = np.arange(len(keys)) - np.repeat(edge, size)
        over = place > self.group  # the group is large for sure: the rest goes elsewhere, with the group's first set
        yield from packed.rows(self.deal(keys[~over]), BLOCK, keys[~over], nodes[~over])
        first = np.repeat(nodes[edge], size)
        yield from packed.rows(self.deal(nodes[over].view(np.uint64)), OVER, keys[over], nodes[over], first[over])


def _grouped(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) sorted, and where each key begins."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    if not len(keys):
        return keys, nodes, np.zeros(0, np.int64)
    new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
    keys, nodes = keys[new], nodes[new]
    return keys, nodes, np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _count_often(least: int):
    """(text) -> blocks that at least ``least`` sets of a window of about ``FLUSH`` blocks share, with counts."""

    def window(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(edge, len(keys)))
        many = size >= least
        return pa.RecordBatch.from_arrays([pa.array(keys[edge][many].view(np.int64)), pa.array(size[many])], names=["block", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for chunk in tx.chunks(batch.column(0), lower=True):
                for s in {set_name(s): s for s in shingle_sets(chunk) if len(s)}.values():
                    for role in _bands(len(s)):
                        held.append(blocks(s, role))
                        n += len(held[-1])
                if n >= FLUSH:
                    yield window(held)
                    held, n = [], 0
        if n:
            yield window(held)

    return run


def _often(docs: DataFrame, least: int) -> np.ndarray:
    """The at most ``MOST`` most frequent of these blocks. They only shape the order: common blocks known from the
    start need no further round. Which blocks are on the list never changes the result."""
    counts = docs.select("text").mapInArrow(_count_often(least), "block bigint, n bigint").groupBy("block").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "block").limit(MOST).select("block").toArrow().column(0)
    return np.sort(top.to_numpy().view(np.uint64))


def _emit_documents(buckets: int, group: int, often: np.ndarray):
    """(doc_id, text) -> the document's row and its set's first blocks; copies within a chunk emit once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(buckets, group)
        for batch in batches:
            ids = batch.column(0)
            for chunk in tx.chunks(batch.column(1), lower=True):
                sets = shingle_sets(chunk)
                names = np.array([set_name(s) if len(s) else 0 for s in sets], np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                own = ids.slice(chunk.lo, chunk.hi - chunk.lo)
                known = own.is_valid().to_numpy(zero_copy_only=False)
                doc = own.fill_null(0).to_numpy()[known]
                if len(doc):  # one row for the chunk's documents, with their sketches one after another
                    drawn = b"".join(sketch(sets[i]).tobytes() for i in np.flatnonzero(known & (sizes > 0)))
                    yield packed.row(int(out.deal(names.view(np.uint64)[:1])[0]), DOC, doc.tobytes(), names[known].tobytes(),
                                     sizes[known].tobytes(), drawn)
                seen = set()
                for s, name in zip(sets, names):
                    if len(s) and name not in seen:
                        seen.add(name)
                        for role in _bands(len(s)):
                            yield from out.add(in_order(blocks(s, role), often)[:role[2] + 1], name)
        yield from out.flush()

    return run


def _emit_all(buckets: int, group: int):
    """(node, text) -> all blocks of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(buckets, group)
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for chunk in tx.chunks(batch.column(1), lower=True):
                for i, s in enumerate(shingle_sets(chunk), chunk.lo):
                    for role in _bands(len(s)):
                        yield from out.add(blocks(s, role), nodes[i])
        yield from out.flush()

    return run


def _emit_again(buckets: int, group: int, often: np.ndarray):
    """(node, text, root, common) -> the set's first blocks that aren't common. ``common`` has (sets, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emitter(buckets, group)
        for batch in batches:
            nodes, roots, common = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for chunk in tx.chunks(batch.column(1), lower=True):
                for i, s in enumerate(shingle_sets(chunk), chunk.lo):
                    known = common[i].values  # sorted, the rarest first
                    known = known.field("block").to_numpy().view(np.uint64) if known is not None else np.zeros(0, np.uint64)
                    for role in _bands(len(s)):
                        names = in_order(blocks(s, role), often)
                        rest = names[~np.isin(names, known)]
                        yield from out.add(rest[:role[2] + 1], nodes[i])
                        lack = role[2] + 1 - len(rest)
                        if lack > 0:  # the rarest of its common blocks, with what tells sets apart
                            last = known[np.isin(known, names)][:lack]
                            told = np.array([nodes[i], roots[i], len(s), len(rest)], np.int64).tobytes()
                            drawn = sketch(s).tobytes()
                            for name, to in zip(last, out.deal(last)):
                                yield packed.row(int(to), LAST, name.tobytes(), told, drawn)
        yield from out.flush()

    return run


def _rows(kind: int, x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, s: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y),
         pa.array(z if z is not None else np.zeros(len(x), np.int64)), pa.array(s, pa.binary())
         if s else pa.nulls(len(x), pa.binary())], names=["kind", "x", "y", "z", "s"])


def _documents(x: bytes, y: bytes, z: bytes, drawn: bytes) -> pa.RecordBatch:
    """The rows of one chunk's documents."""
    sizes, sketches, at = np.frombuffer(z, np.int64), [], 0
    for n in sizes.tolist():
        length = _bits(n) // 8 if n else 0
        sketches.append(drawn[at:at + length] if n else None)
        at += length
    return _rows(MEMBER, np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), sizes, sketches)


def _pairs(nodes: np.ndarray, edge: np.ndarray, size: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of groups of at most ``group`` sets, stars of the larger ones, each pair once."""
    left, right = [], []
    for k in range(2, group + 1):
        at = edge[size == k]
        if len(at):
            i, j = np.triu_indices(k, 1)
            left.append(nodes[at[:, None] + i].ravel())
            right.append(nodes[at[:, None] + j].ravel())
    large = size > group
    first = np.repeat(edge[large], size[large])
    member = first + np.arange(len(first)) - np.repeat(np.cumsum(size[large]) - size[large], size[large])
    left.append(nodes[first][member > first])
    right.append(nodes[member][member > first])
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _meet_bucket(rows: dict[int, list[tuple]], group: int, counted: bool) -> Iterator[pa.RecordBatch]:
    def column(kind: int, k: int, of: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(r[k], of) for r in rows.get(kind, [])] or [np.zeros(0, of)])

    keys, nodes, edge = _grouped(column(BLOCK, 0, np.uint64), column(BLOCK, 1, np.int64))
    size = np.diff(np.append(edge, len(keys)))
    if len(edge):
        hot = np.repeat(size > group, size)
        yield _rows(HOT, keys[hot], nodes[hot])
        if not counted:
            yield _rows(PAIR, *_pairs(nodes, edge, size, group))
    groups: dict[bytes, list[tuple]] = {}
    for key, told, drawn in (r[:3] for r in rows.get(LAST, [])):
        groups.setdefault(key, []).append((told, drawn))
    for members in groups.values():
        if len(members) > 1:
            yield from _last_pairs(members)


TILE = 512


def _last_pairs(members: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of one common block that sizes, blocks known to differ and sketches leave possible.

    The sets of such a group hold almost only common passages. Sorted by size, each is compared with those of at most
    4/3 its size, and only pairs of different components that may link are passed on.
    """
    told = np.frombuffer(b"".join(t for t, _ in members), np.int64).reshape(-1, 4)
    order = np.argsort(told[:, 2], kind="stable")
    node, root, n, rest = told[order].T
    words = np.array([len(members[k][1]) // 8 for k in order])
    drawn = [np.frombuffer(members[k][1], np.uint64) for k in order]
    by_words = {w: np.zeros((len(order), w), np.uint64) for w in np.unique(words)}
    for w, table in by_words.items():  # at every length that some set has, those of at least that length
        for k in np.flatnonzero(words >= w):
            table[k] = drawn[k] if words[k] == w else np.packbits(_folded(drawn[k].view(np.uint8), 64 * w)).view(np.uint64)
    reach = np.searchsorted(n, 4 * n // 3, "right")
    for top in range(0, len(n), TILE):
        low = slice(top, min(top + TILE, len(n)))
        right = slice(top, int(reach[low].max()))
        both = n[low, None] + n[None, right]
        near = (root[low, None] != root[None, right]) & (3 * n[None, right] <= 4 * n[low, None])
        near &= 7 * np.maximum(rest[low, None], rest[None, right]) <= both
        i, j = np.nonzero(near)
        i, j = i + top, j + top
        i, j = i[i < j], j[i < j]
        for w in by_words:
            same = np.minimum(words[i], words[j]) == w
            a, b = i[same], j[same]
            for part in range(0, len(a), 100_000):
                x, y = a[part:part + 100_000], b[part:part + 100_000]
                stays = 7 * np.bitwise_count(by_words[w][x] ^ by_words[w][y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
                if stays.any():
                    yield _rows(PAIR, node[x[stays]], node[y[stays]])


def _meet(group: int, counted: bool):
    """Sorted rows of whole buckets -> candidate pairs, members of large groups, documents; if ``counted``, no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            for bucket, kind, x, y, z, drawn in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == DOC:
                    yield _documents(x, y, z, drawn)
                elif kind == OVER:
                    key, node, first = np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64), np.frombuffer(z, np.int64)
                    yield _rows(HOT, key, node)
                    if not counted:
                        pair = np.unique(np.column_stack([first, node]), axis=0)
                        yield _rows(PAIR, pair[:, 0].copy(), pair[:, 1].copy())
                else:
                    if bucket != now:
                        yield from _meet_bucket(rows, group, counted)
                        now, rows = bucket, {}
                    rows.setdefault(kind, []).append((x, y, z))
        yield from _meet_bucket(rows, group, counted)

    return run


def _met(dealt: DataFrame, buckets: int, group: int, counted: bool = False) -> DataFrame:
    return stored(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(group, counted), FOUND), "met", "kind")


def _same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) where the text has that set."""
    for batch in batches:
        same = []
        for chunk in tx.chunks(batch.column(1), lower=True):
            own = batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo).to_pylist()
            same += [len(s) > 0 and set_name(s) == v for s, v in zip(shingle_sets(chunk), own)]
        yield batch.filter(pa.array(same, pa.bool_()))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches may belong to sets that link."""
    for batch in batches:
        stays = []
        for na, nb, sa, sb in zip(*(batch.column(k).to_pylist() for k in ("na", "nb", "sa", "sb"))):
            stays.append(4 * min(na, nb) >= 3 * max(na, nb) and 7 * sketch_distance(
                np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)) <= na + nb)
        yield batch.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ta, tb) of which 100 * intersection >= 75 * union."""
    for batch in batches:
        left = [s for c in tx.chunks(batch.column("ta"), lower=True) for s in shingle_sets(c)]
        right = [s for c in tx.chunks(batch.column("tb"), lower=True) for s in shingle_sets(c)]
        stays = []
        for s, t in zip(left, right):
            both = len(np.intersect1d(s, t, assume_unique=True))
            stays.append(100 * both >= 75 * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    with_a = pairs.join(texts.toDF("a", "ta"), "a")
    return with_a.join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(_linked, "a bigint, b bigint")


def _candidates(found: DataFrame, shape: DataFrame) -> DataFrame:
    """Distinct pairs that the sketches can't tell apart."""
    pairs = (found.where(f"kind = {PAIR}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
             .where("a <> b").distinct())
    with_a = pairs.join(shape.toDF("a", "na", "sa"), "a")
    return stored(with_a.join(shape.toDF("b", "nb", "sb"), "b").mapInArrow(_near, "a bigint, b bigint"), "near")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b")).toDF("node").distinct()


def _large(found: DataFrame) -> DataFrame:
    return found.where(f"kind = {HOT}").select(F.col("x").alias("block"), F.col("y").alias("node"))


def _common(hot: DataFrame, parts: DataFrame) -> DataFrame:
    """(block, node) of the large groups that span components."""
    named = hot.distinct().join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = named.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return named.join(apart, "block").select("block", "node")


def _link(spark: SparkSession, near: DataFrame, texts: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All links found so far, as few as join the same components, and the components."""
    one = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = _verified(one, texts)
    found = stored(found.unionByName(links) if links is not None else found, "links")
    parts = stored(components(spark, found), "parts")
    # What the first links leave apart is verified in full.
    root = parts.toDF("a", "ra")
    apart = (near.join(one.withColumn("tried", F.lit(True)), ["a", "b"], "left").where("tried IS NULL")
             .join(root, "a", "left").join(parts.toDF("b", "rb"), "b", "left")
             .where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"))
    more = stored(_verified(apart, texts), "links")
    if not more.isEmpty():
        found = found.unionByName(more)
        parts = stored(components(spark, found), "parts")
    return found, parts


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tx.chunks(batch.column(0), lower=True):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(chunk)], pa.int64())], names=["n_shingles"])


def classes(docs: DataFrame, group: int = GROUP, window: int = OFTEN) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    ``group`` and ``window`` decide how much work goes which way, never the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, int(size // 15 // BUCKET))  # about a block in 15 bytes of text
    often = _often(docs, window)
    found = _met(docs.mapInArrow(_emit_documents(buckets, group, often), packed.SCHEMA), buckets, group)
    members = found.where(f"kind = {MEMBER}").select(F.col("x").alias("doc_id"), F.col("y").alias("node"), F.col("z").alias("n"))
    shape = found.where(f"kind = {MEMBER} AND z > 0").select(F.col("y").alias("node"), F.col("z").alias("n"), F.col("s").alias("sketch"))
    shape = shape.dropDuplicates(["node"])
    hot = _large(found)
    chosen = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    near = _candidates(found, shape)
    wanted = (_nodes(near).withColumn("near", F.lit(True)).union(hot.select("node", F.lit(False)))
              .groupBy("node").agg(F.max("near").alias("near")))
    texts = (docs.join(chosen.join(wanted, "node"), "doc_id").select("node", "text", "near")
             .mapInArrow(_same_set, "node bigint, text string, near boolean"))
    if not members.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    # Those of candidate pairs apart from those that are only needed for common blocks.
    texts = stored(texts, "texts", "near")
    links, parts = _link(spark, near, texts.where("near").select("node", "text"), None)
    some = stored(_common(hot, parts).select("node").distinct(), "some")
    if not some.isEmpty():
        # All blocks of the sets that met a common one tell all that are common among them.
        again = texts.join(some, "node", "left_semi").select("node", "text")
        common = stored(_common(_large(_met(again.mapInArrow(_emit_all(buckets, group), packed.SCHEMA), buckets, group, True)), parts), "common")
        sets = common.groupBy("block").agg(F.count(F.lit(1)).alias("sets"))
        known = common.join(sets, "block").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("sets", "block"))).alias("common"))
        again = (again.join(known, "node", "left").join(parts, "node", "left")
                 .select("node", "text", F.coalesce("root", "node").alias("root"), "common"))
        found = _met(again.mapInArrow(_emit_again(buckets, group, often), packed.SCHEMA), buckets, group)
        near = _candidates(found, shape)
        own = stored(texts.select("node", "text").join(_nodes(near), "node", "left_semi"), "texts")
        links, parts = _link(spark, near, own, links)
    named = members.withColumn("own", F.when(F.col("n") > 0, F.col("node")))
    root = named.join(parts.toDF("own", "root"), "own", "left").withColumn("root", F.coalesce("root", "own"))
    least = root.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = root.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    unnamed = docs.where("doc_id IS NULL").select("text").mapInArrow(_sizes, "n_shingles bigint")
    none = F.lit(None).cast("bigint")
    return named.unionByName(unnamed.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def one_per_class(docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller id of their class stands for, with their own columns. Of equal
    rows one stays; rows without an id stay."""
    found = stored(classes(docs), "classes")
    gone = stored(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    left = docs.join(gone.withColumnRenamed("doc_id", "_gone"), F.col("doc_id").cast("bigint") == F.col("_gone"), "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.where("doc_id IS NOT NULL").dropDuplicates().unionByName(left.where("doc_id IS NULL"))

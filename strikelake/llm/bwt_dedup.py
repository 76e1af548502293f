"""Removal of repeated 50-byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Four passes, each dealing
packed arrays to buckets:

1. Every window of 50 bytes is named by the smallest hash of its 20-byte strings (``anchors``); equal windows have equal
   names, and neighbouring windows mostly share one. Names met in two documents or more go back to their documents.
2. Runs of windows with such a name become segments (a run of r windows is r + 49 bytes), dealt by name. Of equal
   segments only the one of the smallest document needs a look: the others lie in a larger one and go as a whole.
3. In a bucket, the different segments of a name are texts of a collection. They are dealt into shards; each shard is
   suffix-sorted once, to its Burrows-Wheeler transform. The transforms are merged by iterative interleave refinement:
   starting from the shards one after another, a pass through the merged transform sends every row to the place of the
   suffix that is one symbol longer, which sorts the interleave by one symbol more; suffixes are never compared again.
   Rows that a pass leaves in one block agree in that many symbols. A symbol is a string of 10 bytes (a text has 10
   phases), so five passes give the common prefixes of 50 bytes, and each remaining block is a repeated interval: its
   smallest document keeps the string, all others lose it.
4. Lost byte ranges meet their documents, which are hashed without them.

A name that very many documents share (a common line goes on differently in each) is dealt by a finer name, over
40-byte strings, so that no bucket gathers it; the ``MOST`` most frequent names are told to all tasks for that, and
don't change the result. Equal segments within a task are sent once. Segments, and so all arrays, are
bounded by a bucket; their number grows with the size of the texts. Names and symbols are 64-bit hashes.

Every task sends every bucket a row of each kind, so rows grow with the square of the buckets. So a task packs as much as
its memory holds into a row, buckets become larger before they become more (``FULL``), and rows are read together again.

Defined results: null and empty texts have no bytes; rows of equal id don't take from each other; rows without an id
neither take nor lose; repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelake.llm import packed
from strikelake.llm import text as tx
from strikelake.llm.components import stored

SPAN = 50  # bytes of a string that may stand once
GRAM, FINE = 20, 40  # bytes of the strings that name windows, and of those that split frequent names
LETTER = 10  # bytes of a symbol
RUN = 64  # windows of a segment at most
MANY = 256  # documents that share a name beyond which it is split
MOST = 100_000  # names of that kind that are sent to the tasks, 8 bytes each
SHARD = 50_000  # bytes of segments that are suffix-sorted at once; so small that a merge stays in the cache
TOGETHER = 400_000  # bytes of segments whose transforms are merged at once, whole names
FLUSH = 16_000_000  # bytes of texts or segments that are sent, or whose names are, together
STRETCH = 1 << 15  # windows that are named at once, so that their hashes stay in the processor's cache
PIECE = 1_000_000  # bytes of texts of a bucket that are read at once, whole texts
BUCKET, FULL = 8_000_000, 24_000_000  # bytes of texts per bucket, and those it grows to
ENOUGH = 128  # buckets from which on they grow rather than become more

ONCE, TWICE, TEXTS, NAMES, SEGMENT, LOST, FREQUENT = range(7)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n < width:
        step = min(n, width - n)
        h = np.minimum(h[:-step], h[step:])
        n += step
    return h


def anchors(data: np.ndarray, n: int, gram: int) -> np.ndarray:
    """The name of the window at each byte: the smallest hash of its strings of ``gram`` bytes. ``data`` is padded."""
    names = np.empty(max(0, n - SPAN + 1), np.uint64)
    at8 = np.ndarray((max(0, len(data) - 7),), "<u8", buffer=data, strides=(1,))
    width = SPAN - gram + 1
    for a in range(0, len(names), STRETCH):
        m = min(STRETCH, len(names) - a) + width - 1
        h = tx.mix(at8[a:a + m] + np.uint64(gram))
        for k in [*range(8, gram - 8, 8), gram - 8]:
            h = tx.mix(h ^ at8[a + k:a + k + m])
        names[a:a + STRETCH] = _sliding_min(h, width)
    return names


def runs(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of equal name within a text: name, text, first window and number of windows."""
    names = anchors(chunk.data, chunk.size, GRAM)
    n = len(names)
    if not n:
        none = np.zeros(0, np.int64)
        return names, none, none, none
    begins = np.empty(n, bool)
    begins[0], begins[1:] = True, names[1:] != names[:-1]
    bounds = chunk.offsets
    begins[bounds[bounds < n]] = True
    ends = np.maximum(bounds[1:] - SPAN + 1, bounds[:-1])  # windows from here on reach beyond their text
    begins[ends[ends < n]] = True
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, n))
    text = np.searchsorted(bounds, first, "right") - 1
    inside = first + SPAN <= bounds[text + 1]
    return names[first[inside]], text[inside], first[inside], count[inside]


def _cut_runs(name, text, first, count):
    """Runs of at most ``RUN`` windows."""
    parts = -(-count // RUN)
    of = np.repeat(np.arange(len(count)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return name[of], text[of], first[of] + k * RUN, np.minimum(count[of] - k * RUN, RUN)


def _keys(chunk: tx.Chunk, ids: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row by its id and text."""
    own = [xxhash.xxh3_64_intdigest(chunk.raw(i)) for i in range(len(ids))]
    return tx.mix(np.array(own, np.uint64) ^ tx.mix(ids.view(np.uint64)))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[tx.Chunk, np.ndarray, np.ndarray]]:
    """Chunks of (doc_id, text) with their ids and which of them are known."""
    for chunk in tx.chunks(batch.column(1)):
        own = batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo)
        yield chunk, own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False)


def _deal(values: np.ndarray, buckets: int) -> np.ndarray:
    return (tx.mix(values.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _emit_names(buckets: int):
    """(doc_id, text) -> each chunk's names once, with one row of the smallest id; names of several ids back to their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            name, ids, key = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((key, ids, name))
            name, ids, key = name[order], ids[order], key[order]
            new = np.append(True, (name[1:] != name[:-1]) | (key[1:] != key[:-1]))
            name, ids, key = name[new], ids[new], key[new]
            edge = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            group = np.diff(np.append(edge, len(name)))
            several = ids[edge] != ids[edge + group - 1]
            back = np.repeat(group > 1, group)
            back[edge] = False  # the first one comes back from its bucket
            yield from _by_row(name[edge], buckets, ONCE, key[edge], name[edge], ids[edge], key[edge], 2 * group + several)
            yield from _by_row(key[back], buckets, TWICE, key[back], name[back], key[back])

        for batch in batches:
            for chunk, ids, known in _read(batch):
                name, text, _, _ = runs(chunk)
                keep = known[text]
                name, text = name[keep], text[keep]
                if len(name):
                    held.append((name, ids[text], _keys(chunk, ids)[text]))
                    size += chunk.size
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Sorted packed rows, all of one bucket at a time."""
    now, found = None, {}
    for batch in batches:
        for bucket, kind, *values in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if found:
                    yield now, found
                now, found = bucket, {}
            found.setdefault(kind, []).append(values)
    if found:
        yield now, found


def _column(found: dict[int, list[tuple]], kind: int, k: int, of: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(packed.unpress(v[k]), of) for v in found.get(kind, [])] or [np.zeros(0, of)])


def _by_row(bucket_of: np.ndarray, buckets: int, kind: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows in the order of ``key``, whose repeats then compress."""
    order = np.argsort(key, kind="stable")
    yield from packed.rows(_deal(bucket_of[order], buckets), kind, *(c[order] for c in columns), press=True)


def _meet_names(buckets: int, many: int):
    """Names of a bucket -> those of several ids, to the rows that have them (name, key); frequent ones with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_bucket(batches):
            name, ids, key, weight = (_column(found, ONCE, k, t) for k, t in enumerate((np.uint64, np.int64, np.uint64, np.int64)))
            if len(name):
                order = np.lexsort((ids, name))
                name, ids, key, weight = name[order], ids[order], key[order], weight[order]
                edge = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
                group = np.diff(np.append(edge, len(name)))
                met = (ids[edge] != ids[edge + group - 1]) | np.bitwise_or.reduceat(weight & 1, edge).astype(bool)
                back = np.repeat(met, group)
                name_back, key_back = name[back], key[back]
                total = np.add.reduceat(weight >> 1, edge)
                often = met & (total > many)
                if often.any():
                    yield packed.row(0, FREQUENT, name[edge][often].tobytes(), total[often].tobytes())
            else:
                name_back, key_back = name, key
            # Rows of one chunk share a name; what is equal only between rows of one id, the later passes leave.
            name, key = (np.concatenate([own, _column(found, TWICE, k, np.uint64)]) for k, own in enumerate((name_back, key_back)))
            yield from _by_row(key, buckets, NAMES, key, name, key)

    return run


def _emit_texts(buckets: int):
    """(doc_id, text) -> compressed texts dealt by row: lengths with ids, known flags, keys and the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, known, key, length = (np.concatenate(c) for c in zip(*(h[:4] for h in held)))
            raw = [text for h in held for text in h[4]]
            to = _deal(key, buckets)
            order = np.argsort(to, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
            yield from packed.several([int(to[part[0]]) for part in parts], TEXTS, (
                (np.concatenate([ids[part], known[part], length[part]]).tobytes(), key[part].tobytes(),
                 packed.press(b"".join([raw[i] for i in part]))) for part in parts))

        for batch in batches:
            for chunk, ids, known in _read(batch):
                held.append((ids, known, _keys(chunk, ids), np.diff(chunk.offsets), [chunk.raw(i) for i in range(len(ids))]))
                size += chunk.size
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _texts(rows: list[tuple]) -> Iterator[tuple[tx.Chunk, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of texts, about ``PIECE`` bytes at a time, as a chunk, ids, known flags and keys."""
    held, size = [], 0
    for k, values in enumerate(rows):
        held.append((*np.frombuffer(values[0], np.int64).reshape(3, -1), np.frombuffer(values[1], np.uint64), packed.unpress(values[2])))
        size += len(held[-1][4])
        if size >= PIECE or k == len(rows) - 1:
            ids, known, length, key = (np.concatenate(c) for c in zip(*(h[:4] for h in held)))
            data = np.frombuffer(b"".join([*(h[4] for h in held), bytes(8)]), np.uint8)
            yield tx.Chunk(0, len(ids), data, np.concatenate([[0], np.cumsum(length)])), ids, known > 0, key
            held, size = [], 0


def _ragged(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The given stretches of ``data`` one after another."""
    held = data.tobytes()
    return np.frombuffer(b"".join([held[a:b] for a, b in zip(start.tolist(), (start + length).tolist())]), np.uint8)


def _frequent(names: DataFrame) -> np.ndarray:
    """The ``MOST`` most frequent names, sorted."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, np.int64)) for v in (x, y)], names=["name", "n"])

    found = names.where(F.col("kind") == FREQUENT).select("x", "y").mapInArrow(unpack, "name bigint, n bigint")
    top = found.orderBy(F.desc("n"), "name").limit(MOST).select("name").toArrow().column(0)
    return np.sort(top.to_numpy().view(np.uint64))


def _emit_segments(buckets: int, very: np.ndarray):
    """Names and texts of a bucket -> segments dealt by name; where a task has one twice, the later rows lose theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_bucket(batches):
            name, key = _column(found, NAMES, 0, np.uint64), _column(found, NAMES, 1, np.uint64)
            wanted = np.sort(tx.mix(name ^ tx.mix(key)))
            if not len(wanted):
                continue
            held, size = [], 0
            for chunk, ids, known, keys in _texts(found.get(TEXTS, [])):
                n, text, first, count = runs(chunk)
                ask = tx.mix(n ^ tx.mix(keys[text]))
                at = np.minimum(np.searchsorted(wanted, ask), len(wanted) - 1)
                hit = (wanted[at] == ask) & known[text]
                n, text, first, count = _cut_runs(n[hit], text[hit], first[hit], count[hit])
                hot = np.isin(n, very)
                if hot.any():
                    n, text, first, count = (np.concatenate(p) for p in zip(
                        (n[~hot], text[~hot], first[~hot], count[~hot]), _finer(chunk, n[hot], text[hot], first[hot], count[hot])))
                length = count + SPAN - 1
                if len(n):
                    held.append((n, ids[text], keys[text], first - chunk.offsets[text], length, tx.hash_ranges(
                        chunk.data, first, first + length), _ragged(chunk.data, first, length)))
                    size += int(length.sum())
                if size >= FLUSH:
                    yield from _send_segments(held, buckets)
                    held, size = [], 0
            if held:
                yield from _send_segments(held, buckets)

    return run


def _send_segments(held: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Segments dealt by name; of equal ones those of the smallest document, while the others lose theirs at once."""
    n, ids, keys, place, length, content = (np.concatenate(c) for c in zip(*(h[:6] for h in held)))
    body = b"".join([h[6] for h in held])
    start = np.cumsum(length) - length
    order = np.lexsort((ids, content, n))
    new = np.append(True, (n[order][1:] != n[order][:-1]) | (content[order][1:] != content[order][:-1]))
    least = ids[order][new][np.cumsum(new) - 1]
    is_later = np.zeros(len(n), bool)
    is_later[order] = ids[order] > least
    yield from _by_row(keys[is_later], buckets, LOST, keys[is_later], keys[is_later], place[is_later], (place + length)[is_later])
    own = np.flatnonzero(~is_later)
    to = _deal(n[own], buckets)
    by = np.argsort(to, kind="stable")  # documents stay in their order
    own, to = own[by], to[by]
    edge = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(edge[1:], len(own))
    n, ids, keys, place, length, start = (c[own] for c in (n, ids, keys, place, length, start))
    stop = start + length
    yield from packed.several(to[edge], SEGMENT, ([packed.press(b) for b in (
        n[i:j].tobytes(), ids[i:j].tobytes() + keys[i:j].tobytes(), place[i:j].tobytes() + length[i:j].tobytes(),
        b"".join([body[a:b] for a, b in zip(start[i:j].tolist(), stop[i:j].tolist())]))] for i, j in zip(edge, ends)))


def _finer(chunk: tx.Chunk, name, text, first, count):
    """The same windows in runs of equal name and equal finer name."""
    windows = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    of = np.repeat(np.arange(len(name)), count)
    fine = tx.mix(anchors(chunk.data, chunk.size, FINE)[windows] ^ name[of])
    new = np.append(True, (fine[1:] != fine[:-1]) | (of[1:] != of[:-1]))
    edge = np.flatnonzero(new)
    return fine[edge], text[of[edge]], windows[edge], np.diff(np.append(edge, len(windows)))


# --- merging of transforms -------------------------------------------------------------------------

def _stable_order(values: np.ndarray) -> np.ndarray:
    """Stable sorting permutation of numbers below 2 ** 32, by 16 bits at a time."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    if len(values) and int(values.max()) > 0xFFFF:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def shard_transform(symbol: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and transform of a shard. ``symbol`` has the symbol that begins at each place, and ``left`` the bytes
    from there to the end of its text; a suffix goes on at the place ``LETTER`` further, until less than a symbol is
    left, where it has symbol 0. Suffixes that are equal to their ends are in the order of their places."""
    n = len(symbol)
    order = np.arange(n)
    for depth in range(int(left.max(initial=0)) // LETTER, -1, -1):
        goes_on = left[order] >= (depth + 1) * LETTER
        rest = order[goes_on]
        order = np.concatenate([order[~goes_on], rest[_stable_order(symbol[rest + depth * LETTER])]])
    return order, np.where(_phase_starts(left)[order], 0, symbol[np.maximum(order - LETTER, 0)])


def _phase_starts(left: np.ndarray) -> np.ndarray:
    """The first ``LETTER`` places of every text, which nothing precedes in their phase."""
    begins = np.append(True, left[1:] > left[:-1])
    start = np.maximum.accumulate(np.where(begins, np.arange(len(left)), 0))
    return np.arange(len(left)) - start < LETTER


def _letters(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``LETTER`` bytes from each byte on."""
    at8 = np.ndarray((len(body) + 8,), "<u8", buffer=np.concatenate([body, np.zeros(15, np.uint8)]), strides=(1,))
    letters = np.empty(len(body), np.uint64)
    for a in range(0, len(body), STRETCH):
        m = min(STRETCH, len(body) - a)
        h = tx.mix(at8[a:a + m] + np.uint64(LETTER))
        letters[a:a + m] = tx.mix(h ^ (at8[a + LETTER - 8:a + LETTER - 8 + m] + tx._GOLD))
    return letters


def merge(transforms: list[np.ndarray], ended: list[int], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rows sorted by their first ``passes`` symbols (the shard of each row), and blocks of rows
    that agree in them. ``ended`` has each shard's number of suffixes without a symbol, which come first."""
    few, short = np.uint16 if len(transforms) < 1 << 16 else np.uint32, np.int32 if sum(map(len, transforms)) < 1 << 31 else np.int64
    shard = np.repeat(np.arange(len(transforms), dtype=few), [len(t) for t in transforms])
    block = np.zeros(len(shard), short)
    symbol = np.empty(len(shard), np.uint32)
    without = np.repeat(np.arange(len(transforms), dtype=few), ended)
    rows = np.concatenate(transforms).astype(np.uint32)
    for _ in range(passes):
        symbol[_stable_order(shard)] = rows  # a shard's rows keep their order in every interleave
        order = _stable_order(symbol)
        sorted_ = symbol[order]
        shard, block = shard[order], block[order]
        shard[:len(without)] = without
        block[:len(without)] = np.arange(-len(without), 0)
        block = np.cumsum(np.append(True, (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])), dtype=short)
    return shard, block


def repeated_windows(body: np.ndarray, length: np.ndarray, document: np.ndarray, size: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Of a collection of texts in ``body``: (text, window) of the windows that also stand in a text of a smaller document."""
    n = length + 1  # a place for the end
    ends = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(length)), n)
    place = np.arange(int(ends[-1])) - ends[text]
    start = np.cumsum(length) - length
    left = length[text] - place
    has = left >= LETTER
    source = (start[text] + place)[has]
    letters = np.zeros(len(text), np.uint64)
    letters[has] = _letters(body)[source]
    symbol = np.where(has, (letters >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
    # Shards of whole texts.
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ends[1:] // size)) + 1, [len(length)]])
    orders, transforms, ended = [], [], []
    for a, b in zip(ends[cuts[:-1]], ends[cuts[1:]]):
        if a < b:
            order, transform = shard_transform(symbol[a:b], left[a:b])
            orders.append(order + a)
            transforms.append(transform)
            ended.append(int((symbol[a:b] == 0).sum()))
    shard, block = merge(transforms, ended, SPAN // LETTER)
    spot = np.empty(len(shard), np.int64)
    spot[_stable_order(shard)] = np.concatenate(orders)
    whole = (left >= SPAN)[spot]
    spot, block = spot[whole], block[whole]
    if not len(spot):
        return spot, spot
    # Symbols are 32 bits of a letter's hash in the transforms; within a block the whole hashes decide.
    exact = np.zeros(len(text) - SPAN, np.uint64)
    for a in range(0, len(exact), STRETCH):
        for k in range(SPAN // LETTER):
            exact[a:a + STRETCH] = tx.mix(exact[a:a + STRETCH] ^ letters[a + k * LETTER:][:len(exact[a:a + STRETCH])]) + tx._GOLD
    exact = exact[spot]
    if ((block[1:] == block[:-1]) & (exact[1:] != exact[:-1])).any():
        order = np.lexsort((exact, block))
        spot, block, exact = spot[order], block[order], exact[order]
    edge = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (exact[1:] != exact[:-1])))
    owner = document[text[spot]]
    least = np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.append(edge, len(spot))))
    gone = np.sort(spot[owner > least])
    return text[gone], place[gone]


def _meet_segments(buckets: int, shard: int):
    """Segments of a bucket -> byte ranges that rows lose."""

    def among(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts = [[packed.unpress(b) for b in v] for v in rows]
        if not parts:
            return
        name = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
        ids, key = np.concatenate([np.frombuffer(p[1], np.int64).reshape(2, -1) for p in parts], axis=1)
        place, length = np.concatenate([np.frombuffer(p[2], np.int64).reshape(2, -1) for p in parts], axis=1)
        key = key.view(np.uint64)
        body = np.concatenate([np.frombuffer(p[3], np.uint8) for p in parts] + [np.zeros(8, np.uint8)])
        del parts
        start = np.cumsum(length) - length
        content = tx.hash_ranges(body, start, start + length)
        order = np.lexsort((ids, content, name))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (content[order][1:] != content[order][:-1]))
        group = np.cumsum(new) - 1  # of equal segments, in this order
        first = order[new]
        least = ids[first][group]
        later = order[ids[order] > least]
        yield key[later], place[later], place[later] + length[later]
        owners = ids[order] == least
        owners, owner_group = order[owners], group[owners]
        # Different segments of one name, unless all are of one document, some names at a time.
        edge = np.flatnonzero(np.append(True, name[first][1:] != name[first][:-1]))
        size = np.diff(np.append(edge, len(first)))
        mixed = np.minimum.reduceat(ids[first], edge) != np.maximum.reduceat(ids[first], edge)
        edge, size = edge[mixed], size[mixed]
        total = np.concatenate([[0], np.cumsum(length[first])])
        turn = np.cumsum(total[edge + size] - total[edge]) // TOGETHER
        for names in np.split(np.arange(len(edge)), np.flatnonzero(np.diff(turn)) + 1):
            if not len(names):
                continue
            chosen = np.repeat(edge[names] - np.cumsum(size[names]) + size[names], size[names]) + np.arange(int(size[names].sum()))
            of = first[chosen]
            text, window = repeated_windows(_ragged(body, start[of], length[of]), length[of], ids[of], shard)
            if not len(text):
                continue
            # Neighbouring windows as ranges, for every row of the smallest document that has the segment.
            fresh = np.append(True, (text[1:] != text[:-1]) | (window[1:] != window[:-1] + 1))
            begin = np.flatnonzero(fresh)
            finish = np.append(begin[1:], len(text)) - 1
            seat, low, high = text[begin], window[begin], window[finish] + SPAN
            lo = np.searchsorted(owner_group, chosen[seat])
            n = np.searchsorted(owner_group, chosen[seat], "right") - lo
            which = np.repeat(np.arange(len(seat)), n)
            row = owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            yield key[row], place[row] + low[which], place[row] + high[which]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_bucket(batches):
            lost = [[_column(found, LOST, k, t) for k, t in enumerate((np.uint64, np.int64, np.int64))]]
            lost.extend(among(found.pop(SEGMENT, [])))
            key, low, high = (np.concatenate(c) for c in zip(*lost))
            yield from _by_row(key, buckets, LOST, key, key, low, high)

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _remove(kept: bool):
    """Lost ranges and texts of a bucket -> per row its counts and the hash of what is left, or the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_bucket(batches):
            key, low, high = (_column(found, LOST, k, t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
            order = np.argsort(key, kind="stable")
            key, low, high = key[order], low[order], high[order]
            for chunk, ids, known, keys in _texts(found.get(TEXTS, [])):
                a, b = np.searchsorted(key, keys), np.searchsorted(key, keys, "right")
                n = b - a
                row = np.repeat(np.arange(len(keys)), n)
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                change = np.zeros(chunk.size + 1, np.int32)
                np.add.at(change, chunk.offsets[row] + low[at], 1)
                np.add.at(change, chunk.offsets[row] + high[at], -1)
                gone = np.cumsum(change)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                bounds = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
                begins[bounds] = gone[bounds]
                total, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
                o = chunk.offsets
                left = chunk.data[:chunk.size][~gone].tobytes()
                edge = o - total[o]
                rest = [left[edge[i]:edge[i + 1]] for i in range(len(ids))]
                doc = pa.array(ids, mask=~known)
                if kept:
                    yield pa.RecordBatch.from_arrays([doc, pa.array([r.decode("utf-8", "replace") for r in rest], pa.string())], names=["doc_id", "text"])
                else:
                    yield pa.RecordBatch.from_arrays([
                        doc, pa.array(np.diff(o)), pa.array(total[o[1:]] - total[o[:-1]]), pa.array(spans[o[1:]] - spans[o[:-1]]),
                        pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string())], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")


def _lost(docs: DataFrame, buckets: int, many: int, shard: int) -> DataFrame:
    names = stored(_dealt(docs.mapInArrow(_emit_names(buckets), packed.SCHEMA), buckets)
                   .mapInArrow(_meet_names(buckets, many), packed.SCHEMA), "names")
    texts = docs.mapInArrow(_emit_texts(buckets), packed.SCHEMA)
    met = names.where(F.col("kind") == NAMES)
    segments = _dealt(met.unionByName(texts), buckets).mapInArrow(_emit_segments(buckets, _frequent(names)), packed.SCHEMA)
    return stored(_dealt(segments, buckets).mapInArrow(_meet_segments(buckets, shard), packed.SCHEMA), "lost")


def _buckets(size: int) -> int:
    return max(16, min(size // BUCKET, max(ENOUGH, size // FULL)))


def _removed(docs: DataFrame, kept: bool, schema: str, many: int, shard: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _buckets(int(size))
    lost = _lost(docs, buckets, many, shard)
    texts = docs.mapInArrow(_emit_texts(buckets), packed.SCHEMA)
    return _dealt(lost.unionByName(texts), buckets).mapInArrow(_remove(kept), schema)


def report(docs: DataFrame, many: int = MANY, shard: int = SHARD) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs and the SHA-256 of what is left. ``many`` and
    ``shard`` shape the work, not the result."""
    return _removed(docs, False, RESULT, many, shard)


def without_repeats(docs: DataFrame, many: int = MANY, shard: int = SHARD) -> DataFrame:
    """``doc_id, text`` without the repeated strings; a character that is cut becomes U+FFFD."""
    return _removed(docs, True, "doc_id bigint, text string", many, shard)

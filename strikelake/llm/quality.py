"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost.

A rule rejects a text by a condition on one or two measures (counts of words, symbols, repeated lines or word
windows). The cascade times every measure and counts every rule's rejections on a bounded sample, orders the
rules by rejections per second, and then computes, text by text, only the measures that the next rule
needs: a text that one rule rejects costs nothing more. The verdict is the conjunction of all rules, so it
doesn't depend on the order, which only decides the cost. All rules read whole texts.

Defined results: a null or empty text has no words and fails ``few_words``; every row, copies included, gets
its own verdict; an empty table gives an empty result; other columns go through as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.llm import text as tx

SAMPLE_ROWS = 400  # rows that order the rules; the verdicts don't depend on them
WINDOW = 5
# The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CAPITALS = tx.byte_set((0x41, 0x5A))
BLANKS = b" \t\n\x0b\x0c\r"


class Texts:
    """The measures of one chunk, each computed at its first use and only for the texts asked for."""

    def __init__(self, chunk: tx.Chunk, spent: dict[str, float] | None = None):
        self.chunk, self.spent = chunk, spent
        self.n = len(chunk.offsets) - 1
        self._words: tx.Words | None = None
        self._known: dict[str, np.ndarray] = {}
        self._done: dict[str, np.ndarray] = {}

    @property
    def words(self) -> tx.Words:
        if self._words is None:
            self._words = tx.words(self.chunk, tx.BLANK_WORDS)
        return self._words

    def get(self, name: str, wanted: np.ndarray) -> np.ndarray:
        """Values of a measure; only those of the texts flagged in ``wanted`` are sure to be computed."""
        if name not in self._known:
            self._known[name] = np.zeros(self.n, np.int64)
            self._done[name] = np.zeros(self.n, bool)
        todo = wanted & ~self._done[name]
        if todo.any():
            start = time.perf_counter()
            self._known[name][todo] = MEASURES[name](self, todo)[todo]
            self._done[name] |= todo
            if self.spent is not None:
                self.spent[name] = self.spent.get(name, 0.0) + time.perf_counter() - start
        return self._known[name]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.chunk.offsets[1:]] - total[self.chunk.offsets[:-1]]


def _n_words(t: Texts, todo: np.ndarray) -> np.ndarray:
    return t.words.counts


def _word_chars(t: Texts, todo: np.ndarray) -> np.ndarray:
    data = t.chunk.data[:t.chunk.size]
    return t.per_text(tx.BLANK_WORDS[data] & ((data & 0xC0) != 0x80))


def _n_symbols(t: Texts, todo: np.ndarray) -> np.ndarray:
    return t.per_text(SYMBOLS[t.chunk.data[:t.chunk.size]])


def _n_caps(t: Texts, todo: np.ndarray) -> np.ndarray:
    return t.per_text(CAPITALS[t.chunk.data[:t.chunk.size]])


def _n_dup_lines(t: Texts, todo: np.ndarray) -> np.ndarray:
    out = np.zeros(t.n, np.int64)
    for i in np.flatnonzero(todo):
        lines = [line for line in t.chunk.raw(i).split(b"\n") if line.strip(BLANKS)]
        out[i] = len(lines) - len(set(lines))
    return out


def _n_repeat_words(t: Texts, todo: np.ndarray) -> np.ndarray:
    w = t.words
    of = w.texts()
    pick = todo[of]  # words of the other texts aren't even hashed
    hashes = np.zeros(len(of), np.uint64)
    hashes[pick] = tx.hash_ranges(t.chunk.data, w.starts[pick], w.ends[pick])
    whole, at = tx.windows(hashes, w.first, WINDOW)
    inside = todo[of[at]]
    whole, at = whole[inside], at[inside]
    twice = at[tx.repeated(tx.mix(whole ^ (of[at].astype(np.uint64) + np.uint64(1)) * tx._GOLD))]
    change = np.zeros(len(of) + WINDOW + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    covered = np.cumsum(change)[:len(of)] > 0
    return np.bincount(of[covered], minlength=t.n)


MEASURES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {
    "n_words": _n_words, "word_chars": _word_chars, "n_symbols": _n_symbols,
    "n_caps": _n_caps, "n_dup_lines": _n_dup_lines, "n_repeat_words": _n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``left * measure > right * of + over``; without ``of``, the last term stands alone."""

    name: str
    measure: str
    left: int
    right: int = 0
    of: str | None = None
    over: int = 0

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.measure, self.of) if self.of else (self.measure,)

    def rejects(self, t: Texts, wanted: np.ndarray) -> np.ndarray:
        bound = self.right * t.get(self.of, wanted) if self.of else 0
        return wanted & (self.left * t.get(self.measure, wanted) > bound + self.over)


# The production rules. Whole numbers throughout, so that every engine decides alike.
BASE_RULES = (
    Rule("few_words", "n_words", -1, over=-10),
    Rule("repeats", "n_repeat_words", 100, 20, "n_words"),
)
RULES = BASE_RULES + (
    Rule("long_words", "word_chars", 1, 16, "n_words"),
    Rule("short_words", "word_chars", -1, -2, "n_words"),
    Rule("symbols", "n_symbols", 10, 1, "n_words"),
    Rule("capitals", "n_caps", 10, 4, "word_chars"),
    Rule("dup_lines", "n_dup_lines", 10, 3, "n_words"),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on the first ``sample_rows`` rows, the best first.

    Costs are conditional: a measure that an earlier rule has computed is free for the later ones. Rules
    that reject nothing in the sample come last, the cheaper the earlier.
    """
    rows = docs.select(text).limit(sample_rows).toArrow().column(0)
    spent: dict[str, float] = {}
    hits = {r.name: np.zeros(0, bool) for r in rules}
    for chunk in tx.chunks(rows):
        t = Texts(chunk, spent)
        every = np.ones(t.n, bool)
        t.get("n_words", every)
        for r in rules:
            hits[r.name] = np.concatenate([hits[r.name], r.rejects(t, every)])
    left, ordered, paid = list(rules), [], {"n_words"}
    alive = np.ones(len(rows), bool)
    while left:
        def gain(r: Rule) -> tuple[float, float]:
            cost = 1e-9 + sum(spent.get(m, 0.0) for m in set(r.needs) - paid)
            return (hits[r.name][alive].sum() / cost if alive.any() else 0.0, -cost)
        best = max(left, key=gain)
        left.remove(best)
        ordered.append(best)
        paid |= set(best.needs)
        alive &= ~hits[best.name] if len(rows) else alive
    return ordered


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", prefix: str = "",
            report: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``kept`` (boolean) and ``rejected_by`` (the first rule that rejects, in the order chosen).

    Measures named in ``report`` are added as columns, computed for every text; all others only as far as
    the cascade needs them. ``prefix`` goes before the added names, where they would clash.
    """
    ordered = order_rules(docs, rules, text, sample_rows)
    added = [T.StructField(prefix + m, T.LongType()) for m in report]
    added += [T.StructField(prefix + "kept", T.BooleanType()), T.StructField(prefix + "rejected_by", T.StringType())]
    clash = {f.name for f in added} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text))
            out: dict[str, list] = {m: [] for m in report}
            kept, by = [], []
            for chunk in tx.chunks(column):
                t = Texts(chunk)
                alive, why = np.ones(t.n, bool), np.full(t.n, None, object)
                for r in ordered:
                    if not alive.any():
                        break
                    bad = r.rejects(t, alive)
                    why[bad] = r.name
                    alive &= ~bad
                kept.append(alive)
                by.extend(why)
                every = np.ones(t.n, bool)
                for m in report:
                    out[m].append(t.get(m, every).copy())
            if not kept:
                continue
            arrays = [*batch.columns, *(pa.array(np.concatenate(v), pa.int64()) for v in out.values()),
                      pa.array(np.concatenate(kept)), pa.array(by, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: the measures, whether a base rule fails, and the verdict of the whole cascade."""
    marked = cascade(docs.select("doc_id", "text"), rules, report=tuple(MEASURES))
    few, repeats = F.col("n_words") < 10, 100 * F.col("n_repeat_words") > 20 * F.col("n_words")
    return marked.drop("text").withColumn("base_failed", few | repeats).withColumn(
        "kept", F.col("kept") & ~F.col("base_failed"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    own = [c for c in docs.columns if c != "text"]
    body = docs.select(F.struct(*own).alias("_own"), "text") if own else docs
    marked = cascade(body, rules, prefix="_")
    return marked.where("_kept").select([F.col("text") if c == "text" else F.col("_own")[c].alias(c) for c in docs.columns])

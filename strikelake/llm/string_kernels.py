"""Language identification by string kernels.

Two texts are compared by the distinct runs of one to ``LONGEST`` characters they share (the blended spectrum by
presence): the number of common runs over the geometric mean of both numbers of runs. Texts are lower-cased, and all between
two words counts as one space. A run of up to three characters is packed whole into a 64-bit number, so that kernel values
are exact.

Training is a kernel ridge regression, one against the rest, over Nyström landmarks: with ``K`` the kernel between training
texts and landmarks and ``M`` that between landmarks, the weights solve ``(K'K + ridge M) W = K'Y``. Tasks sum ``K'K`` and
``K'Y``; the driver adds these small matrices and solves. A text's scores are ``k W`` with ``k`` its kernel to the landmarks,
both matrix products over batches of texts.

Bounds, all parameters: the ``LANGUAGES`` most frequent languages are learned, from ``TRAIN_ROWS`` training texts, of which
``LANDMARKS`` are landmarks; these are drawn by a hash, equally many of each language as far as there are, and shorter
texts (``SHORT`` characters) before longer ones. Every document is scored on its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a document without a null language whose id
is held out, or null, teaches nothing; without any training text all are ``und``; of equal scores the first language by name
wins; very long texts are read in pieces; repeated rows come out alike; extra columns are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelake.llm.components import stored

LONGEST = 3
TRAIN_ROWS, LANGUAGES, LANDMARKS, SHORT = 3000, 400, 192, 20_000
RIDGE = 0.1
FOLDS = 5
UNKNOWN = "und"
PIECE = 1_000_000  # characters of a long text that are packed at once
BATCH = 64  # texts of one matrix product

_BITS = 21  # of a code point
_POINTS = 0x110000
_SPACE = 0x20

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


@cache
def _tables() -> np.ndarray:
    """Per code point its lower-case letter, or a space for all that is no letter."""
    table = np.full(_POINTS, _SPACE, np.uint32)
    for c in range(_POINTS):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str) -> np.ndarray:
    """The text as code points: letters in lower case, one space for all between words, and one at both ends."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    folded = np.concatenate(([_SPACE], _tables()[points], [_SPACE])).astype(np.uint64)
    blank = folded == _SPACE
    return folded[~(blank & np.concatenate(([False], blank[:-1])))]


def runs(text: str) -> np.ndarray:
    """The distinct runs of the text, sorted; empty without a letter."""
    points = letters(text)
    if len(points) < 2:
        return np.zeros(0, np.uint64)
    found = np.zeros(0, np.uint64)
    for at in range(0, len(points), PIECE):
        piece = points[at:at + PIECE + LONGEST - 1]
        parts, packed = [found], np.zeros(len(piece) + 1, np.uint64)
        for width in range(1, LONGEST + 1):
            if len(piece) < width:
                break
            packed = (packed[:-1] << np.uint64(_BITS)) | piece[width - 1:]
            parts.append(np.unique(packed))
        found = np.unique(np.concatenate(parts))
    return found


@dataclass
class Kernel:
    """Landmarks: which run (row) each of them (column) has, and the number of runs of each."""

    vocabulary: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, landmarks: list[np.ndarray]) -> Kernel:
        vocabulary = np.unique(np.concatenate(landmarks)) if landmarks else np.zeros(0, np.uint64)
        presence = np.zeros((len(vocabulary), len(landmarks)), np.float32)
        for j, own in enumerate(landmarks):
            presence[np.searchsorted(vocabulary, own), j] = 1
        return cls(vocabulary, presence, np.array([len(r) for r in landmarks], np.float64))

    def against(self, texts: list[np.ndarray]) -> np.ndarray:
        """The kernel of each text (its runs) with each landmark."""
        block = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for i, own in enumerate(texts):
            at = np.searchsorted(self.vocabulary, own)
            at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == own] if len(self.vocabulary) else at[:0]
            block[i, at] = 1
        sizes = np.array([len(r) for r in texts], np.float64)
        norm = np.sqrt(np.outer(sizes, self.sizes))
        return np.divide(block @ self.presence, norm, out=np.zeros(norm.shape), where=norm > 0)


@dataclass
class Model:
    kernel: Kernel
    languages: list[str]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the winner's response within 0 and 1."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for lo in range(0, len(texts), BATCH):
            own = [runs(t) if t else np.zeros(0, np.uint64) for t in texts[lo:lo + BATCH]]
            said = self.kernel.against(own) @ self.weights
            for i, best in enumerate(said.argmax(axis=1).tolist()):
                if len(own[i]):
                    names[lo + i] = self.languages[best]
                    scores[lo + i] = float(min(1.0, max(0.0, said[i, best])))
        return names, scores


def held_out(folds: int = FOLDS) -> Column:
    """Whether the id's checksum leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS, languages: int = LANGUAGES, folds: int = FOLDS) -> DataFrame:
    """At most ``rows`` labelled texts: ``lang``, ``text`` and ``nth``, their place among those of their language.

    The driver sees the numbers of texts of the most frequent ``languages``. A hash of id and text then thins each out to
    little more than its share where it is read, so that only a few rows are shuffled and ranked.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(folds))
    known = known.select("lang", "text", (F.length("text") > SHORT).alias("_long"), F.xxhash64("doc_id", "text").alias("_draw"))
    counts = (known.groupBy("lang").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("_long")).alias("short"))
              .orderBy(F.desc("all"), "lang").limit(languages).collect())
    share = max(1, rows // max(1, len(counts)))
    # Twice the share is drawn, and a few more; long texts only where the short ones are too few.
    odds = [(r.lang, r.short < share, min(1.0, (2 * share + 64) / (r.short if r.short >= share else r.all))) for r in counts[:rows]]
    odds = docs.sparkSession.createDataFrame(odds, "lang string, _any boolean, _odds double")
    drawn = F.pmod("_draw", F.lit(1 << 32)) < F.col("_odds") * float(1 << 32)
    near = known.join(F.broadcast(odds), "lang").where(drawn & (F.col("_any") | ~F.col("_long")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_long", "_draw", "text"))
    return near.withColumn("nth", nth).where(F.col("nth") <= share).select("lang", "text", "nth")


def _sets(rows: DataFrame) -> list[tuple[str, np.ndarray]]:
    """The runs of each row's text, made in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [runs(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["lang", "runs"])
    made = rows.mapInArrow(run, "lang string, runs binary").collect()
    return sorted((r.lang, bytes(r.runs)) for r in made)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE, folds: int = FOLDS) -> Model:
    """A model from the labelled texts outside the held-out fold."""
    sample = stored(training_rows(docs, rows, folds=folds), "language-sample")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model(Kernel.of([]), [], np.zeros((0, 0)))
    share = max(1, landmarks // len(languages))
    kernel = Kernel.of([np.frombuffer(r, np.uint64) for _, r in _sets(sample.where(F.col("nth") <= share).select("lang", "text"))])
    m, number = len(kernel.sizes), {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((m, m)), np.zeros((m, len(number)))
        for batch in batches:
            said, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), BATCH):
                k = kernel.against([runs(t) for t in texts[lo:lo + BATCH]])
                y = np.zeros((len(k), len(number)))
                y[np.arange(len(k)), [number[s] for s in said[lo:lo + BATCH]]] = 1
                gram += k.T @ k
                right += k.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    parts = sample.select("lang", "text").mapInArrow(run, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(p.gram).reshape(m, m) for p in parts)
    right = sum(np.frombuffer(p.right).reshape(m, len(languages)) for p in parts)
    between = (kernel.presence.T @ kernel.presence) / np.sqrt(np.outer(kernel.sizes, kernel.sizes))
    weights = np.linalg.lstsq(gram + ridge * between, right, rcond=None)[0]
    return Model(kernel, languages, weights)


def identify(docs: DataFrame, model: Model | None = None, folds: int = FOLDS) -> DataFrame:
    """Language and score of every document by its whole text; the model is trained on the table itself if none is given."""
    model = train(docs, folds=folds) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(folds).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)

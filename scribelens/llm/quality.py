"""Quality scores by naive Bayes support vectors.

Features are indicators of n-grams: word uni- and bigrams, and uni- to trigrams of word shapes,
where a shape is the word with its letters and digits reduced to their kind and runs folded
(``Hello!!`` is ``Aa!``), marked when the word repeats the one before. They are hashed to a
fixed number of columns. Each indicator is scaled by the class log-count ratio of its column, the
scaled vector is brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent.

The model is fitted on bounded samples of the labelled documents outside the held-out fold, those
of smallest hash: the log-count ratios on at most `COUNTED`, the hinge loss on at most `SAMPLE` of
them, one row per doc_id. Their labels, a few MB at most, are broadcast to the scan of the texts;
no text is ever exchanged.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scribelens.llm.tables import map_batches, read

BITS = 17
COUNTED = 200_000  # labelled documents whose n-grams are counted, at most
SAMPLE = 12_000  # labelled documents the hinge loss is fitted on, at most
ALPHA, COST, EPOCHS, TOLERANCE = 1.0, 1.0, 30, 0.01
REMEMBERED = 1 << 19  # words whose hashes a task keeps
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)  # odd numbers that mix bits


# Kinds of UTF-8 bytes: capital, digit, other letters (all bytes beyond ASCII among them).
_KINDS = bytes(
    ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b > 127 else b
    for b in range(256)
)
_RUN = re.compile(rb"(?s)(.)\1+")


def shape(word: bytes) -> bytes:
    return _RUN.sub(rb"\1", word.translate(_KINDS))


def _hash(raw: bytes) -> int:
    return zlib.crc32(raw) | zlib.crc32(raw, 0x5BD1E995) << 32


class _Words(dict):
    """Words numbered in order of appearance; row 0 and 1 of ``hashes`` are word and shape."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((2, REMEMBERED), np.uint64)
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        form = shape(raw)
        if form not in self.shapes:
            if len(self.shapes) >= REMEMBERED:
                self.shapes.clear()
            self.shapes[form] = _hash(b"shape " + form)
        self[word] = at = len(self)
        self.hashes[0, at], self.hashes[1, at] = _hash(raw), self.shapes[form]
        return at


class NGrams:
    """Turns texts into sorted distinct column numbers; remembers hashes of words."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.words = _Words()

    def _pair(self, words: list[str]) -> np.ndarray:
        """Word and shape hashes of each word."""
        parts = []
        for start in range(0, len(words), REMEMBERED // 2):
            part = words[start : start + REMEMBERED // 2]
            if len(self.words) + len(part) > REMEMBERED:
                self.words.clear()
            parts.append(self.words.hashes[:, list(map(self.words.__getitem__, part))])
        return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)

    def columns(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int32)
        w, s = self._pair(words)
        m = _MULTIPLIERS
        s[1:] += m[6] * (w[1:] == w[:-1])
        grams = [w * m[0], s * m[1]]
        if len(words) > 1:
            grams += [w[:-1] * m[2] + w[1:] * m[3], s[:-1] * m[4] + s[1:] * m[5]]
        if len(words) > 2:
            grams.append(s[:-2] * m[3] + s[1:-1] * m[0] + s[2:] * m[5])
        mixed = np.concatenate(grams)
        mixed ^= mixed >> np.uint64(29)
        self.seen[((mixed * m[0]) >> self.shift).astype(np.int64)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


def log_count_ratios(counts: np.ndarray, sizes: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Log ratio of the document frequencies of both classes; 0 for columns never seen.

    Row 0 of ``counts`` and ``sizes`` belongs to class 0: documents per column and in all.
    """
    sizes = np.maximum(1, sizes)
    smooth = alpha * sizes / sizes.mean()
    return np.log((counts[1] + smooth[1]) / sizes[1]) - np.log((counts[0] + smooth[0]) / sizes[0])


def class_counts(given: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Documents per class and column, and per class, of all rows of (doc_id, text, quality).

    A task adds its rows up first, so what is exchanged and what reaches the driver is bounded by
    the number of columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, found = NGrams(bits), np.zeros((2, (1 << bits) + 1), np.int64)
        for batch in batches:
            for text, quality in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found[int(quality == 1), grams.columns(text or "")] += 1
                found[int(quality == 1), -1] += 1
        good, column = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (good, column, found[good, column])], names=["good", "column", "n"])

    summed = given.mapInArrow(run, "good long, column long, n long").groupBy("good", "column").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, (1 << bits) + 1))
    counts[summed["good"].to_numpy(), summed["column"].to_numpy()] = summed["n"].to_numpy()
    return counts[:, :-1], counts[:, -1]


def fit(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, bits: int = BITS, cost: float = COST, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Log-count ratios (first row) and hinge-loss weights; the last column is the bias.

    Dual coordinate descent: a dual variable between 0 and ``cost`` per row is set to its
    optimum given the others, in random order, until no step would move one by much.
    """
    model = np.zeros((2, (1 << bits) + 1))
    if not len(rows) or good.all() or not good.any():
        model[1, -1] = 0.0 if not len(rows) else (1.0 if good.all() else -1.0)
        return model
    ratio, weight = model
    ratio[:-1] = ratios
    # Scaled vectors are made anew for every step: kept, they would take twice the room of the rows.
    norm = [max(1e-12, math.sqrt(v @ v)) for v in map(ratio.__getitem__, rows)]
    sign = np.where(good, 1.0, -1.0)
    size = np.array([v @ v + 1.0 for v in (ratio[r] / k for r, k in zip(rows, norm))])
    dual = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, y = rows[i], sign[i]
            v = ratio[row] / norm[i]
            slope = y * (weight[row] @ v + weight[-1]) - 1.0
            new = min(max(dual[i] - slope / size[i], 0.0), cost)
            step = new - dual[i]
            if step:
                moved = max(moved, abs(step))
                dual[i] = new
                weight[row] += (step * y) * v
                weight[-1] += step * y
        if moved < TOLERANCE:
            break
    return model


def score(model: np.ndarray, row: np.ndarray) -> float:
    """Logistic function of the margin: at least 0.5 on the side of label 1."""
    v = model[0, row]
    norm = math.sqrt(v @ v)
    margin = (model[1, row] @ v) / norm if norm else 0.0
    return 1.0 / (1.0 + math.exp(-2.0 * (margin + model[1, -1])))


def in_fold(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Whether crc32 of the id's decimal text leaves ``fold`` by ``folds``; false for null."""
    left = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(left == fold, F.lit(False))


def _texts(docs: DataFrame, text: str, doc_id: str, *more: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    bits: int = BITS,
    text: str = "text",
    doc_id: str = "doc_id",
    counted: int = COUNTED,
) -> np.ndarray:
    """Count at most ``counted`` labelled documents (``labels``: doc_id, quality) of smallest hash,
    fit on at most ``sample`` of them.

    Rows in the held-out fold and null labels are left out. A document labelled twice is good if
    one of its labels says so. Of a doc_id in several rows all are counted, and the one with the
    smallest columns is fitted. Without rows of both classes the model is a constant.
    """
    known = (
        labels.where(~in_fold(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
    )
    texts = _texts(docs, text, doc_id).where(~in_fold(F.col("doc_id")))
    # Both samples are bounded by their parameter, so they may be broadcast.
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = lambda n: texts.join(F.broadcast(first.limit(n)), "doc_id").select("doc_id", "text", "quality")
    ratios = log_count_ratios(*class_counts(chosen(counted), bits))
    given = chosen(sample)

    def make():
        grams = NGrams(bits)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [grams.columns(t or "").tobytes() for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "columns"])

        return step

    hashed = map_batches(given, make, "doc_id long, quality int, columns binary")
    # Repeats are folded in every partition before they are exchanged.
    found = hashed.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("columns").alias("columns")).toArrow()
    order = pc.sort_indices(found["doc_id"]).to_numpy()
    rows = _rows_of(found["columns"])
    good = found["quality"].to_numpy() == 1
    return fit([rows[i] for i in order], good[order], ratios, bits)


def _rows_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The packed rows as views on the column's memory."""
    return [np.frombuffer(value.as_buffer(), np.int32) for chunk in column.chunks for value in chunk]


def scores(docs: DataFrame, model: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text counts. Null and empty texts have the score of a text without n-grams. Null
    ids are not held out.
    """
    make = _scorer(model)

    def make_step():
        of = make()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), of(batch.column(1))], names=["doc_id", "score"])

        return step

    return map_batches(_texts(docs, text, doc_id), make_step, "doc_id long, score double").select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _scorer(model: np.ndarray):
    bits = (model.shape[1] - 1).bit_length() - 1
    packed = model.astype(np.float64).tobytes()

    def make():
        grams, weights = NGrams(bits), np.frombuffer(packed).reshape(2, -1)
        return lambda texts: pa.array([score(weights, grams.columns(t or "")) for t in texts.to_pylist()], pa.float64())

    return make


def keep_good(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least 0.5, all columns unchanged."""
    make = _scorer(model)

    @F.arrow_udf(DoubleType())
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for batch in batches:
            yield of(batch)

    return docs.where(score_of(F.col(text)) >= 0.5)


def op3_quality(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return scores(docs, train(docs, read(spark, folder, "labels")))

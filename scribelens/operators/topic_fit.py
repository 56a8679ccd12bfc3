"""Topic models, by expectation maximisation without a graph of documents and terms, and from batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelens.operators.topic_inference import GAMMA_SHAPE, digamma_of_fit, draws, variational, weights_of
from scribelens.session import remove, scratch, shared_path

STATE = "terms binary, counts binary, weights binary, sums boolean"
STATE_BYTES = 6  # a weight of a document
SUMS = "terms binary, weights binary"
BLOCK = 1024  # documents multiplied at once
HELD = 4  # blocks whose documents are sorted at the start
HELD_ENTRIES = 1 << 20  # of theirs, at most about
FREQUENT = 1 / 16  # of a block's documents: their terms are multiplied as a full matrix
DRAWN = 64  # entries drawn at once
STEP = 256  # rows of weights gathered at once
ROWS = 256  # terms in a row of sums
FAN_IN = 16  # tables of sums that a task adds up


class BlockLDA(LDA):
    """The fit of `pyspark.ml` with the optimizer "em" and its default priors, from the same start.

    That one sends a vector of all topics along every edge between a document and a term, and back.
    Here the terms' weights go to the tasks, a table of at most vocabulary times topics. A task
    multiplies blocks of documents with it and returns new weights of its documents and sums by
    term. Nothing is exchanged: documents stay in their rows, and sums are added up over a tree of
    tables. An iteration removes the tables of the one before. There are only so many tasks that
    their sums, a weight for each term and topic, are about twice as large as the documents' rows.
    """

    def _fit(self, dataset: DataFrame) -> LocalLDAModel:
        spark, k, seed = dataset.sparkSession, self.getK(), self.getSeed()
        # The generator of a partition is asked in the order of its rows, whichever task reads them.
        vectors = dataset.select(F.col(self.getFeaturesCol()).alias("features"), F.spark_partition_id().alias("part"))
        size = vectors.first()["features"].size
        alpha, eta = 50.0 / k + 1.0, 1.1
        tasks = max(1, 2 * STATE_BYTES * dataset.count() // (8 * size))
        with scratch(spark), _batches(spark, BLOCK):
            state = _written(vectors.coalesce(tasks).mapInArrow(_start(size, k, seed, alpha - 1.0), STATE))
            counts = _added(spark, state, size, k)
            for left in range(self.getMaxIter(), 0, -1):
                beta = (counts + (eta - 1.0)) / (counts.sum(axis=0) + size * (eta - 1.0))
                table = spark.sparkContext.broadcast(beta)
                documents = spark.read.schema(STATE).parquet(f"{state}/sums=false").select("terms", "counts", "weights")
                following = _written(documents.coalesce(tasks).mapInArrow(_iteration(table, alpha - 1.0, left > 1), STATE))
                remove(spark, state)
                table.destroy()
                state, counts = following, beta * _added(spark, following, size, k)
        return self._copyValues(_model(spark, counts, alpha, eta, seed))


class BatchLDA(LDA):
    """The fit of `pyspark.ml` with the optimizer "online" and its default priors, from the same start
    and over the same batches.

    That one infers the topics of a batch's documents with all topics to the end. Here a document's
    vanished topics are left out (see `variational`), and there are as many tasks as cores at most,
    so that the sums by term, of which each task has its own, do not grow with the documents.
    """

    def _fit(self, dataset: DataFrame) -> LocalLDAModel:
        spark, k = dataset.sparkSession, self.getK()
        vectors = dataset.select(F.col(self.getFeaturesCol()).alias("features"))
        documents, size = dataset.count(), vectors.first()["features"].size
        alpha = eta = 1.0 / k
        random = spark._jvm.java.util.Random(self.getSeed())
        counts = np.ascontiguousarray(draws(spark, random.nextLong(), size * k).reshape(k, size).T)
        share, done = self.getSubsamplingRate(), 0
        whole = documents / ceil(share * documents)
        rows = vectors._jdf.toJavaRDD()
        with scratch(spark):
            for _ in range(self.getMaxIter()):
                batch = rows.sample(True, share, random.nextLong())
                if batch.isEmpty():
                    continue
                done += 1
                seed = random.nextLong()
                parts = batch.getNumPartitions()
                starts = np.array([draws(spark, seed + part, k) for part in range(parts)])
                table = spark.sparkContext.broadcast((weights_of(counts, digamma_of_fit), np.full(k, alpha), starts))
                frame = DataFrame(spark._jsparkSession.createDataFrame(batch, vectors._jdf.schema()), spark)
                frame = frame.select("features", F.spark_partition_id().alias("part"))
                frame = frame.coalesce(max(1, min(parts, spark.sparkContext.defaultParallelism)))
                with _batches(spark, BLOCK):
                    found = _written(frame.mapInArrow(_batch_sums(table), STATE))
                sums = _added(spark, found, size, k)
                remove(spark, found)
                if sums.any():
                    rate = (self.getLearningOffset() + done) ** -self.getLearningDecay()
                    sums *= table.value[0]
                    counts = (1.0 - rate) * counts + rate * (sums * whole + eta)
                table.destroy()
        return self._copyValues(_model(spark, counts, alpha, eta, random.nextLong()))


def _batch_sums(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, alpha, starts = table.value
        sums, met = np.zeros(beta.shape), np.zeros(len(beta), bool)
        for batch in batches:
            documents = [
                (terms, counts, starts[part]) for (terms, counts), part in zip(_entries(batch), batch.column(1).to_pylist()) if len(terms)
            ]
            for one in variational(documents, beta, alpha, digamma_of_fit):
                terms = documents[one.number][0]
                sums[terms[:, None], one.left] += (one.counts / (one.beta @ one.theta + 1e-100))[:, None] * one.theta
                met[terms] = True
        yield from _ending(sums, met)

    return run


@contextmanager
def _batches(spark, rows: int) -> Iterator[None]:
    """Rows of documents take thousands of bytes, those of sums a million: batches of fewer rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _written(df: DataFrame) -> str:
    """Documents and sums in folders of their own, which always exist."""
    spark = df.sparkSession
    path = shared_path(spark, "topic-fit")
    df.write.partitionBy("sums").parquet(path)
    for kind in ("false", "true"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sums={kind}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def _added(spark, path: str, size: int, k: int) -> np.ndarray:
    """The sums by term of all tasks, in the driver like any model of `pyspark.ml`. Their rows are removed."""
    held = f"{path}/sums=true"
    with _batches(spark, 8):
        while True:
            sums = spark.read.schema(SUMS).parquet(held)
            tasks = -(-sums.rdd.getNumPartitions() // FAN_IN)
            sums = sums.coalesce(max(1, tasks)).mapInArrow(_adder(size, k), SUMS)
            if tasks <= 1:
                break
            sums.write.parquet(less := shared_path(spark, "topic-sums"))
            remove(spark, held)
            held = less
        added = np.zeros((size, k))
        for row in sums.collect():
            added[np.frombuffer(row.terms, np.int32)] = np.frombuffer(row.weights).reshape(-1, k)
    remove(spark, held)
    return added


def _model(spark, counts: np.ndarray, alpha: float, eta: float, seed: int) -> LocalLDAModel:
    """The local form of a model, for which the counts go to the JVM a few topics at a time."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    size, k = counts.shape
    values = gateway.new_array(jvm.double, size * k)
    for topic in range(0, k, 16):
        some = counts[:, topic : topic + 16].T.astype(">f8")
        jvm.java.nio.ByteBuffer.wrap(bytearray(some.tobytes())).asDoubleBuffer().get(values, topic * size, some.size)
    linalg = jvm.org.apache.spark.mllib.linalg
    prior = linalg.Vectors.fromML(_py2java(spark.sparkContext, DenseVector(np.full(k, alpha))))
    topics = linalg.Matrices.dense(size, k, values)
    local = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(topics, prior, eta, GAMMA_SHAPE).setSeed(seed)
    uid = LocalLDAModel.__name__ + "_" + shared_path(spark, "")[-12:]
    return LocalLDAModel(jvm.org.apache.spark.ml.clustering.LocalLDAModel(uid, size, local, spark._jsparkSession))


# Rows of documents and of sums ---------------------------------------------------------------


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A row's bytes end at its ``ends``, counted in values."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), data])


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and where each row's end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(column) and data else np.empty(0, np.uint8)
    return np.frombuffer(values.tobytes(), kind), (offsets[1:] - offsets[0]) // np.dtype(kind).itemsize


def _packed(theta: np.ndarray, least: float) -> np.ndarray:
    """Six bytes a weight: its distance from ``least``, in doubles, without the last 9 bits.

    That keeps 43 binary digits of a weight up to 2^32 times ``least``.
    """
    code = (np.ascontiguousarray(theta).view(np.uint64) - np.float64(least).view(np.uint64) + np.uint64(1 << 8)) >> np.uint64(9)
    return np.hstack([code.astype(np.uint32).view(np.uint8), (code >> np.uint64(32)).astype(np.uint16).view(np.uint8)])


def _unpacked(rows: np.ndarray, k: int, least: float) -> np.ndarray:
    low = np.ascontiguousarray(rows[:, : 4 * k]).view(np.uint32).astype(np.uint64)
    high = np.ascontiguousarray(rows[:, 4 * k :]).view(np.uint16).astype(np.uint64)
    return ((((high << np.uint64(32)) | low) << np.uint64(9)) + np.float64(least).view(np.uint64)).view(np.float64)


def _document_rows(terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, theta: np.ndarray, least: float) -> pa.RecordBatch:
    weights = _packed(theta, least)
    n, width = weights.shape
    columns = [_binary(terms, ends), _binary(counts, ends), _binary(weights, width * np.arange(1, n + 1)), pa.array(np.zeros(n, bool))]
    return pa.RecordBatch.from_arrays(columns, names=["terms", "counts", "weights", "sums"])


def _sum_rows(sums: np.ndarray, met: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    found = np.flatnonzero(met).astype(np.int32)
    for at in range(0, len(found), ROWS):
        terms = found[at : at + ROWS]
        yield terms.tobytes(), sums[terms].tobytes()


def _ending(sums: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
    for terms, weights in _sum_rows(sums, met):
        columns = [pa.array([value], pa.binary()) for value in (terms, None, weights)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([True])], names=["terms", "counts", "weights", "sums"])


def _adder(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, met = np.zeros((size, k)), np.zeros(size, bool)
        for batch in batches:
            for terms, weights in zip(*batch.columns):
                at = np.frombuffer(terms.as_buffer(), np.int32)
                sums[at] += np.frombuffer(weights.as_buffer()).reshape(-1, k)
                met[at] = True
        for row in _sum_rows(sums, met):
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary()) for value in row], names=["terms", "weights"])

    return run


# The start -----------------------------------------------------------------------------------


class _Draws:
    """`java.util.Random.nextDouble`, times 2^53, for many at once.

    The generator's 48 bits are held as the upper ones of 64, where overflow is its modulus; its
    state after any number of steps is one product and one sum away.
    """

    def __init__(self, seed: int, most: int) -> None:
        step = np.uint64(0x5DEECE66D)
        powers = np.cumprod(np.full(2 * most, step))
        sums = np.cumsum(np.concatenate([[np.uint64(1)], powers[:-1]])) * np.uint64(0xB << 16)
        self.factors = powers[::2].copy(), powers[1::2].copy()
        self.offsets = sums[::2].copy(), sums[1::2].copy()
        self.state = np.uint64(((seed ^ 0x5DEECE66D) & ((1 << 48) - 1)) << 16)
        self.held = np.empty((2, most), np.uint64)

    def take(self, n: int) -> np.ndarray:
        for half, factor, offset in zip(self.held, self.factors, self.offsets):
            np.multiply(factor[:n], self.state, out=half[:n])
            half[:n] += offset[:n]
        high, low = self.held[:, :n]
        self.state = low[-1]
        high >>= np.uint64(11)
        high &= np.uint64(~((1 << 27) - 1) & ((1 << 64) - 1))
        low >>= np.uint64(37)
        high += low
        return high.astype(np.float64)


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each vector, without zeros."""
    for vector in batch.column(0):
        if not vector.is_valid:
            raise ValueError("a document has no vector")
        counts = vector["values"].values.to_numpy()
        terms = vector["indices"].values  # none in a dense vector
        terms = np.arange(len(counts), dtype=np.int32) if terms is None else terms.to_numpy()
        if not np.isfinite(counts).all():
            raise ValueError("a vector has values that are not finite")
        if not counts.all():
            terms, counts = terms[counts != 0], counts[counts != 0]
        yield terms, counts


def _start(size: int, k: int, seed: int, least: float):
    """Each entry is dealt to the topics at random, by the generator that `pyspark.ml` has for the
    partition, in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = part = None
        sums, met = np.zeros((size, k)), np.zeros(size, bool)

        def rows(held: list) -> pa.RecordBatch:
            # Documents of a language or subject come next to each other, so that a block has fewer terms.
            held.sort(key=lambda document: tuple(document[0][:3]))
            terms, counts, theta = zip(*held)
            ends = np.cumsum([len(t) for t in terms])
            return _document_rows(np.concatenate(terms), np.concatenate(counts), ends, np.array(theta), least)

        held, entries = [], 0
        own = np.empty((DRAWN, k))
        for batch in batches:
            for (terms, counts), own_part in zip(_entries(batch), batch.column(1).to_pylist()):
                if not len(terms):
                    continue
                if own_part != part:
                    part = own_part
                    draws = _Draws(part + seed, DRAWN * k)
                theta = np.full(k, least)
                for at in range(0, len(terms), DRAWN):
                    some = terms[at : at + DRAWN]
                    drawn = draws.take(len(some) * k).reshape(-1, k)
                    share = counts[at : at + DRAWN] / drawn.sum(axis=1)
                    theta += share @ drawn
                    drawn *= share[:, None]
                    drawn += np.take(sums, some, axis=0, out=own[: len(some)], mode="clip")
                    sums[some] = drawn
                met[terms] = True
                held.append((terms, counts, theta))
                entries += len(terms)
                if len(held) == HELD * BLOCK or entries >= HELD_ENTRIES:
                    yield rows(held)
                    held, entries = [], 0
        if held:
            yield rows(held)
        yield from _ending(sums, met)

    return run


# An iteration --------------------------------------------------------------------------------


def _iteration(table, least: float, go_on: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = table.value
        size, k = beta.shape
        sums, met = np.zeros((size, k)), np.zeros(size, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                terms, ends = _values(block.column(0), np.int32)
                counts, _ = _values(block.column(1), np.float64)
                weights, _ = _values(block.column(2), np.uint8)
                theta = _unpacked(weights.reshape(len(ends), STATE_BYTES * k), k, least)
                new = _expected(beta, terms, counts, ends, theta, sums)
                met[terms] = True
                if go_on:
                    yield _document_rows(terms, counts, ends, new + least, least)
        yield from _ending(sums, met)

    return run


def _expected(beta: np.ndarray, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, theta: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Counts by document and topic of a block; those by term, still to be multiplied by ``beta``,
    are added to ``sums``."""
    n = len(ends)
    row = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    often = np.bincount(terms, minlength=len(beta)) >= max(2.0, FREQUENT * n)
    frequent, here = np.flatnonzero(often), often[terms]
    place = np.cumsum(often) - 1
    own = beta[frequent]
    shares = np.zeros((n, len(frequent)))
    shares[row[here], place[terms[here]]] = counts[here]
    shares /= theta @ own.T
    new = shares @ own
    sums[frequent] += shares.T @ theta
    terms, counts, row = terms[~here], counts[~here], row[~here]
    share, held = np.empty(len(terms)), np.empty((STEP, beta.shape[1]))
    begin = 0
    for j, end in enumerate(np.cumsum(np.bincount(row, minlength=n)).tolist()):
        for at in range(begin, end, STEP):
            some = slice(at, min(at + STEP, end))
            own = np.take(beta, terms[some], axis=0, out=held[: some.stop - at], mode="clip")
            share[some] = counts[some] / (own @ theta[j])
            new[j] += share[some] @ own
        begin = end
    order = np.argsort(terms, kind="stable")
    terms, row, share = terms[order], row[order], share[order]
    starts = np.flatnonzero(np.diff(terms, prepend=-1))
    top = 0
    for term, at, end in zip(terms[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms)]):
        if end > top:
            base, top = at, max(end, min(at + STEP, len(row)))
            own = np.take(theta, row[base:top], axis=0)
        sums[term] += share[at:end] @ own[at - base : end - base]
    return new * theta

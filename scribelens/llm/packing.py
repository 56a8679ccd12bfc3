"""Packing of documents into fixed-length sequences along a space-filling curve.

A document's token ids are counted into a hashed vector, which is brought to unit length and
projected to three dimensions; its place on the Hilbert curve through that space is its sort
key. Documents are range-sorted by key, so neighbours along the curve, which use the same
tokens, share sequences. The sorted token streams are joined end to end and cut every `LENGTH`
ids: only the very last sequence of the corpus is padded.

Only keys and lengths are sorted; ids are written once, packed in two bytes each, and meet their
places by row. A place is a sum inside a sorted partition plus the total of the partitions before
it: as many numbers as there are partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.llm.byte_bpe import ByteBpe, read_vocabulary
from scribelens.llm.tables import map_batches, read

LENGTH, END = 2048, 1
BUCKETS, AXES, AXIS_BITS = 1024, 3, 16


def hilbert_key(points: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows), ``bits`` per coordinate.

    The points are turned level by level into the frame of their sub-cube, Gray-decoded, and
    the bits of the coordinates interleaved.
    """
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(axes):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, AXES))


def curve_points(counts: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Integer coordinates of hashed count vectors (rows)."""
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    flat = 1.0 / (1.0 + np.exp(-1.7 * (counts / np.maximum(norm, 1)) @ axes))
    return np.minimum((flat * (1 << AXIS_BITS)).astype(np.int64), (1 << AXIS_BITS) - 1)


def encoded(docs: DataFrame, vocabulary: bytes, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (place on the curve), n (ids with the end id), ids (packed)."""

    def make():
        tokens, axes = ByteBpe(vocabulary), projection()
        last = np.array([end], tokens.dtype).tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [tokens.packed(t or "") + last for t in batch.column(1).to_pylist()]
            counts = np.zeros((len(packed), BUCKETS))
            for i, p in enumerate(packed):
                ids = np.frombuffer(p, tokens.dtype).astype(np.uint32)
                hashed = (ids * np.uint32(2654435761)) >> np.uint32(22)
                counts[i] = np.bincount(hashed, minlength=BUCKETS)
            keys = hilbert_key(curve_points(counts, axes))
            lengths = [len(p) // tokens.dtype.itemsize for p in packed]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "key", "n", "ids"],
            )

        return step

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(given, make, "doc_id long, key long, n long, ids binary", rows=256)


def _placed(batch: pa.RecordBatch, part: int, so_far: int) -> tuple[pa.RecordBatch, int]:
    lengths = batch.column(1).to_numpy()
    ends = so_far + np.cumsum(lengths)
    columns = [*batch.columns, pa.array(ends - lengths), pa.array([part] * len(lengths), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["row_id", "n", "place", "part"]), int(ends[-1]) if len(ends) else so_far


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    end: int = END,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``with_ids`` also the piece's ids. Every document ends in the id ``end``, so null and
    empty texts have one piece of one id. Long documents run through several sequences. Ties on
    the curve are ordered by doc_id; repeated rows are packed like others, next to each other.
    An empty table has no pieces. Other columns are ignored.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    dtype = ByteBpe(vocabulary).dtype
    tokens = encoded(docs, vocabulary, end, text, doc_id).withColumn("row_id", F.monotonically_increasing_id())
    tokens = stored(tokens, "tokens")
    ordered = (
        tokens.select("row_id", "key", "doc_id", "n")
        .repartitionByRange("key", "doc_id")
        .sortWithinPartitions("key", "doc_id", "row_id")
    )

    def make_placing():
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal so_far
            placed, so_far = _placed(batch, part, so_far)
            return placed

        return step

    placed = stored(
        map_batches(ordered.select("row_id", "n"), make_placing, "row_id long, n long, place long, part int", rows=10_000), "places"
    )
    totals = placed.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row per partition of the sort.
    places = placed.join(F.broadcast(bases), "part").select("row_id", (F.col("place") + F.col("base")).alias("place"))
    stream = tokens.join(places, "row_id").select("doc_id", "ids", "place")

    def make_cutting():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return _pieces(batch, dtype, length, with_ids)

        return step

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_batches(stream, make_cutting, schema + ", ids array<int>" * with_ids, rows=256)


def _pieces(batch: pa.RecordBatch, dtype: np.dtype, length: int, with_ids: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    for doc, packed, place in zip(*(c.to_pylist() for c in batch.columns)):
        ids = np.frombuffer(packed, dtype).astype("<u4")
        start = 0
        while start < len(ids):
            sequence, offset = divmod(place + start, length)
            part = ids[start : start + length - offset]
            row = (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), sequence, offset)
            out.append((*row, part.astype(np.int32)) if with_ids else row)
            start += len(part)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
    columns = list(zip(*out)) or [()] * len(names)
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def op6_packing(spark, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"))

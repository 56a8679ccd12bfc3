"""Shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

A partial partition is one sum per shard. The two with the largest spread are combined, the
smallest sum of one with the largest of the other, until one is left.

Groups of equal texts are the indivisible items. Those of at least a quantum (total bytes by
`shards * PARTS`) are items of their own, at most ``shards * PARTS`` of them. Smaller groups are
first gathered where they lie into bundles of about a quantum; some partitions also make bundles
of halving sizes, down to single groups, with which the differencing evens out what is left. So
the items number at most ``2 * shards * PARTS`` plus the fine bundles plus one per partition,
whatever the size of the corpus, and only their sums reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.llm.tables import attach, map_batches, read, with_run

SHARDS = 24
PARTS = 256  # quanta per shard
FINE, FINE_PARTITIONS = 16, 256  # bundles of halving size, in so many partitions
_ROW_BITS = 33  # of monotonically_increasing_id


def differencing(sizes: Sequence[int], shards: int) -> list[int]:
    """Shard of each item."""
    if not sizes:
        return []
    # A partial partition: its slots (sum, items) by falling sum; items are a tree of pairs.
    heap = [(-s, i, [(s, i)] + [(0, None)] * (shards - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        slots = [(x + y, (p, q) if p is not None and q is not None else p if q is None else q) for (x, p), (y, q) in zip(a, reversed(b))]
        slots.sort(key=lambda t: -t[0])
        low = slots[-1][0]
        slots = [(s - low, items) for s, items in slots]  # only differences matter
        heapq.heappush(heap, (-slots[0][0], count, slots))
        count += 1
    shard_of = [0] * len(sizes)
    for shard, (_, items) in enumerate(heap[0][2]):
        stack = [] if items is None else [items]
        while stack:
            top = stack.pop()
            if isinstance(top, tuple):
                stack += top
            else:
                shard_of[top] = shard
    return shard_of


def _bundles(groups: DataFrame, quantum: int) -> DataFrame:
    """Add ``bundle`` to groups (key, bytes): own bundles from ``quantum`` on, shared below."""

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        goals = [max(1, quantum >> k) for k in range(FINE, 0, -1)] if part < FINE_PARTITIONS else []
        last, filled, current = 0, 0, None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last, filled, current
            found = np.empty(batch.num_rows, np.int64)
            for i, size in enumerate(batch.column(1).to_pylist()):
                if size >= quantum:
                    found[i], last = last, last + 1
                    continue
                if current is None:
                    current, last, filled = last, last + 1, 0
                found[i] = current
                filled += size
                if filled >= (goals[0] if goals else quantum):
                    current, goals[:1] = None, []
            bundle = pa.array(found + (part << 32))
            return pa.RecordBatch.from_arrays([*batch.columns, bundle], names=["key", "bytes", "bundle"])

        return step

    return map_batches(groups.select("key", "bytes"), make, "key binary, bytes long, bundle long", rows=10_000)


def with_slots(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Add ``slot``: the place of each row in its group from 0, by ``order``, without gaps.

    Rows are range-sorted, so a group covers neighbouring partitions; a slot is the place in the
    partition plus the rows of the group in partitions before it.
    """
    at = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("_at", at)
    numbered = stored(sorted_rows, "slots")
    part, place = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = numbered.withColumns({"_part": part, "_place": place})
    sizes = numbered.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition and group it touches.
    starts = sizes.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return (
        numbered.join(F.broadcast(starts), [group, "_part"])
        .withColumn("slot", F.col("_place") + F.col("_base"))
        .drop("_at", "_part", "_place", "_base")
    )


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus ``overhead``. Rows with equal texts share a shard;
    null and empty texts are equal. Slots follow doc_id (null first), repeated rows have slots
    of their own. A group larger than a shard's share stays whole, as it is indivisible. Other
    columns are ignored; an empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("key"),
    )
    rows = stored(with_run(rows).drop("row_id"), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    quantum = max(1, total // (shards * PARTS))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    bundled = stored(_bundles(groups, quantum), "bundles")
    items = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").toArrow()
    plan = pa.table({"bundle": items["bundle"], "shard": pa.array(differencing(items["bytes"].to_pylist(), shards), pa.int32())})
    # As many rows as items, see above.
    shard_of = F.broadcast(docs.sparkSession.createDataFrame(plan))
    placed = attach(rows, bundled.join(shard_of, "bundle").select("key", "shard"), "key")
    return with_slots(placed.select("doc_id", "size", "text_crc32", "shard"), "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark, folder: str) -> DataFrame:
    return shard_by_bytes(read(spark, folder, "documents"))

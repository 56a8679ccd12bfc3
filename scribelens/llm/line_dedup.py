"""Incremental, reversible line deduplication.

Exact tables hold every reference (line key, document) with a sign, and for the keys found in at
least two documents their reference count and smallest document. Sharded cuckoo filters hold
those repeated keys. To clean documents, the distinct line keys are tested against the filter of
their shard; only those it does not rule out are looked up in the exact counts. Inserting or
deleting documents appends references, recounts the keys concerned, and adds to or removes from
the filters the keys that became or ceased to be repeated; so deleting what was inserted gives
back the state before.

A line very many documents share is one row per input partition wherever keys are exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.llm.cuckoo import CuckooFilter
from scribelens.llm.tables import SPACES, attach, map_batches, read, with_run

MIN_POINTS = 10
SHARD_KEYS = 250_000  # distinct keys per shard, about
KEY = ["high", "low"]


def line_key(line: str, min_points: int = MIN_POINTS) -> bytes | None:
    """128-bit digest of the stripped line with A-Z lower-cased; None below ``min_points``."""
    bare = line.strip(SPACES)
    if len(bare) < min_points:
        return None
    return blake2b(bare.encode().lower(), digest_size=16).digest()


def references(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, high, low: the distinct line keys of each row; no rows for null doc_ids."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys = [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {k for line in (t or "").split("\n") if (k := line_key(line, min_points))}
                ids += [doc] * len(found)
                keys += found
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                names=["doc_id", *KEY],
            )

        return step

    given = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(given, make, "doc_id long, high long, low long")


def stored_references(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS) -> DataFrame:
    """`references` written to the shared folder, as `LineIndex` takes them."""
    return stored(with_run(references(docs, text, doc_id, min_points)).drop("row_id"), "references")


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(table[k].to_numpy()) for k in KEY)


def _build_filter(shard: tuple, keys: pa.Table) -> pa.Table:
    capacity, (high, low) = keys.num_rows, _columns(keys)
    while not (built := CuckooFilter(capacity)).add(high, low):
        capacity *= 2
    return pa.table({"shard": shard[0:1], "filter": [built.dump()]}, pa.schema([("shard", pa.int64()), ("filter", pa.binary())]))


def _update_filter(shard: tuple, old: pa.Table, changes: pa.Table) -> pa.Table:
    """The changed filter; null if it is too full for the keys to add."""
    added = changes.filter(changes["add"])
    current = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else CuckooFilter(added.num_rows)
    current.remove(*_columns(changes.filter(pc.invert(changes["add"]))))
    raw = current.dump() if current.add(*_columns(added)) else None
    return pa.table({"shard": shard[0:1], "filter": [raw]}, pa.schema([("shard", pa.int64()), ("filter", pa.binary())]))


def _probe(shard: tuple, keys: pa.Table, held: pa.Table) -> pa.Table:
    keys = keys.select(KEY)
    if not held.num_rows or not keys.num_rows:
        return keys.slice(0, 0)
    return keys.filter(pa.array(CuckooFilter.load(held["filter"][0].as_py()).contains(*_columns(keys))))


@dataclass(frozen=True)
class LineIndex:
    """State of the lines inserted so far; every change returns a new state.

    ``log``: doc_id, high, low, sign. ``counts``: high, low, n, first, for keys with n > 1.
    ``filters``: shard, filter. All are tables in the shared folder.
    """

    log: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def build(rows: DataFrame) -> LineIndex:
        """Index of `stored_references`; its size sets the first number of shards, which grows with the counts."""
        spark = rows.sparkSession
        empty = LineIndex(
            spark.createDataFrame([], "doc_id long, high long, low long, sign int"),
            spark.createDataFrame([], "high long, low long, n long, first long"),
            spark.createDataFrame([], "shard long, filter binary"),
            1 + rows.count() // SHARD_KEYS,
        )
        return empty._count(rows.withColumn("sign", F.lit(1)).drop("run"), None)

    def insert(self, rows: DataFrame) -> LineIndex:
        return self._changed(rows, 1)

    def delete(self, rows: DataFrame) -> LineIndex:
        """``rows`` are the references of the documents to forget, as they were inserted."""
        return self._changed(rows, -1)

    def _changed(self, rows: DataFrame, sign: int) -> LineIndex:
        return self._count(rows.withColumn("sign", F.lit(sign)).drop("run"), rows.select(*KEY).distinct())

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod("high", F.lit(self.shards)))

    def _count(self, batch: DataFrame, touched: DataFrame | None) -> LineIndex:
        log = self.log.unionByName(batch)
        concerned = log if touched is None else log.join(touched, KEY, "left_semi")
        held = concerned.groupBy(*KEY, "doc_id").agg(F.sum("sign").alias("net")).where("net > 0")
        repeated = held.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
        if touched is None:
            counts = stored(repeated, "counts")
            changes = counts.select(*KEY, F.lit(True).alias("add"))
        else:
            counts = stored(self.counts.join(touched, KEY, "left_anti").unionByName(repeated), "counts")
            became = counts.join(self.counts, KEY, "left_anti").select(*KEY, F.lit(True).alias("add"))
            ceased = self.counts.join(counts, KEY, "left_anti").select(*KEY, F.lit(False).alias("add"))
            changes = became.unionByName(ceased)
        changed = replace(self, log=log, counts=counts)
        if touched is not None and (n := counts.count()) > SHARD_KEYS * self.shards:
            grown = replace(changed, shards=1 + 2 * n // SHARD_KEYS)
            return replace(grown, filters=grown._all_filters())
        return replace(changed, filters=changed._filters(self.filters, changes))

    def _filters(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        schema = "shard long, filter binary"
        updated = stored(
            old.groupBy("shard").cogroup(self._sharded(changes).groupBy("shard")).applyInArrow(_update_filter, schema), "filters"
        )
        full = updated.where("filter IS NULL").select("shard")
        if full.isEmpty():
            return updated
        anew = self._sharded(self.counts.select(*KEY)).join(full, "shard").groupBy("shard").applyInArrow(_build_filter, schema)
        return stored(updated.where("filter IS NOT NULL").unionByName(anew), "filters")

    def _all_filters(self) -> DataFrame:
        """Filters of all shards, from the exact counts."""
        keys = self._sharded(self.counts.select(*KEY))
        return stored(keys.groupBy("shard").applyInArrow(_build_filter, "shard long, filter binary"), "filters")

    def repeated(self, rows: DataFrame) -> DataFrame:
        """high, low, first: the keys of ``rows`` found in several documents, verified."""
        keys = self._sharded(rows.select(*KEY).distinct())
        suspects = keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, "high long, low long")
        return suspects.join(self.counts, KEY).select(*KEY, "first")

    def clean(
        self, docs: DataFrame, rows: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS, with_text: bool = False
    ) -> DataFrame:
        """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 (and kept).

        ``rows`` are the stored references of ``docs``.
        """
        extra = attach(rows, self.repeated(rows), *KEY).where("doc_id > first")
        gone = extra.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("gone"))
        given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        return map_batches(
            given.join(gone, "doc_id", "left").select("doc_id", "text", "gone"),
            lambda: lambda batch: _rewritten(batch, min_points, with_text),
            "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text,
        )


def _rewritten(batch: pa.RecordBatch, min_points: int, with_text: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        lines = (text or "").split("\n")
        drop = {np.array([g["high"], g["low"]], np.int64).tobytes() for g in gone or ()}
        kept = [x for x in lines if line_key(x, min_points) not in drop] if drop else lines
        joined = "\n".join(kept)
        out.append((len(lines), len(lines) - len(kept), sha256(joined.encode()).hexdigest(), joined))
    counts = list(zip(*out)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = [pa.array(c, t) for c, t in zip(counts, types)][: 3 + with_text]
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"][: 4 + with_text])


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS, with_text: bool = False) -> DataFrame:
    """Index all of ``docs`` and clean them: lines found in several stay in the smallest doc_id.

    Null and empty texts are one empty line. Lines shorter than ``min_points`` always stay. Rows
    repeated with one doc_id are one document. Rows without doc_id neither lose lines nor make
    others lose them. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored_references(docs, text, doc_id, min_points)
    return LineIndex.build(rows).clean(docs, rows, text, doc_id, min_points, with_text)


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {MIN_POINTS}
    GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
    SELECT k.*, coalesce(k.doc_id <> r.first, false) AS gone FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(read(spark, folder, "documents"))

"""Removal of repeated substrings of words by level-wise doubling.

A window of words that occurs twice has halves that occur twice. So windows of a short length are
counted first, and only those repeated at one length are extended to twice that length: a window
is a candidate if both its halves are repeated. This goes on until no candidate survives or the
wanted length is reached.

Documents are written once in chunks of bounded size, bucketed by chunk, so every level reads
them without an exchange. The hashes of their words are written beside them: no level splits the
texts again, and only the last step reads them. A chunk sends each distinct candidate once: its hash picks a bucket,
and of the rest 32 bits travel, sorted and as differences, about two bytes a window. A bucket
answers each chunk with one bit per window it sent. Two different windows that share these bits
only let a candidate through; at the last length 96 further bits are compared and the smallest
doc_id that holds a window is found. A window present in a third of all rows is thus one entry
per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from scribelens.functions.layout import bucket_count, bucketed, stored
from scribelens.llm.tables import map_batches, read

LENGTH, BASE = 20, 5
CHUNK_BYTES = 8 << 20  # of text in a chunk, or one longer text
BUCKET = 1 << 20  # entries in a bucket, about
REMEMBERED = 1 << 19  # words whose hashes a worker keeps
NOBODY = np.iinfo(np.int64).max  # stands for a null doc_id
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]  # odd multipliers that mix bits
SENT = "bucket long, chunk long, own long, keys binary, more binary, docs binary"
FOUND = "level int, at long, from_bucket long, buckets long, hits long, mask binary"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def split(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than blank and ``\\x09`` to ``\\x0d``."""
    return (text or "").encode().split()


def hashes(text: str | None) -> bytes:
    """64 bits for each word."""
    words = split(text)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)).tobytes()


def _mix(x: np.ndarray, odd: np.uint64) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= odd
    x ^= x >> np.uint64(29)
    return x


def windows(words: np.ndarray, base: int, length: int, odd: np.uint64 = _ODD[0]) -> np.ndarray:
    """Hashes of all windows of ``length`` words: those of ``base`` word by word, then doubled."""
    n = max(0, len(words) - length + 1)
    found = words.copy()
    for i in range(1, base):
        found = _mix(found[: max(0, len(words) - i)] * odd + words[i:], odd)
    size = base
    while size < length:
        found = _mix(found[: max(0, len(found) - size)] * odd + found[size:], odd)
        size *= 2
    return found[:n]


def _planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all first bytes first: runs of zeros for the codec of the exchange."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _integers(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack(rest: np.ndarray) -> bytes:
    """Sorted 32-bit integers as differences."""
    return _planes(np.diff(rest, prepend=np.uint32(0)).astype(np.uint32))


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(_integers(raw, np.uint32), dtype=np.uint32)


class Chunk:
    """The documents of a chunk in order of doc_id, and which of their windows are repeated."""

    def __init__(self, rows: pa.Table, levels: list[int]):
        doc = rows["doc_id"].combine_chunks()
        self.null = doc.is_null().to_numpy(zero_copy_only=False)
        ids = doc.fill_null(NOBODY).to_numpy()
        by = np.lexsort((rows["row"].to_numpy(), ids))
        self.order, self.ids, self.null = by, ids[by], self.null[by]
        hashed = rows["words"].take(pa.array(by)).to_pylist()
        self.lengths = np.array([len(h) // 8 for h in hashed], np.int64)
        self.words = np.frombuffer(b"".join(hashed), np.uint64)
        self.ends = np.cumsum(self.lengths)
        self.levels = levels

    def _starts(self, length: int) -> np.ndarray:
        """Where a window of ``length`` words lies inside one document."""
        n = max(0, len(self.words) - length + 1)
        inside = np.ones(len(self.words), bool)
        for end, size in zip(self.ends.tolist(), self.lengths.tolist()):
            inside[max(end - size, end - length + 1) : end] = False
        return inside[:n]

    def candidates(self, answers: list[tuple[int, dict[int, bytes]]]) -> np.ndarray:
        """Starts of the windows to test at the level after the answered ones.

        ``answers``: for each level so far the number of buckets and the masks they sent.
        """
        alive = None
        for level, length in enumerate(self.levels):
            valid = self._starts(length)
            if alive is not None:
                half = length // 2
                valid &= alive[: len(valid)] & alive[half : half + len(valid)]
            at = np.flatnonzero(valid)
            if level == len(answers):
                return at
            buckets, masks = answers[level]
            keys, which, count = np.unique(self.keys(at, length, buckets), return_inverse=True, return_counts=True)
            repeated = (count > 1) | self._answered(keys, masks)
            alive = np.zeros(max(0, len(self.words) - length + 1), bool)
            alive[at] = repeated[which]
        raise ValueError("all levels are answered")

    def keys(self, at: np.ndarray, length: int, buckets: int) -> np.ndarray:
        """Bucket in the upper half, 32 bits of the hash in the lower."""
        found = windows(self.words, self.levels[0], length)[at]
        return ((found >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (found & np.uint64(0xFFFFFFFF))

    @staticmethod
    def _answered(keys: np.ndarray, masks: dict[int, bytes]) -> np.ndarray:
        """One bit per distinct key, which are sorted by bucket."""
        found = np.zeros(len(keys), bool)
        for bucket, raw in masks.items():
            low, high = np.searchsorted(keys, np.array([bucket << 32, (bucket + 1) << 32], np.uint64))
            found[low:high] = np.unpackbits(np.frombuffer(raw, np.uint8), count=high - low)
        return found

    def grouped(self, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of the last length grouped by content: sorted keys and further bits of the
        groups, place of each group's first window in ``at``, and each window's group."""
        length = self.levels[-1]
        keys, more = self.keys(at, length, buckets), windows(self.words, self.levels[0], length, _ODD[1])[at]
        by = np.lexsort((more, keys))  # stable: of equal windows the first comes first
        keys, more = keys[by], more[by]
        new = np.ones(len(by), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        return keys[new], more[new], by[new], group

    def covered(self, at: np.ndarray, buckets: int, masks: dict[int, bytes]) -> np.ndarray:
        """Words covered by a window that starts earlier too."""
        keys, _, first, group = self.grouped(at, buckets)
        repeated = np.ones(len(at), bool)
        repeated[first] = self._answered(keys, masks)
        step = np.zeros(len(self.words) + 1, np.int64)
        step[at[repeated]] += 1
        step[at[repeated] + self.levels[-1]] -= 1  # starts differ, so no place is counted twice
        return np.cumsum(step)[:-1] > 0


def _per_bucket(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(bucket[a]), slice(a, b)


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _sent(chunk: int, rows: pa.Table, replies: pa.Table | None, levels: list[int], level: int, buckets: list[int]) -> pa.Table:
    """The distinct candidates of a chunk, by bucket."""
    answers = _masks(replies, buckets[:level])
    own = Chunk(rows, levels)
    at, out = own.candidates(answers), []
    if level < len(levels) - 1:
        keys, count = np.unique(own.keys(at, levels[level], buckets[level]), return_counts=True)
        for bucket, part in _per_bucket(keys):
            rest = (keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((bucket, chunk, int((count[part] > 1).sum()), _pack(rest), None, None))
    else:
        keys, more, first, group = own.grouped(at, buckets[level])
        docs = own.ids[np.searchsorted(own.ends, at[first], side="right")]
        many = np.bincount(group, minlength=len(keys)) > 1
        for bucket, part in _per_bucket(keys):
            rest = (keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((bucket, chunk, int(many[part].sum()), _pack(rest), more[part].tobytes(), _planes(docs[part])))
    return _table(out, SENT)


def _masks(replies: pa.Table | None, buckets: list[int]) -> list[tuple[int, dict[int, bytes]]]:
    """Per level its number of buckets and the masks sent to this chunk."""
    found: list[tuple[int, dict[int, bytes]]] = [(b, {}) for b in buckets]
    for r in [] if replies is None else replies.to_pylist():
        found[r["level"]][1][r["from_bucket"]] = r["mask"]
    return found


def _met(bucket: int, sent: pa.Table, level: int, buckets: int) -> pa.Table:
    """Which of the windows that chunks sent are repeated elsewhere; at the last length, earlier."""
    chunks, own = sent["chunk"].to_numpy(), sent["own"].to_numpy()
    parts = [_unpack(k) for k in sent["keys"].to_pylist()]
    sizes = [len(p) for p in parts]
    rest = np.concatenate(parts)
    if sent["more"].null_count:
        ordered = np.sort(rest)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        place = np.minimum(np.searchsorted(twice, rest), max(0, len(twice) - 1))
        hit = twice[place] == rest if len(twice) else np.zeros(len(rest), bool)
    else:
        more = np.frombuffer(b"".join(sent["more"].to_pylist()), np.uint64)
        docs = np.concatenate([_integers(d, np.int64) for d in sent["docs"].to_pylist()])
        by = np.lexsort((np.repeat(chunks, sizes), docs, more, rest))
        first = np.ones(len(by), bool)
        first[1:] = (rest[by][1:] != rest[by][:-1]) | (more[by][1:] != more[by][:-1])
        hit = np.empty(len(by), bool)
        hit[by] = ~first
    ends = np.cumsum(sizes)
    out = []
    for chunk, mine, end, size in zip(chunks.tolist(), own.tolist(), ends.tolist(), sizes):
        part = hit[end - size : end]
        if part.any() or mine:
            out.append((level, chunk, bucket, buckets, int(part.sum()) + mine, np.packbits(part).tobytes()))
    return _table(out, FOUND)


def _cleaned(rows: pa.Table, replies: pa.Table, levels: list[int], buckets: list[int], with_text: bool) -> pa.Table:
    own = Chunk(rows, levels)
    gone = np.zeros(len(own.words), bool)
    if len(buckets) == len(levels):  # else no candidate survived an earlier length
        answers = _masks(replies, buckets)
        gone = own.covered(own.candidates(answers[:-1]), *answers[-1])
    out = []
    for i, t in enumerate(rows["text"].take(pa.array(own.order))):
        end, size = int(own.ends[i]), int(own.lengths[i])
        words, drop = split(t.as_py()), gone[end - size : end]
        n = int(drop.sum())
        kept = b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if n else words)
        row = (None if own.null[i] else int(own.ids[i]), size, n, sha256(kept).hexdigest())
        out.append((*row, kept.decode()) if with_text else row)
    return _table(out, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def chunked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, row, n_bytes, words, doc_id, text, bucketed by chunk: consecutive rows of about ``chunk_bytes``.

    ``words`` holds the hashes of the text's words.
    """

    def make():
        from pyspark import TaskContext

        chunk, room, row = TaskContext.get().partitionId() << 24, chunk_bytes, 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal chunk, room, row
            numbers, rows = [], []
            for size in batch.column(2).to_pylist():
                if room < size and row:
                    chunk, room, row = chunk + 1, chunk_bytes, 0
                room, row = room - size, row + 1
                numbers.append(chunk)
                rows.append(row)
            words = pa.array([hashes(t.as_py()) for t in batch.column(1)], pa.binary())
            columns = [pa.array(numbers, pa.int64()), pa.array(rows, pa.int64()), batch.column(2), words, *batch.columns[:2]]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "row", "n_bytes", "words", "doc_id", "text"])

        return step

    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    rows = map_batches(given, make, "chunk long, row long, n_bytes long, words binary, doc_id long, text string")
    return bucketed(rows, "chunks", bucket_count(docs.sparkSession), "chunk")


def drop_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    base: int = BASE,
    text: str = "text",
    doc_id: str = "doc_id",
    with_text: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256 (and kept, joined by one blank).

    A word goes if a window of ``length`` words that covers it also starts earlier: in a row of
    smaller doc_id, or earlier in its own. ``length`` is ``base`` times a power of two. Null and
    empty texts have no words; texts shorter than a window lose none. Rows without doc_id come
    after all others; rows of one doc_id are ordered as they were read, so of repeated rows the
    first keeps its words. Empty tables give no rows, other columns are ignored. The chunks and
    answers stay in the shared folder.
    """
    levels = [base]
    while levels[-1] < length:
        levels.append(2 * levels[-1])
    if levels[-1] != length:
        raise ValueError("the length must be the base times a power of two")
    chunks = chunked(docs, text, doc_id, chunk_bytes)
    rows = chunks.select("chunk", "row", "words", "doc_id").groupBy("chunk")
    entries = (chunks.agg(F.sum("n_bytes")).first()[0] or 0) // 6
    least = min(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets: list[int] = []
    replies: DataFrame | None = None
    for level in range(len(levels)):
        buckets.append(max(least, 1 + entries // bucket))
        sent = _with_replies(rows, replies, _sender(levels, level, list(buckets)), SENT)
        found = stored(sent.groupBy("bucket").applyInArrow(_meeting(level, buckets[-1]), FOUND), "repeated")
        entries = found.agg(F.sum("hits")).first()[0]
        if not entries:
            buckets.pop()
            break
        replies = found if replies is None else replies.unionByName(found)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    rows = chunks.select("chunk", "row", "words", "doc_id", "text").groupBy("chunk")
    return _with_replies(rows, replies, _cleaner(levels, buckets, with_text), schema)


def _with_replies(rows, replies: DataFrame | None, step, schema: str) -> DataFrame:
    """``step`` on every chunk and the answers to it."""
    if replies is None:
        return rows.applyInArrow(lambda key, chunk: step(key[0].as_py(), chunk, None), schema)
    return rows.cogroup(replies.groupBy("at")).applyInArrow(lambda key, chunk, answers: step(key[0].as_py(), chunk, answers), schema)


def _sender(levels: list[int], level: int, buckets: list[int]):
    return lambda chunk, rows, replies: _sent(chunk, rows, replies, levels, level, buckets)


def _meeting(level: int, buckets: int):
    return lambda key, sent: _met(key[0].as_py(), sent, level, buckets)


def _cleaner(levels: list[int], buckets: list[int], with_text: bool):
    return lambda chunk, rows, replies: _cleaned(rows, replies, levels, buckets, with_text)


ORACLE = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
wins AS (
    SELECT doc_id, s AS pos, array_to_string(w[s + 1 : s + {LENGTH}], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(len(w) - {LENGTH - 1})) AS s FROM docs)),
marked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM wins),
covered AS (
    SELECT w.doc_id, w.pos, w.word, coalesce(bool_or(m.again) OVER (
        PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), false) AS gone
    FROM words w LEFT JOIN marked m ON m.doc_id = w.doc_id AND m.pos = w.pos),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept
    FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeats(read(spark, folder, "documents"))

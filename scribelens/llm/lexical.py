"""Ranked lexical search by dense blocked matrix products.

The queries (items) are taken in rounds of bounded vocabulary. One scan of the documents per
round keeps, for each document, its length and the counts of the round's terms, and the
statistics (documents, terms, document frequencies) are summed from that table. Then documents
and items are multiplied tile by tile: a tile of documents is a float64 matrix of impacts over
the terms that occur in it, a tile of items one of weights over the same terms. All entries are
integers; a product is cut into columns so few that no partial sum can reach 2^53, so the
products are exact and their sum is taken in 64-bit integers. Every task keeps the best rows of
each item, ordered by score and then doc_id, so ties at the cut are not left to chance.

All items meet all documents, in blocks; no table of pairs is formed. What is exchanged are the
best rows of each item and task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scribelens.functions.layout import stored
from scribelens.llm.tables import LOWER, UPPER, map_batches, read

TOP = 10
ROUND_BYTES = 32 << 20  # of item terms in one round; a larger item is a round of its own
ITEM_TILE, DOC_TILE = 256, 512
SCALE = 1_000_000_000
EXACT = 1 << 53
# Bytes of terms are themselves, A-Z lower-cased; all others separate terms.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, length: int, documents: int, total: int) -> np.ndarray:
    """Integer impact of counts in a document of ``length`` terms; below a million."""
    m = 10 + 90 * length * documents // total
    return SCALE * tf // (1000 * tf + 8 * m)


class Items:
    """The items of a round: distinct terms numbered, and each item's term numbers."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = []
        for _, found in rows:
            numbers = {self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found}
            self.terms.append(np.array(sorted(numbers), np.int64))

    def tiles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First item, its distinct terms, and (item, place among these) of every entry, tile by tile."""
        for at in range(0, len(self.ids), ITEM_TILE):
            some = self.terms[at : at + ITEM_TILE]
            flat = np.concatenate(some)
            distinct, place = np.unique(flat, return_inverse=True)
            yield at, distinct, np.repeat(np.arange(len(some)), [len(t) for t in some]), place


def _rounds(items: DataFrame, text: str, item_id: str) -> Iterator[Items]:
    """Items with terms, in rounds. They come to the driver one partition at a time."""
    rows, size = [], 0
    for item in items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text")).toLocalIterator():
        found = set(terms((item.text or "").encode()))
        held = sum(map(len, found))
        if rows and size + held > ROUND_BYTES:
            yield Items(rows)
            rows, size = [], 0
        if found:
            rows.append((item.item, found))
            size += held
    if rows:
        yield Items(rows)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (packed numbers and counts of the vocabulary's terms)."""

    def make():
        get = vocabulary.get

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lengths, numbers, counts = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                found = terms(t or b"")
                held = Counter(filter(None.__ne__, map(get, found)))
                lengths.append(len(found))
                numbers.append(np.fromiter(held.keys(), "<i4", len(held)).tobytes())
                counts.append(np.fromiter(held.values(), "<i4", len(held)).tobytes())
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

        return step

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(given, make, "doc_id long, n long, terms binary, tfs binary")


def holding(table: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the vocabulary's ``size`` terms; every task adds its rows up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            found += np.bincount(np.frombuffer(raw, "<i4"), minlength=size)
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(found[term], pa.int64())], names=["term", "n"])

    summed = table.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size, np.int64)
    df[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return df


class Best:
    """The best rows of each item so far: score downwards, then doc_id upwards, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.none = [np.zeros(0, bool)] * items
        self.bar = np.zeros(items, np.int64)  # scores below it cannot enter

    def offer(self, first: int, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        """``scores``: documents by items, from item ``first`` on."""
        enters = (scores > 0) & (scores >= self.bar[first : first + scores.shape[1]])
        for i in np.flatnonzero(enters.any(axis=0)).tolist():
            at = np.flatnonzero(enters[:, i])
            j = first + i
            score = np.concatenate([self.score[j], scores[at, i]])
            doc = np.concatenate([self.doc[j], docs[at]])
            null = np.concatenate([self.none[j], none[at]])
            by = np.lexsort((doc, null, -score))[: self.top]
            self.score[j], self.doc[j], self.none[j] = score[by], doc[by], null[by]
            if len(by) == self.top:
                self.bar[j] = score[by[-1]]


def multiply(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Product of integer float64 matrices whose products are at most ``most``, exact in 64 bits."""
    width = max(1, (EXACT - 1) // max(1, most))
    out = np.zeros((left.shape[0], right.shape[1]), np.int64)
    for at in range(0, left.shape[1], width):
        out += (left[:, at : at + width] @ right[at : at + width]).astype(np.int64)
    return out


def _search(table: DataFrame, items: Items, weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """item (number in the round), doc_id, score: the best rows of each item in every task."""
    tiles, count = list(items.tiles()), len(items.ids)
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(count, top)
        for batch in batches:
            for start in range(0, batch.num_rows, DOC_TILE):
                _tile(batch.slice(start, DOC_TILE), best)
        number = np.repeat(np.arange(count), [len(s) for s in best.score])
        doc, none = np.concatenate(best.doc), np.concatenate(best.none)
        columns = [pa.array(number), pa.array(doc, mask=none), pa.array(np.concatenate(best.score))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    def _tile(batch: pa.RecordBatch, best: Best) -> None:
        lengths = batch.column(1).to_pylist()
        held = [np.frombuffer(t, "<i4") for t in batch.column(2).to_pylist()]
        value = [
            impacts(np.frombuffer(c, "<i4").astype(np.int64), n, documents, total)
            for n, c in zip(lengths, batch.column(3).to_pylist())
        ]
        row = np.repeat(np.arange(len(held)), [len(t) for t in held])
        term, value = np.concatenate(held), np.concatenate(value)
        none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        docs = batch.column(0).fill_null(0).to_numpy()
        here = np.zeros(size, bool)
        here[term] = True
        for first, distinct, item, place in tiles:
            used = here[distinct]  # only columns that both tiles have
            column = np.cumsum(used) - 1
            at = np.full(size, -1)
            at[distinct[used]] = column[used]
            mine = at[term] >= 0
            left = np.zeros((len(held), int(used.sum())))
            left[row[mine], at[term[mine]]] = value[mine]
            kept = used[place]
            right = np.zeros((left.shape[1], item[-1] + 1))
            right[column[place[kept]], item[kept]] = weights[distinct[place[kept]]]
            best.offer(first, multiply(left, right, int(right.max(initial=0)) * (SCALE // 1000)), docs, none)

    return table.where("n > 0").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of highest score above 0 for every item.

    Equal scores are ordered by doc_id, nulls last; repeated rows are documents of their own.
    Null and empty texts have no terms: such documents count nowhere, such items have no rows.
    Items of one item_id are one item each. Empty tables give no rows; other columns are ignored.
    The counts of the documents stay in the shared folder.
    """
    found = []
    kind = items.schema[item_id].dataType
    for some in _rounds(items, item_text, item_id):
        table = stored(postings(docs, some.vocabulary, text, doc_id), "postings")
        documents, total = table.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        df = holding(table, len(some.vocabulary))
        weights = np.array([weight(documents, n) for n in df.tolist()], np.float64)
        best = _search(table, some, weights, documents, total, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        numbers = StructType([StructField("item", LongType()), StructField("item_id", kind)])
        named = items.sparkSession.createDataFrame(list(enumerate(some.ids)), numbers)
        found.append(ranked.join(named, "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return items.select(F.col(item_id).alias("item_id"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH words AS (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents)),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM (SELECT DISTINCT doc_id, n FROM words)),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM words GROUP BY doc_id, term, n),
wanted AS (SELECT DISTINCT item_id, unnest(w) AS term FROM (SELECT item_id, {_TERMS} AS w FROM benchmark)),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, total GROUP BY term),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))))::BIGINT AS score
    FROM wanted JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""

"""Term counts against a vocabulary, in long form and as fitted vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import bucket_count, bucketed, stored

VOCABULARY_SIZE = 10_000
TRACKED = 20  # terms a task keeps for each term of the vocabulary: all cores of an executor hold as many


def _summaries(tokens: DataFrame, capacity: int) -> DataFrame:
    """term, n: a summary of each task's terms, and in the row without term what it may be short by.

    A task keeps at most ``2 * capacity`` counts. When there are more, the largest that is to go
    is taken off all of them, and those left with nothing go: no count is short by more than the
    sum of what was taken off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        short = 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            for term, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                held[term] += n
            if len(held) > 2 * capacity:
                counts = np.fromiter(held.values(), np.int64, len(held))
                off = int(np.partition(counts, -capacity - 1)[-capacity - 1])
                held = Counter({t: n - off for t, n in held.items() if n > off})
                short += off
        terms, counts = [*held.keys(), None], [*held.values(), short]
        for at in range(0, len(terms), 10_000):
            columns = [pa.array(terms[at : at + 10_000], pa.string()), pa.array(counts[at : at + 10_000], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "n"])

    return tokens.select("tokens").mapInArrow(run, "term string, n bigint")


def term_frequencies(tokens: DataFrame, size: int, capacity: int | None = None) -> DataFrame:
    """term, n: exact counts of some terms, the ``size`` most frequent among them.

    What is exchanged are summaries of bounded size, not all distinct terms. With ``e`` as the sum
    of what the summaries may be short by, a term's count lies between its sum and its sum plus
    ``e``, and that of a term in none of them is at most ``e``. If nothing was taken off, the sums
    are the counts. Else the terms that may reach the ``size``-th largest sum are counted in a
    second scan; they are all there are if that sum is above ``e``. Where it is not, the summaries
    prove nothing, and all terms are counted.
    """
    sums = stored(_summaries(tokens, capacity or TRACKED * size).groupBy("term").agg(F.sum("n").alias("n")), "summaries")
    error = sums.where("term IS NULL").agg(F.sum("n")).first()[0] or 0
    known = sums.where("term IS NOT NULL")
    if not error:
        return known
    bar = known.orderBy(F.desc("n")).limit(size).agg(F.when(F.count("*") == size, F.min("n"))).first()[0] or 0
    every = tokens.select(F.explode("tokens").alias("term"))
    if bar > error:
        every = every.join(known.where(F.col("n") + error >= bar).select("term"), "term", "left_semi")
    return every.groupBy("term").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame, size: int = VOCABULARY_SIZE, capacity: int | None = None) -> DataFrame:
    """The ``size`` most frequent terms, numbered from 0; ties by term.

    The numbering window sees only ``size`` rows.
    """
    top = term_frequencies(tokens, size, capacity).orderBy(F.desc("n"), "term").limit(size)
    order = Window.orderBy(F.desc("n"), "term")
    return top.select((F.row_number().over(order) - 1).alias("idx"), "term", "n")


def term_counts(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Non-zero counts (doc_id, idx, count).

    The vocabulary is stored first, so Spark broadcasts it if its true size allows. All tokens of a document sit in one row, so the counts are complete
    before the shuffle.
    """
    side = stored(vocab.select("term", "idx"), "vocabulary")
    return (
        tokens.select("doc_id", F.explode("tokens").alias("term"))
        .join(side, "term")
        .groupBy("doc_id", "idx")
        .agg(F.count("*").alias("count"))
    )


def fit_text(documents: DataFrame, size: int = VOCABULARY_SIZE, words: list[str] | None = None) -> PipelineModel:
    """Tokeniser, stop-word remover and count vectors as one fitted pipeline.

    The terms counted are those of `vocabulary`, whose ties are ordered, so a corpus has one
    model. They come to the driver, at most ``size`` of them.
    """
    tokenizer = RegexTokenizer(inputCol="text", outputCol="raw_tokens")
    remover = StopWordsRemover(inputCol="raw_tokens", outputCol="tokens")
    if words is not None:
        remover = remover.setStopWords(words)
    tokens = remover.transform(tokenizer.transform(documents)).select("tokens")
    terms = [r.term for r in sorted(vocabulary(tokens, size).collect(), key=lambda r: r.idx)]
    counter = CountVectorizerModel.from_vocabulary(terms, "tokens", "features")
    return PipelineModel([tokenizer, remover, counter])


def vectorize(model: PipelineModel, documents: DataFrame) -> DataFrame:
    return model.transform(documents).select("doc_id", "features")


def fitted_vocabulary(model: PipelineModel, documents: DataFrame) -> DataFrame:
    """Terms of the fitted vectors with their index (at most the vocabulary size)."""
    terms = list(enumerate(model.stages[-1].vocabulary))
    return documents.sparkSession.createDataFrame(terms, "idx INT, term STRING")


def vector_store(vectors: DataFrame) -> DataFrame:
    """Vectors written once, bucketed and sorted by doc_id: joins by doc_id do not exchange them."""
    return bucketed(vectors, "vector-store", bucket_count(vectors.sparkSession), "doc_id")


def documents_in_truth(vectors: DataFrame, truth: DataFrame) -> DataFrame:
    """Vectors of the documents some user is expected to edit."""
    wanted = truth.select(F.col("article_id").alias("doc_id")).distinct()
    return vectors.join(wanted, "doc_id", "left_semi")

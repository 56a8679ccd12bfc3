"""Corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on every row it is given. All but the last
return the rows they keep with the columns of ``documents``; packing returns one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scribelens.functions.layout import stored
from scribelens.llm import exact_dedup, packing, quality, simhash
from scribelens.llm.tables import read

# The classifier is learned and its decisions are not expressible in SQL.
ORACLE_SQL = None


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5; the model is fitted on the labelled ones among them."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group of close fingerprints."""
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", judge_quality),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read by the next stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

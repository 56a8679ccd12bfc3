"""Readers for document vectors and vocabularies in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_vectors(lines: DataFrame) -> DataFrame:
    """Lines ``id;…;(size,[indices],[values])`` or ``id;…;[values]``: first and last field, as
    arrays. Of dense vectors the entries that are not zero are kept."""
    parts = F.split("value", ";")
    body = F.element_at(parts, -1)
    sparse = r"^\((\d+),\[([^\]]*)\],\[([^\]]*)\]\)$"
    dense = body.startswith("[")

    def numbers(text, kind: str):
        return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast(kind))

    values = numbers(F.regexp_extract(body, r"^\[([^\]]*)\]$", 1), "double")
    indexed = F.filter(
        F.transform(values, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0
    )
    return lines.select(
        parts[0].cast("bigint").alias("doc_id"),
        F.when(dense, F.size(values)).otherwise(F.regexp_extract(body, sparse, 1).try_cast("int")).alias("size"),
        F.when(dense, F.transform(indexed, lambda e: e["i"]))
        .otherwise(numbers(F.regexp_extract(body, sparse, 2), "int"))
        .alias("indices"),
        F.when(dense, F.transform(indexed, lambda e: e["x"]))
        .otherwise(numbers(F.regexp_extract(body, sparse, 3), "double"))
        .alias("counts"),
    )


def vector_entries(vectors: DataFrame) -> DataFrame:
    """Long form: one row per non-zero entry."""
    return vectors.select(
        "doc_id", F.explode(F.arrays_zip("indices", "counts")).alias("e")
    ).select("doc_id", F.col("e.indices").alias("term_idx"), F.col("e.counts").alias("count"))


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    """A line of terms separated by non-word characters; the position is the term index."""
    return lines.select(F.posexplode(F.split("value", r"\W+")).alias("idx", "term"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return parse_vocabulary(spark.read.text(path))

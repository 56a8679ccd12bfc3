"""Writers. Every writer is one distributed job; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 51
MAX_ARTICLE = 51_000_000


def with_bucket(revisions: DataFrame, buckets: int = BUCKETS, top: int = MAX_ARTICLE) -> DataFrame:
    """Range bucket of the article id; ids beyond ``top`` go to the last bucket."""
    width = top // buckets
    return revisions.withColumn(
        "bucket", F.least(F.floor(F.col("article_id") / width), F.lit(buckets - 1)).cast("int")
    )


def write_revision_buckets(
    revisions: DataFrame, path: str, buckets: int = BUCKETS, top: int = MAX_ARTICLE
) -> None:
    """Partitioned revisions. Rebalancing merges small buckets into a task and splits full ones,
    so files have a sensible size and no bucket is a hot spot."""
    (
        with_bucket(revisions, buckets, top)
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def write_split(aggregated: DataFrame, path: str) -> None:
    """Training and test aggregates side by side, pruned by ``split`` when read."""
    aggregated.write.mode("overwrite").partitionBy("split").parquet(path)


def write_vectors(vectors: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """Document vectors and their vocabulary below one path."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def vector_lines(vectors: DataFrame) -> DataFrame:
    """Text form ``id;(size,[indices],[values])`` of (doc_id, size, indices, counts)."""
    return vectors.select(
        F.format_string(
            "%d;(%d,[%s],[%s])",
            "doc_id",
            "size",
            F.array_join(F.col("indices").cast("array<string>"), ","),
            F.array_join(F.col("counts").cast("array<string>"), ","),
        ).alias("value")
    )


def write_vector_lines(vectors: DataFrame, path: str) -> None:
    """Vectors as text, one line each, as `sources.vectors.read_vectors` takes them."""
    write_lines(vector_lines(vectors), path)


def vocabulary_line(vocabulary: DataFrame) -> DataFrame:
    """The terms of a vocabulary in one line; there are as many as its size, a parameter, says."""
    placed = F.array_sort(F.collect_list(F.struct("idx", "term")))
    return vocabulary.agg(F.array_join(F.transform(placed, lambda t: t["term"]), " ").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Page records as dump XML, for tests and exchange."""
    (
        pages.write.format("xml")
        .option("rootTag", "mediawiki")
        .option("rowTag", "page")
        .option("compression", compression)
        .save(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text without header, as the delimited readers expect it."""
    df.write.mode("overwrite").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """One table of an evaluation run."""
    report.write.mode("overwrite").parquet(path)


def write_single_file(lines: DataFrame, path: str) -> None:
    """One text file, for small results that a person reads."""
    lines.coalesce(1).write.mode("overwrite").text(path)

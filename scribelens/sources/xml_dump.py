"""Readers for the page XML of a wiki dump.

Both are read as text cut at the end of a record, so plain files and bz2 streams are split among
tasks. The records of an article dump are pages. In a history they are revisions, as a page may
have any number of them; ids and namespace of the page are carried along.
Gzip files cannot be split: each is read by one task; ``partitions`` spreads their rows afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored

REVISION = "timestamp STRING, contributor STRUCT<id: BIGINT>, minor STRING, text STRUCT<_bytes: BIGINT>"
CARRIED = (
    "file STRING, block BIGINT, article_id BIGINT, ns INT, user_id BIGINT, bytes BIGINT, minor BOOLEAN, time STRING, at BIGINT"
)
# Text is a struct when the element has attributes and a string when it has none; asking for
# the string works for both.
ARTICLES = "id BIGINT, ns INT, title STRING, revision ARRAY<STRUCT<text: STRING>>"
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row ``page`` per page."""
    records = spark.read.option("lineSep", "</page>").text(path).where(F.col("value").contains("<page"))
    # What stands before the first page is the file's head.
    page = F.concat(F.regexp_replace("value", r"(?s)^.*?(?=<page[\s>])", ""), F.lit("</page>"))
    return records.select(F.from_xml(page, schema, {"ignoreSurroundingSpaces": "false"}).alias("page"))


def _revisions(spark: SparkSession, path: str) -> DataFrame:
    """One row per revision; ids of the page only in the row of its first revision."""
    lines = spark.read.option("lineSep", "</revision>").text(path).where(F.col("value").contains("<revision"))
    head = F.substring_index("value", "<revision", 1)
    page = F.when(head.contains("<page"), F.substring_index(head, "<page", -1))
    revision = F.concat(F.lit("<revision"), F.substring_index("value", "<revision", -1), F.lit("</revision>"))

    def number(tag: str, kind: str):
        return F.regexp_extract(page, rf"<{tag}>\s*(-?[0-9]+)\s*</{tag}>", 1).try_cast(kind)

    return lines.select(
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("block"),
        number("id", "bigint").alias("article_id"),
        number("ns", "int").alias("ns"),
        F.from_xml(revision, REVISION).alias("r"),
    ).select(
        "file", "block", "article_id", "ns",
        F.coalesce("r.contributor.id", F.lit(0).cast("bigint")).alias("user_id"),
        F.coalesce("r.text._bytes", F.lit(1).cast("bigint")).alias("bytes"),
        F.col("r.minor").isNotNull().alias("minor"),
        F.col("r.timestamp").alias("time"),
    )


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give revisions the ids of the page before them in the same block of a file, and number
    them."""
    place, page, at = None, (None, None), 0
    for batch in batches:
        ids, spaces = [], []
        for file, block, i, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (file, block) != place:
                place, page = (file, block), (None, None)
            if i is not None:
                page = (i, n)
            ids.append(page[0])
            spaces.append(page[1])
        filled = [pa.array(ids, pa.int64()), pa.array(spaces, pa.int32())]
        numbers = pa.array(range(at, at + len(ids)), pa.int64())
        at += len(ids)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *filled, *batch.columns[4:], numbers], names=[*batch.schema.names, "at"]
        )


def read_history(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Every revision of every page: ids, namespace, bytes, minor flag and time.

    A task holds one revision at a time. Where a page goes on in another block of its file, its
    ids come from the last page that began in the blocks before.
    """
    rows = stored(_revisions(spark, path).mapInArrow(_carry, CARRIED), "revisions")
    page = F.when(F.col("article_id").isNotNull(), F.struct("article_id", "ns"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of a file.
    before = (
        rows.groupBy("file", "block")
        .agg(F.max_by(page, "at").alias("page"))
        .select("file", "block", F.last("page", ignorenulls=True).over(earlier).alias("before"))
    )
    whole = rows.where("article_id IS NOT NULL")
    cut = (
        rows.where("article_id IS NULL")
        .drop("article_id", "ns")
        .join(before, ["file", "block"])
        .select("*", "before.article_id", "before.ns")
        .drop("before")
    )
    rows = whole.unionByName(cut)
    if partitions:
        rows = rows.repartition(partitions)
    time = F.try_to_timestamp(F.col("time"), F.lit(TIMESTAMP)).cast("timestamp_ntz").alias("ts")
    return rows.select("article_id", "ns", "user_id", "bytes", "minor", time)


def read_articles(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Articles; the texts of a page with several revisions are joined in file order."""
    pages = _pages(spark, path, ARTICLES)
    if partitions:
        pages = pages.repartition(partitions)
    return pages.select(
        F.col("page.id").alias("article_id"),
        "page.ns",
        "page.title",
        F.array_join("page.revision.text", "").alias("text"),
    )

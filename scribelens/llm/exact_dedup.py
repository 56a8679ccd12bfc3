"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its rows are folded to one entry per digest, sorted by digest.
Rounds then merge `fan` neighbouring runs at a time until one run is left. A round is a grouped
aggregation on (run, digest): its rows are exchanged by both, sorted and merged, so the entries
of a run stay spread over all tasks, and a group of copies arrives as at most `fan` entries. At
each level an entry keeps the row that stays and the number of rows it stands for. Equality is
verified on each level: SHA-256, a second 64-bit hash and the length must all agree.

The decision goes back down the same tree: to the entries of the leaf runs and from there to the
rows, by run and digest, so a group that holds a third of all rows is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.llm.tables import attach, with_run

WHITE = r"[\x20\x09-\x0D]"
KEY = ["digest", "check", "n_plain"]
FAN = 16


def plain(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    points = F.length(F.coalesce(F.col(text), F.lit("")))
    named = docs.select(
        F.col(doc_id).alias("doc_id"), plain(F.col(text)).alias("plain"), points.alias("n_points")
    )
    return with_run(
        named.select(
            "doc_id",
            "n_points",
            F.unhex(F.sha2("plain", 256)).alias("digest"),
            F.xxhash64("plain").alias("check"),
            F.length("plain").alias("n_plain"),
        )
    )


def merge_runs(runs: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """Merge runs (run, digest, check, n_plain, best, n) level by level into one."""
    while n_runs > 1:
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan))
            .groupBy("run", *KEY)
            .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        )
        n_runs = -(-n_runs // fan)
    return runs


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fan: int = FAN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when they agree after deleting blanks, tabs and line breaks (null counts as
    empty). The row with the most code points stays, then the smallest doc_id (null last); of
    rows repeated with the same doc_id exactly one is kept. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = stored(_rows(docs, text, doc_id), "digests")
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    # Bitwise NOT reverses the order of all integers; a null id sorts below every other.
    best = F.struct("n_points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row_id").alias("row"))
    leaves = rows.groupBy("run", *KEY).agg(F.max(best).alias("best"), F.count("*").alias("n"))
    kept = merge_runs(leaves, n_runs, fan).select(
        *KEY,
        F.bitwise_not("best.id").alias("keep_id"),
        F.bitwise_not("best.row").alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    return attach(rows, kept, *KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, one for each group of equal texts.

    Texts are exchanged once, by an identity made of digest, length and id; repeated rows share
    it and are folded where they meet.
    """
    kept = exact_groups(docs, text, doc_id).where("kept")
    ours = docs.withColumn(
        "__identity__",
        _identity(F.sha2(plain(F.col(text)), 256), F.length(F.coalesce(F.col(text), F.lit(""))), F.col(doc_id)),
    )
    theirs = kept.select(_identity(F.col("text_sha256"), F.col("n_points"), F.col("doc_id")).alias("__identity__"))
    return ours.join(theirs, "__identity__", "left_semi").dropDuplicates(["__identity__"]).drop("__identity__")


def _identity(digest: Column, points: Column, doc_id: Column) -> Column:
    return F.concat_ws("/", digest, points.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))


ORACLE = r"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM (
    SELECT doc_id, sha, count(*) OVER (PARTITION BY plain) AS group_size,
           first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id
    FROM (SELECT doc_id, plain, sha256(plain) AS sha, points FROM (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain,
               length(coalesce(text, '')) AS points FROM documents)))"""


def op8_exact_dedup(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return exact_groups(docs).drop("n_points")

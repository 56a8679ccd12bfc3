"""Readers for the delimited inputs: edits, revisions, user groups, truth, category data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelens.functions.validate import fields_of, split_fields

TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


_INTEGER = r"^[+-]?[0-9]{1,18}$"


def _edit_fault(parts: Column) -> Column:
    """Why the fields are no edit, or null."""
    return F.when(~F.size(parts).between(2, 4), "number of fields").when(
        F.exists(parts, lambda x: ~x.rlike(_INTEGER)), "not an integer"
    )


def parse_edits(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Edit lines ``user,article[,bytes[,n]]``, all integers.

    ``on_error="fail"`` raises when another line is read, ``"drop"`` leaves it to
    `malformed_edits`.
    """
    if on_error not in ("fail", "drop"):
        raise ValueError(f"on_error must be 'fail' or 'drop', not {on_error!r}")
    parts = fields_of(F.col("value"))
    good = _edit_fault(parts).isNull()
    if on_error == "drop":
        lines, checked = lines.where(good), parts
    else:
        # The check sits inside every field, so column pruning cannot optimise it away.
        checked = F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("Edits malformed: "), "value")))
    names = ["user_id", "article_id", "bytes", "n"]
    return lines.select([F.get(checked, F.lit(i)).cast("bigint").alias(name) for i, name in enumerate(names)])


def malformed_edits(lines: DataFrame) -> DataFrame:
    """Lines that are no edits, with the reason."""
    return lines.select("value", _edit_fault(fields_of(F.col("value"))).alias("reason")).where("reason IS NOT NULL")


def read_edits(spark: SparkSession, *paths: str, on_error: str = "fail") -> DataFrame:
    """Edit history: user and article first, then optionally bytes and edit count.

    Several files or folders are read as one table, which also concatenates part files.
    """
    return parse_edits(spark.read.text(list(paths)), on_error)


def parse_revisions(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Revision lines ``article,user,bytes,minor,timestamp``; unknown bytes count as 1."""
    fields = split_fields(
        lines, ["article", "user", "size", "flag", "time"], on_error, "Edits malformed"
    )
    return fields.select(
        F.col("article").cast("bigint").alias("article_id"),
        F.col("user").cast("bigint").alias("user_id"),
        F.when(F.col("size") == "null", F.lit(1)).otherwise(F.col("size").cast("bigint")).alias("bytes"),
        (F.lower("flag") == "true").alias("minor"),
        F.try_to_timestamp("time", F.lit(TIMESTAMP)).cast("timestamp_ntz").alias("ts"),
    )


def read_revisions(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return parse_revisions(spark.read.text(path), on_error)


def parse_user_groups(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Lines ``user,group``."""
    fields = split_fields(lines, ["u", "user_group"], on_error, "User groups malformed")
    return fields.select(F.col("u").cast("bigint").alias("user_id"), "user_group")


def read_user_groups(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return parse_user_groups(spark.read.text(path), on_error)


def parse_truth(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Ground truth lines ``user,article`` as a set of pairs."""
    return (
        split_fields(lines, ["u", "a"], on_error)
        .select(F.col("u").cast("bigint").alias("user_id"), F.col("a").cast("bigint").alias("article_id"))
        .distinct()
    )


def read_truth(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return parse_truth(spark.read.text(path), on_error)


def parse_category_tree(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Lines ``child,parent``."""
    return split_fields(lines, ["c", "p"], on_error).select(
        F.col("c").cast("bigint").alias("child"), F.col("p").cast("bigint").alias("parent")
    )


def parse_category_links(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Lines ``category,article``."""
    return split_fields(lines, ["c", "a"], on_error).select(
        F.col("c").cast("bigint").alias("category_id"), F.col("a").cast("bigint").alias("article_id")
    )


def read_category_tree(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return parse_category_tree(spark.read.text(path), on_error)


def read_category_links(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return parse_category_links(spark.read.text(path), on_error)

"""Reader for SQL dumps: ``INSERT INTO`` lines become rows of decoded fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strings are quoted with ' and escaped with \; a tuple ends at the first ) outside a string.
# The loops are unrolled, so a long string does not deepen the matcher's recursion.
STRING = r"'[^'\\]*(?:\\.[^'\\]*)*'"
TUPLE = rf"(?s)\([^)']*(?:{STRING}[^)']*)*\)"
FIELD = rf"(?s),([^,']*(?:{STRING}[^,']*)*)"
QUOTED = r"(?s)'([^'\\]*(?:\\.[^'\\]*)*)'"
COLUMN_LIST = r"^INSERT INTO [^(']*\([^()']*\)\s*VALUES"


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Raw lines in a given encoding (the text source always assumes UTF-8)."""
    return (
        spark.read.schema("value STRING")
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escape", "\u0002")
        .option("encoding", encoding)
        .csv(path)
    )


def _decode(field: Column) -> Column:
    """Drop the quotes of a string and take the character after each backslash literally."""
    text = F.regexp_replace(F.regexp_replace(field, QUOTED, "$1"), r"(?s)\\(.)", "$1")
    return F.when(field.contains("'"), text).otherwise(field)


def parse_tuples(lines: DataFrame) -> DataFrame:
    """One row per tuple with the array of its fields; other statements are skipped."""
    values = F.regexp_replace("value", COLUMN_LIST, "INSERT INTO")
    tuples = F.regexp_extract_all(values, F.lit(TUPLE), F.lit(0))

    def decoded(row: Column) -> Column:
        inner = F.concat(F.lit(","), F.substring(row, F.lit(2), F.length(row) - 2))
        return F.transform(F.regexp_extract_all(inner, F.lit(FIELD), F.lit(1)), _decode)

    # Decoding inside the generator: later filters on a field do not decode it again.
    return lines.where(F.col("value").startswith("INSERT INTO")).select(
        F.explode(F.transform(tuples, decoded)).alias("fields")
    )


def categories(lines: DataFrame) -> DataFrame:
    """Category dump: id and name."""
    return parse_tuples(lines).select(
        F.col("fields")[0].cast("bigint").alias("category_id"), F.col("fields")[1].alias("name")
    )


def category_links(lines: DataFrame) -> DataFrame:
    """Category-link dump: source page, target category name and kind of link."""
    return parse_tuples(lines).select(
        F.col("fields")[0].cast("bigint").alias("from_id"),
        F.col("fields")[1].alias("to_name"),
        F.col("fields")[6].alias("kind"),
    )

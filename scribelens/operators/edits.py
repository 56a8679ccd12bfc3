"""Edit history: cleaning, date split, aggregation, bags of articles and ratings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SPLIT = "01.01.2012"
BAG_WIDTH = 1024


def main_namespace(revisions: DataFrame) -> DataFrame:
    """Dated revisions of main-namespace pages by registered users."""
    return revisions.where("ts IS NOT NULL AND user_id <> 0 AND ns = 0")


def drop_bots_and_minor(revisions: DataFrame, user_groups: DataFrame) -> DataFrame:
    bots = user_groups.where(F.col("user_group") == "bot").select("user_id").distinct()
    return revisions.where("NOT minor").join(bots, "user_id", "left_anti")


def clean_revisions(revisions: DataFrame, user_groups: DataFrame) -> DataFrame:
    """Main-namespace edits by known users that are neither bots nor minor."""
    return drop_bots_and_minor(main_namespace(revisions), user_groups).select(
        "article_id", "user_id", F.coalesce("bytes", F.lit(1)).alias("bytes"), "ts"
    )


def with_split(revisions: DataFrame, threshold: str = DEFAULT_SPLIT) -> DataFrame:
    """``test`` from the given day (dd.MM.yyyy) on, ``training`` before it, in one pass."""
    day = F.lit(datetime.strptime(threshold, "%d.%m.%Y").isoformat(sep=" ")).cast("timestamp_ntz")
    return revisions.withColumn("split", F.when(F.col("ts") >= day, "test").otherwise("training"))


def aggregate_edits(revisions: DataFrame, *extra: str) -> DataFrame:
    """Bytes and edit count per user and article (and per ``extra`` column, such as split)."""
    return revisions.groupBy(*extra, "user_id", "article_id").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n")
    )


def count_edits(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("user_id", "article_id").agg(F.count("*").alias("n"))


def pairs(edits: DataFrame) -> DataFrame:
    """The bag of (user, article) edits; duplicates stay."""
    return edits.select("user_id", "article_id")


def bags(edits: DataFrame, width: int = BAG_WIDTH) -> DataFrame:
    """Bag of articles per user, cut into parts by article range.

    An entry holds an article and how often it occurs. A part covers ``width`` article ids, so
    its array has at most ``width`` entries even for a user who holds a third of all edits.
    """
    counted = count_edits(edits)
    return counted.groupBy(
        "user_id", F.floor(F.col("article_id") / width).cast("bigint").alias("part")
    ).agg(
        F.array_sort(F.collect_list(F.struct("article_id", "n"))).alias("articles"),
        F.sum("n").alias("n_edits"),
    )


def unbag(bagged: DataFrame) -> DataFrame:
    """Inverse of `bags`, one row per distinct pair with its multiplicity."""
    return bagged.select("user_id", F.explode("articles").alias("a")).select(
        "user_id", "a.article_id", "a.n"
    )


def articles(edits: DataFrame) -> DataFrame:
    return edits.select("article_id").distinct()


def users(edits: DataFrame) -> DataFrame:
    return edits.select("user_id").distinct()


def edits_of(edits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Articles of the wanted users; ``wanted`` has a column user_id."""
    return edits.join(wanted.select("user_id").distinct(), "user_id", "left_semi").select(
        "user_id", "article_id"
    )


def every_nth_user(edits: DataFrame, modulus: int) -> DataFrame:
    """Sub-sample of users by modulus, for exploration only."""
    return edits.where(F.pmod("user_id", F.lit(modulus)) == 0)


def ratings(aggregated: DataFrame) -> DataFrame:
    """Rating ``log2(bytes) + 1``; pairs without positive bytes carry no rating."""
    return aggregated.where("bytes > 0").select(
        "user_id", "article_id", (F.log2("bytes") + 1).alias("rating")
    )

"""User-based nearest-neighbour recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.functions.ranking import stable, top_k

NEIGHBOURS = 25
LENGTH = 1000
PART = 1024  # active users of an article in one row, about
EPSILON = 1e-8  # similarities are rounded to 9 digits
HOT = 4096  # edits of an article beyond which its pairs are formed only where they can matter


@dataclass(frozen=True)
class _Pairs:
    """Pairs of active user and other user that are formed, in the order in which they are.

    ``rare``: through articles that are not hot. ``opened``: through hot articles that must be
    read. ``completed``: what the other hot articles add to pairs already known.
    """

    rare: DataFrame
    opened: DataFrame | None = None
    completed: DataFrame | None = None

    def all(self) -> DataFrame:
        found = self.rare
        for more in (self.opened, self.completed):
            found = found if more is None else found.unionByName(more)
        return found


def _formed(unit: DataFrame, wanted: DataFrame, part: int) -> DataFrame:
    """(user_id, neighbour_id, similarity) parts of all pairs through the articles of ``wanted``.

    Every edit meets the active users of its article, held in rows of about ``part`` users.
    """
    parts = wanted.groupBy("article_id").agg(F.ceil(F.count("*") / part).alias("_parts"))
    per_article = (
        wanted.join(parts, "article_id")
        .withColumn("_part", F.pmod(F.xxhash64("user_id"), F.col("_parts")))
        .groupBy("article_id", "_part")
        .agg(F.collect_list(F.struct("user_id", "w")).alias("actives"))
    )
    return (
        unit.join(per_article, "article_id")
        .select(F.col("user_id").alias("neighbour_id"), "w", F.explode("actives").alias("a"))
        .where("a.user_id <> neighbour_id")
        .groupBy(F.col("a.user_id").alias("user_id"), "neighbour_id")
        .agg(F.sum(F.col("w") * F.col("a.w")).alias("similarity"))
    )


def _bars(pairs: DataFrame, k: int) -> DataFrame:
    """(user_id, bar): the k-th largest sum so far, which the k-th similarity is not below."""
    return top_k(pairs, ["user_id"], [F.desc("similarity"), F.col("neighbour_id")], k).where(F.col("rank") == k).select(
        "user_id", F.col("similarity").alias("bar")
    )


def _pairs(edits: DataFrame, active: DataFrame, k: int, part: int, hot: int) -> _Pairs:
    norms = edits.groupBy("user_id").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("_norm"))
    unit = edits.join(norms, "user_id").select(
        "user_id", "article_id", (F.col("rating") / F.col("_norm")).alias("w")
    )
    wanted = unit.join(active.select("user_id").distinct(), "user_id", "left_semi")
    sizes = edits.groupBy("article_id").agg(F.count("*").alias("_edits")).where(F.col("_edits") > hot)
    crowded = stored(sizes, "hot-articles")
    if crowded.isEmpty():
        return _Pairs(_formed(unit, wanted, part))
    unit = stored(unit, "units")
    wanted = stored(unit.join(active.select("user_id").distinct(), "user_id", "left_semi"), "active-units")
    cold = lambda df: df.join(crowded, "article_id", "left_anti")
    rare = stored(_formed(cold(unit), cold(wanted), part), "rare-pairs")
    # What an article can add is at most the user's weight times the largest of all users.
    warm = stored(unit.join(crowded, "article_id"), "hot-units")
    most = warm.groupBy("article_id").agg(F.max("w").alias("_most"))
    first = Window.partitionBy("user_id").orderBy(F.desc("_edits"), "article_id").rowsBetween(Window.unboundedPreceding, 0)
    held = (
        wanted.join(crowded, "article_id")
        .join(most, "article_id")
        .join(_bars(rare, k), "user_id", "left")
        .withColumn("_gain", F.col("w") * F.col("_most"))
        .withColumn("_sum", F.sum("_gain").over(first))
        .withColumn("closed", F.coalesce(F.col("_sum") < F.col("bar") - EPSILON, F.lit(False)))
    )
    held = stored(held.select("user_id", "article_id", "w", "_gain", "closed"), "hot-articles-of-users")
    opened = stored(_formed(warm.select("user_id", "article_id", "w"), held.where("NOT closed").select("user_id", "article_id", "w"), part), "hot-pairs")
    known = rare.unionByName(opened).groupBy("user_id", "neighbour_id").agg(F.sum("similarity").alias("similarity"))
    rest = held.where("closed").groupBy("user_id").agg(F.sum("_gain").alias("_rest"))
    near = (
        known.join(rest, "user_id")
        .join(_bars(known, k), "user_id")
        .where(F.col("similarity") + F.col("_rest") >= F.col("bar") - EPSILON)
        .select("user_id", "neighbour_id")
    )
    closed = held.where("closed").select("user_id", "article_id", F.col("w").alias("_own"))
    theirs = warm.select(F.col("user_id").alias("neighbour_id"), "article_id", "w")
    completed = (
        near.join(closed, "user_id")
        .join(theirs, ["neighbour_id", "article_id"])
        .select("user_id", "neighbour_id", (F.col("_own") * F.col("w")).alias("similarity"))
    )
    return _Pairs(rare, opened, completed)


def neighbours(
    edits: DataFrame, active: DataFrame, k: int = NEIGHBOURS, part: int = PART, hot: int = HOT
) -> DataFrame:
    """The ``k`` users with the largest cosine similarity for every active user, exactly.

    ``edits`` holds one row (user_id, article_id, rating) per pair. No pair of two inactive users
    is ever formed. Through articles of more than ``hot`` edits an active user meets others only
    if that can matter: pairs formed through all other articles give a bar, the k-th largest
    sum; the hottest articles that together cannot lift anyone above it stay closed, and only
    known pairs close enough to the bar get what those articles add.
    """
    pairs = _pairs(edits, active, k, part, hot).all()
    similarity = pairs.groupBy("user_id", "neighbour_id").agg(stable(F.sum("similarity")).alias("similarity"))
    return top_k(similarity, ["user_id"], [F.desc("similarity"), F.col("neighbour_id")], k)


def pairs_formed(edits: DataFrame, active: DataFrame, k: int = NEIGHBOURS, part: int = PART, hot: int = HOT) -> int:
    """How many pairs `neighbours` forms, counted once per way in which they are."""
    return _pairs(edits, active, k, part, hot).all().count()


def user_knn(
    edits: DataFrame, active: DataFrame, k: int = NEIGHBOURS, n: int = LENGTH
) -> DataFrame:
    """Unseen articles by the similarity-weighted mean rating of the nearest users."""
    near = neighbours(edits, active, k).drop("rank")
    totals = near.groupBy("user_id").agg(F.sum("similarity").alias("_total"))
    votes = (
        near.join(
            edits.select(F.col("user_id").alias("neighbour_id"), "article_id", "rating"),
            "neighbour_id",
        )
        .groupBy("user_id", "article_id")
        .agg(F.sum(F.col("similarity") * F.col("rating")).alias("_sum"))
    )
    seen = edits.select("user_id", "article_id")
    scored = (
        votes.join(seen, ["user_id", "article_id"], "left_anti")
        .join(totals, "user_id")
        .select("user_id", "article_id", stable(F.col("_sum") / F.col("_total")).alias("score"))
    )
    return top_k(scored, ["user_id"], [F.desc("score"), F.col("article_id")], n)


def hits(recommended: DataFrame, test: DataFrame) -> DataFrame:
    """How many recommended articles each user edits in the test data."""
    wanted = test.select("user_id", "article_id").distinct()
    found = recommended.join(wanted.withColumn("_hit", F.lit(1)), ["user_id", "article_id"], "left")
    return found.groupBy("user_id").agg(
        F.count("_hit").alias("n_hits"), F.count("*").alias("n_recommended")
    )

"""Weighted blend of several recommenders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.ranking import stable, top_k

DEFAULT_WEIGHT = 1.0
MISSING = 0.99
DEPTH = 3


def tagged(lists: Mapping[str, DataFrame]) -> DataFrame:
    """Recommendation tables as one table with their name in ``source``."""
    parts = [
        df.select(F.lit(name).alias("source"), "user_id", "article_id", "score")
        for name, df in lists.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _weight(weights: Mapping[str, float] | None) -> Column:
    expr = F.lit(DEFAULT_WEIGHT)
    for name, value in (weights or {}).items():
        expr = F.when(F.col("source") == name, F.lit(float(value))).otherwise(expr)
    return expr


def blend(lists: DataFrame, n: int = 10, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Sum of weight · score / best score over the sources of each user.

    ``lists`` is (source, user_id, article_id, score), at most one row per key. Each list is
    cut at ``3n``. An article a source does not list counts as 0.99 of that source's lowest
    score. Sources without a positive score for a user are left out.
    """
    cut = top_k(
        lists, ["source", "user_id"], [F.desc("score"), F.col("article_id")], DEPTH * n, "_rank"
    )
    # A user now has at most 3n rows per source, so one exchange by user carries the rest.
    per_list = Window.partitionBy("user_id", "source")
    per_user = Window.partitionBy("user_id")
    lowest = MISSING * F.col("_min")
    ranked = (
        cut.repartition("user_id")
        .withColumn("_min", F.min("score").over(per_list))
        .withColumn("_max", F.max("score").over(per_list))
        .where("_max > 0")
        .withColumn("_w", _weight(weights))
        # What a user's article scores if no source lists it, counted once per source.
        .withColumn(
            "_base", F.sum(F.when(F.col("_rank") == 1, lowest / F.col("_max") * F.col("_w"))).over(per_user)
        )
        .withColumn("_gain", (F.col("score") - lowest) / F.col("_max") * F.col("_w"))
    )
    scored = ranked.groupBy("user_id", "article_id").agg(
        stable(F.first("_base") + F.sum("_gain")).alias("score")
    )
    return top_k(scored, ["user_id"], [F.desc("score"), F.col("article_id")], n)

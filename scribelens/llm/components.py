"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelens.functions.layout import stored


def _hang(edges: DataFrame, centre_too: bool) -> DataFrame:
    """Hang the ends ``v`` of (u, v) on the smallest end of u; ``centre_too`` hangs u as well."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    if centre_too:
        moved = moved.unionByName(low.select("u", F.col("low").alias("v")))
    return moved.where("u <> v").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node hang on its smallest neighbour. Edges are (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    # The larger neighbours of v are the u of its edges (u > v).
    moved = edges.join(low.select(F.col("u").alias("v"), "low"), "v").select("u", F.col("low").alias("v"))
    return moved.where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, hang on the smallest of them."""
    fixed = _hang(edges, centre_too=True)
    return fixed.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v) that is not the smallest of its component.

    Ids are integers; edges with a null end are ignored. Each round is written to the shared
    folder, so a lost executor costs one round, and its number grows with the logarithm of the
    size of a component. Hubs meet one row per node in a join, which Spark splits when skewed.
    """
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        now = stored(small_star(large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

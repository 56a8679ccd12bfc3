"""Set-similarity join of articles by the weighted Jaccard index of their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import fan_out, stored

EPSILON = 1e-9
BANDS = 1000
SLOTS = 64
CELL_ROWS = 5000
FREQUENT = 64  # sets that may meet by one category


def article_sets(memberships: DataFrame) -> DataFrame:
    """Group articles with equal category sets: (article_id, set_id, n_articles).

    The fingerprint of a set is the xor of two hashes per category and the number of
    categories, so it is built by partial aggregation and never holds a set in memory. The id
    of a set is its smallest article.
    """
    prints = memberships.groupBy("article_id").agg(
        F.bit_xor(F.xxhash64("category_id")).alias("_x"),
        F.bit_xor(F.xxhash64("category_id", F.lit("second"))).alias("_y"),
        F.count("*").alias("_z"),
    )
    key = ["_x", "_y", "_z"]
    sets = prints.groupBy(*key).agg(
        F.min("article_id").alias("set_id"), F.count("*").alias("n_articles")
    )
    return prints.join(sets, key).select("article_id", "set_id", "n_articles")


def _slack(total):
    return F.lit(EPSILON) * (1 + total)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """Entries among which two similar sets have the first two that they share, in a common order.

    Rare categories come first: by weight band, then by hash slot (``place``). ``rest`` is the
    weight of a set from the entry's place on. The first shared entry has at least ``threshold``
    of the weight from its place on; the second, together with one entry before it. Places are at
    most ``BANDS * SLOTS`` per set, so the running sum stays small for a set of any size.
    """
    placed = sets.withColumn(
        "place",
        ((BANDS - F.floor(F.col("weight") * BANDS)) * SLOTS + F.pmod(F.xxhash64("category_id"), F.lit(SLOTS))).cast("int"),
    )
    every = Window.partitionBy("set_id")
    after = every.orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kept = (
        placed.groupBy("set_id", "place")
        .agg(F.sum("weight").alias("_w"), F.max("weight").alias("_m"))
        .withColumn("total", F.sum("_w").over(every))
        .withColumn("rest", F.sum("_w").over(after))
        .withColumn("_m", F.max("_m").over(every))
        .where(F.col("rest") + F.col("_m") >= threshold * F.col("total") - _slack(F.col("total")))
        .select("set_id", "place", "total", "rest")
    )
    return placed.join(kept, ["set_id", "place"]).select("set_id", "category_id", "place", "weight", "total", "rest")


def _keys(prefixes: DataFrame, threshold: float) -> DataFrame:
    """What sets must share a row of: (first, second, set_id, total, reach).

    Similar sets meet by the first category they share if few sets have it in their prefix, and
    else by the first and second: far fewer sets share two categories than a frequent one. Sets
    that share one frequent category only have ``threshold`` of their weight in it, and meet by
    it alone. ``reach`` is what sets can share at most if the key is where they first meet.
    """
    enough = threshold * F.col("total") - _slack(F.col("total"))
    first = prefixes.where(F.col("rest") >= enough)
    often = first.groupBy("category_id").agg((F.count("*") > FREQUENT).alias("_often"))
    first = first.join(often, "category_id")
    columns = ["first", "second", "set_id", "total", "reach"]
    alone = first.where(~F.col("_often") | (F.col("weight") >= enough)).select(
        F.col("category_id").alias("first"),
        F.col("category_id").alias("second"),
        "set_id",
        "total",
        F.when(F.col("_often"), F.col("weight")).otherwise(F.col("rest")).alias("reach"),
    )
    one = first.where("_often").select(
        "set_id", "total", F.col("category_id").alias("first"), F.col("place").alias("_place"), F.col("weight").alias("_w")
    )
    two = prefixes.select("set_id", F.col("category_id").alias("second"), "place", "rest")
    later = (F.col("place") > F.col("_place")) | ((F.col("place") == F.col("_place")) & (F.col("second") > F.col("first")))
    both = (
        one.join(two, "set_id")
        .where(later)
        .withColumn("reach", F.when(F.col("place") > F.col("_place"), F.col("_w")).otherwise(F.lit(0.0)) + F.col("rest"))
        .where(F.col("reach") >= enough)
    )
    return alone.select(*columns).unionByName(both.select(*columns))


def _candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a key and can share the weight that the threshold asks for.

    A key with many sets is laid out as a grid of cells of about ``CELL_ROWS`` by ``CELL_ROWS``
    sets, so no task receives a whole hot key.
    """
    keys = stored(_keys(prefixes, threshold), "keys")
    sides = keys.groupBy("first", "second").agg(
        F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_cells"), F.count("*").alias("_sets")
    )
    entries = keys.join(sides.where("_sets > 1"), ["first", "second"]).withColumn(
        "_own", F.pmod(F.xxhash64("set_id"), F.col("_cells")).cast("int")
    )
    across = F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    cell = ["first", "second", "_row", "_col"]
    a = entries.select(
        "first",
        "second",
        F.col("_own").alias("_row"),
        across.alias("_col"),
        F.col("set_id").alias("set_a"),
        F.col("total").alias("total_a"),
        F.col("reach").alias("reach_a"),
    )
    b = entries.select(
        "first",
        "second",
        across.alias("_row"),
        F.col("_own").alias("_col"),
        F.col("set_id").alias("set_b"),
        F.col("total").alias("total_b"),
        F.col("reach").alias("reach_b"),
    )
    similar_size = (F.col("total_a") >= threshold * F.col("total_b") - _slack(F.col("total_b"))) & (
        F.col("total_b") >= threshold * F.col("total_a") - _slack(F.col("total_a"))
    )
    both = F.col("total_a") + F.col("total_b")
    needed = threshold / (1 + threshold) * both - _slack(both)
    return (
        fan_out(a, *cell)
        .join(fan_out(b, *cell), cell)
        .where((F.col("set_a") < F.col("set_b")) & similar_size & (F.least("reach_a", "reach_b") >= needed))
        .select("set_a", "set_b")
        .distinct()
    )


def similar_sets(weighted: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """All pairs of sets with similarity of at least ``threshold``, exactly.

    ``weighted`` is (article_id, category_id, weight), ``members`` comes from `article_sets`.
    A pair (s, s) with similarity 1 stands for the articles of a set with several members.
    """
    heads = members.where("article_id = set_id")
    sets = (
        weighted.where("weight > 0")
        .join(heads.select("article_id"), "article_id", "left_semi")
        .withColumnRenamed("article_id", "set_id")
    )
    # Both inputs are read several times below.
    sets = stored(sets, "sets")
    pairs = _candidates(stored(_prefixes(sets, threshold), "prefixes"), threshold)
    totals = sets.groupBy("set_id").agg(F.sum("weight").alias("total"))
    shared = (
        pairs.join(
            sets.select(F.col("set_id").alias("set_a"), "category_id", "weight"), "set_a"
        )
        .join(sets.select(F.col("set_id").alias("set_b"), "category_id"), ["set_b", "category_id"])
        .groupBy("set_a", "set_b")
        .agg(F.sum("weight").alias("_common"))
        # No partner can have less weight than what is shared, so most pairs end here.
        .join(totals.select(F.col("set_id").alias("set_a"), F.col("total").alias("_a")), "set_a")
        .where(F.col("_common") >= threshold * F.col("_a") - EPSILON)
        .join(totals.select(F.col("set_id").alias("set_b"), F.col("total").alias("_b")), "set_b")
    )
    similarity = F.col("_common") / (F.col("_a") + F.col("_b") - F.col("_common"))
    different = shared.select("set_a", "set_b", similarity.alias("similarity")).where(
        F.col("similarity") >= threshold - EPSILON
    )
    copies = heads.where("n_articles > 1").select(
        F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b"), F.lit(1.0).alias("similarity")
    )
    return different.unionByName(copies)


def similar_articles(similar: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Similar articles of the wanted ones (column article_id), from the set level."""
    both = similar.union(similar.where("set_a <> set_b").select("set_b", "set_a", "similarity"))
    of_set = members.select(F.col("set_id").alias("set_b"), F.col("article_id").alias("similar_id"))
    return (
        wanted.join(members, "article_id")
        .join(both, F.col("set_id") == F.col("set_a"))
        .join(of_set, "set_b")
        .where("similar_id <> article_id")
        .select("article_id", "similar_id", "similarity")
    )

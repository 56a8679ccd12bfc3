"""Ground truth, per-user metrics and their summary."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.functions.ranking import rank_in_group

CUTOFFS = (100, 500, 1000)
AVERAGED = ("precision", "average_precision", "recall", "f_measure")
BINS = 1024  # of a histogram on the way to a median
BLOCK = 4096  # users of the running report in one group


def ground_truth(test: DataFrame, training: DataFrame) -> DataFrame:
    """New articles a known user edits, among the articles known from training.

    Pairs are made distinct first, so a popular article or busy user carries one row per pair
    before any join.
    """
    seen = training.select("user_id", "article_id").distinct()
    return (
        test.select("user_id", "article_id")
        .distinct()
        .join(seen, ["user_id", "article_id"], "left_anti")
        .join(seen.select("article_id").distinct(), "article_id", "left_semi")
        .join(seen.select("user_id").distinct(), "user_id", "left_semi")
        .select("user_id", "article_id")
    )


def sample_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.lit(str(seed))))


def sample_users(truth: DataFrame, num: int = 1000, seed: int = 1) -> DataFrame:
    """Exactly ``num`` users (or all, if fewer), the same for the same seed.

    ``position`` is the order in which the running report lists them.
    """
    chosen = (
        truth.select("user_id")
        .distinct()
        .withColumn("_key", sample_key(seed))
        .orderBy("_key", "user_id")
        .limit(num)
    )
    order = Window.orderBy("_key", "user_id")  # at most `num` rows
    return chosen.select("user_id", F.row_number().over(order).alias("position"))


def _hits_within(k: int) -> Column:
    return F.size(F.filter("_hits", lambda rank: rank <= k))


def user_metrics(
    recommended: DataFrame, truth: DataFrame, users: DataFrame, cutoffs: Sequence[int] = CUTOFFS
) -> DataFrame:
    """Precision, average precision, recall, recall at the cutoffs and F-measure per user.

    ``recommended`` is (user_id, article_id, rank) without duplicates. Users of ``users``
    without recommendations score zero. The only list built per user holds the ranks of the
    hits, which is no longer than the recommendation list itself.
    """
    wanted = users.select("user_id").distinct()
    none = F.lit(None).cast("int")
    rows = truth.select("user_id", "article_id", F.lit(1).alias("_true"), none.alias("_rank")).unionByName(
        recommended.select("user_id", "article_id", none.alias("_true"), F.col("rank").alias("_rank"))
    )
    per_pair = (
        rows.join(wanted, "user_id", "left_semi")
        .groupBy("user_id", "article_id")
        .agg(F.max("_true").alias("_true"), F.min("_rank").alias("_rank"))
    )
    hit = F.when(F.col("_true").isNotNull(), F.col("_rank"))
    per_user = (
        per_pair.groupBy("user_id")
        .agg(
            F.count("_rank").alias("n_recommended"),
            F.count("_true").alias("n_truth"),
            F.array_sort(F.collect_list(hit)).alias("_hits"),
        )
        .where("n_truth > 0")
    )
    n_hits = F.size("_hits")
    gains = F.aggregate(
        F.transform("_hits", lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x
    )
    # try_divide is NULL for an empty list or no hit.
    precision = F.coalesce(F.try_divide(n_hits, "n_recommended"), F.lit(0.0))
    recall = n_hits / F.col("n_truth")
    base = per_user.select(
        "user_id",
        "n_recommended",
        "n_truth",
        n_hits.cast("bigint").alias("n_hits"),
        precision.alias("precision"),
        F.coalesce(F.try_divide(gains, n_hits), F.lit(0.0)).alias("average_precision"),
        recall.alias("recall"),
        *[
            (_hits_within(k) / F.col("n_truth")).alias(f"recall_at_{k}")
            for k in cutoffs
        ],
    )
    f = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return base.withColumn("f_measure", F.coalesce(f, F.lit(0.0)))


def upper_median(name: str) -> Column:
    """Element n/2 (from 0) of the ascending values of a group, whose distinct values share one
    buffer; `upper_medians` has none."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def unpivoted(df: DataFrame, names: Sequence[str], *others: str) -> DataFrame:
    """Long form (others, name, value) of double columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in names]))
    return df.select(*others, pairs.alias("e")).select(*others, "e.name", "e.value")


def upper_medians(df: DataFrame, names: Sequence[str], bins: int = BINS) -> dict[str, float | None]:
    """Element n/2 (from 0) of the ascending values of each column, nulls left out; exact.

    A histogram of ``bins`` bins of equal width tells which bin holds the wanted rank; the next
    one covers just the values of that bin, and so on until they are few enough to fetch or all
    the same. A round is one scan with a partial sum for every column and bin, so no buffer and no
    result is larger than the bins. ``df`` is scanned once per round.
    """
    long = unpivoted(df, names).where("value IS NOT NULL")
    first = long.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    # Per column: values below the range, values in it, the range.
    open_ranges = {r["name"]: (0, r["n"], r["low"], r["high"], r["n"] // 2) for r in first.collect()}
    found: dict[str, float | None] = dict.fromkeys(names)
    while open_ranges:
        for m in [m for m, (_, _, low, high, _) in open_ranges.items() if low == high]:
            found[m] = open_ranges.pop(m)[2]
        few = {m: r for m, r in open_ranges.items() if r[1] <= bins}
        for m, values in _values(long, few).items():
            below, _, _, _, rank = open_ranges.pop(m)
            found[m] = sorted(values)[rank - below]
        if not open_ranges:
            break
        for m, counted in _histograms(long, open_ranges, bins).items():
            below, _, _, _, rank = open_ranges[m]
            for _, n, low, high in sorted(counted):
                if rank < below + n:
                    open_ranges[m] = (below, n, low, high, rank)
                    break
                below += n
    return found


def _inside(ranges: dict[str, tuple]) -> Column:
    within = F.lit(False)
    for m, (_, _, low, high, _) in ranges.items():
        within = within | ((F.col("name") == m) & F.col("value").between(low, high))
    return within


def _values(long: DataFrame, ranges: dict[str, tuple]) -> dict[str, list[float]]:
    """All values in the ranges, which hold at most as many as there are bins."""
    values: dict[str, list[float]] = {}
    for r in long.where(_inside(ranges)).collect() if ranges else []:
        values.setdefault(r["name"], []).append(r["value"])
    return values


def _histograms(long: DataFrame, ranges: dict[str, tuple], bins: int) -> dict[str, list[tuple]]:
    """Per column (bin, count, smallest, largest value) of the values in its range."""
    place = F.lit(None).cast("int")
    for m, (_, _, low, high, _) in ranges.items():
        # Halved, so that the width of the range is a number even for the largest doubles; between
        # the smallest ones there is none. The ends never share a bin, so every round narrows.
        width = high / 2 - low / 2
        share = (F.col("value") / 2 - low / 2) / width if width > 0 else (F.col("value") > low).cast("double")
        place = F.when(F.col("name") == m, F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))).otherwise(place)
    counted = (
        long.where(_inside(ranges))
        .groupBy("name", place.alias("bin"))
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    found: dict[str, list[tuple]] = {}
    for r in counted.collect():
        found.setdefault(r["name"], []).append((r["bin"], r["n"], r["low"], r["high"]))
    return found


def summary(metrics: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Means and upper medians over the users, and how many there were.

    The metrics are stored, as the medians scan them several times.
    """
    metrics = stored(metrics.select(*AVERAGED, *[f"recall_at_{k}" for k in cutoffs]), "metrics")
    medians = upper_medians(metrics, AVERAGED)
    return metrics.agg(
        F.count("*").alias("processed"),
        *[F.avg(m).alias(f"avg_{m}") for m in AVERAGED],
        *[F.avg(f"recall_at_{k}").alias(f"avg_recall_at_{k}") for k in cutoffs],
        *[F.lit(medians[m]).cast("double").alias(f"median_{m}") for m in AVERAGED],
    )


def running_report(
    metrics: DataFrame, sample: DataFrame, cutoffs: Sequence[int] = CUTOFFS, block: int = BLOCK
) -> DataFrame:
    """Means and upper medians after each user, in sample order, for samples of any size.

    The users are cut into blocks of consecutive positions, and each block is one group. Means:
    the sums of the blocks before it are handed to a block. Medians: see `running_medians`.
    """
    placed = metrics.join(sample, "user_id").where("position IS NOT NULL")
    averaged = [*AVERAGED, *[f"recall_at_{k}" for k in cutoffs]]
    rows = stored(placed.select("user_id", "position", *averaged), "placed")
    # Users without truth have no metrics: positions are numbered anew.
    n = rows.count()
    if n <= block:
        rows = rows.withColumn("processed", F.row_number().over(Window.orderBy("position")).cast("bigint"))
    else:
        rows = rank_in_group(rows.withColumn("_all", F.lit(0)), "_all", "position", "processed").drop("_all")
    block = max(block, isqrt(n))  # as many blocks as a block has users, at most
    rows = stored(rows.withColumn("_block", F.expr(f"(processed - 1) DIV {block}")), "blocks")
    sums = rows.groupBy("_block").agg(*[F.sum(m).alias(f"_{m}") for m in averaged])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    bases = sums.select("_block", *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0.0)).alias(f"_{m}") for m in averaged])
    inside = Window.partitionBy("_block").orderBy("processed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = rows.join(bases, "_block").select(
        F.col("processed").cast("bigint").alias("processed"),
        "user_id",
        *[((F.sum(m).over(inside) + F.col(f"_{m}")) / F.col("processed")).alias(f"avg_{m}") for m in averaged],
    )
    medians = running_medians(unpivoted(rows, AVERAGED, "processed"), block)
    wide = medians.groupBy("processed").pivot("name", list(AVERAGED)).agg(F.first("median"))
    return means.join(wide.select("processed", *[F.col(m).alias(f"median_{m}") for m in AVERAGED]), "processed")


def running_medians(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """(name, processed, median): the upper median of the values up to and with each place.

    ``values`` holds (name, processed, value), ``processed`` counting from 1 without gaps. Every
    value has a rank among all of its name, and ranks are cut into blocks like places. What is
    counted are the values per pair of blocks; running sums of these counts tell each block of
    places which ranks the medians of its places can have: they move by less than the block's own
    size. It is handed the earlier values with those ranks, at most about four blocks of them,
    how many lie below, and finds its medians in their sorted list. The work grows with the number
    of values, not with its square.
    """
    schema = "name string, processed bigint, median double"
    if values.where(F.col("processed") > block).isEmpty():  # one block, which needs nothing of others
        alone = values.select("name", "processed", "value", F.lit(None).cast("bigint").alias("_below"))
        return alone.groupBy("name").applyInPandas(_block_medians, schema)
    cut = lambda c: F.expr(f"({c} - 1) DIV {block}")
    ranked = rank_in_group(values, "name", ["value", "processed"], "_rank")
    at = stored(ranked.withColumns({"_block": cut("processed"), "_bucket": cut("_rank")}), "ranked")
    counts = at.groupBy("name", "_block", "_bucket").agg(F.count("*").alias("n"))
    blocks = at.select("name", "_block").distinct()
    # Values of a bucket before a block, for the blocks that come after some of them.
    before = Window.partitionBy("name", "_bucket").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    grid = blocks.join(at.select("name", "_bucket").distinct(), "name").join(counts, ["name", "_block", "_bucket"], "left")
    earlier = grid.withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    under = Window.partitionBy("name", "_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = earlier.withColumn("_upto", F.sum("n").over(under)).withColumn("_below", F.col("_upto") - F.col("n"))
    # The median's place from 0 in the earlier values alone, and how far it can move.
    half = F.expr(f"_block * {block} DIV 2")
    needed = reach.where((F.col("n") > 0) & (F.col("_upto") > half - block) & (F.col("_below") <= half + block))
    wanted = needed.select("name", F.col("_block").alias("_to"), "_bucket")
    below = needed.groupBy("name", F.col("_block").alias("_to")).agg(F.min("_below").alias("_below"))
    old = at.join(wanted, ["name", "_bucket"]).where("_block < _to").select("name", "_to", "value", F.lit(None).cast("bigint").alias("processed"))
    new = at.select("name", F.col("_block").alias("_to"), "value", F.col("processed").cast("bigint"))
    rows = new.unionByName(old).join(below, ["name", "_to"], "left")
    return rows.groupBy("name", "_to").applyInPandas(_block_medians, schema)


def _block_medians(rows: pd.DataFrame) -> pd.DataFrame:
    """Medians of a block's places from its values and those handed to it."""
    new = rows[rows["processed"].notna()].sort_values("processed")
    seen = np.sort(rows.loc[rows["processed"].isna(), "value"].to_numpy()).tolist()
    below = rows["_below"].iloc[0]
    below = 0 if pd.isna(below) else int(below)
    medians = []
    lowest = seen[0] if seen and below else -np.inf
    for place, value in zip(new["processed"].astype(int), new["value"]):
        # Smaller than all that were handed over: it joins those that are only counted.
        if value < lowest:
            below += 1
        else:
            insort(seen, value)
        medians.append(seen[place // 2 - below])
    return pd.DataFrame({"name": new["name"], "processed": new["processed"].astype("int64"), "median": medians})

"""Top-k and rank per group without putting a whole hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored

SALTS = 64
SCORE_DIGITS = 9


def stable(score: Column) -> Column:
    """Round a score so that ranks do not depend on the order of a floating-point sum."""
    return F.round(score, SCORE_DIGITS)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group, numbered from 1.

    Spark cuts every input partition to ``k`` rows per group before the shuffle, but only up
    to ``windowGroupLimitThreshold``. Beyond it the same cut is made here over salted groups,
    so at most ``SALTS * k`` rows of one group ever meet in a task.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_pre", F.row_number().over(inner))
            .where(F.col("_pre") <= k)
            .drop("_salt", "_pre")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def rank_in_group(df: DataFrame, key: str, number: str | Sequence[str], rank: str = "rank") -> DataFrame:
    """Rank of each row inside its group by distinct ``number`` (or columns), for groups of any size.

    Rows are range-sorted by group and number; a rank is the place in the sorted partition plus
    the group's rows in the partitions before it. What is summed over a group are its
    partitions, however sparse the numbers are.
    """
    numbers = [number] if isinstance(number, str) else list(number)
    ordered = df.repartitionByRange(key, *numbers).sortWithinPartitions(key, *numbers)
    at = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    # The upper bits of such an id are the partition, the lower 33 the place in it.
    at = at.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = at.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return (
        at.join(starts, [key, "_part"])
        .withColumn(rank, F.col("_place") + F.col("_base"))
        .drop("_at", "_part", "_place", "_base")
    )

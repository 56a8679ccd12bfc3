"""Helpers the operators share: small projections, salted joins, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored

RUNS = 4096
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_run(df: DataFrame) -> DataFrame:
    """Add the columns ``run`` (input partition, below `RUNS`) and ``row_id``.

    Both depend on how the input was split, so the result has to be stored before it is read
    twice.
    """
    return df.withColumns(
        {"run": F.pmod(F.spark_partition_id(), F.lit(RUNS)), "row_id": F.monotonically_increasing_id()}
    )


def attach(rows: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """Join ``values`` (one row per key, no nulls) to ``rows``, which have a column ``run``.

    The values meet first the distinct keys of each run, at most `RUNS` rows per key, and then
    the rows by run and key: a key that holds a third of all rows is spread over its runs.
    """
    known = rows.select("run", *keys).distinct().join(values, [*keys])
    return rows.join(known, ["run", *keys])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 1000) -> DataFrame:
    """Apply a function to slices of at most ``rows`` rows; ``make`` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield step(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Store ``rows`` (group never null) with ``pos``, the place from 0 in the group, and ``total``, its size.

    Rows are range-sorted by group and order, so a group of any size is spread over partitions; a
    place is the one inside the sorted partition plus the group's rows in the partitions before,
    which are as many numbers as partitions and groups.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33).alias("part")
    spans = placed.groupBy(part, group).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    own = Window.partitionBy(group)
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "part",
        group,
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(own).alias("total"),
    )
    found = placed.withColumn("part", part).join(spans, ["part", group])
    return found.select(*rows.columns, (F.col("place") + F.col("shift")).alias("pos"), "total")

"""How rows are laid out before and between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scribelens.session import shared_path


SMALL = 256 << 20


def spread(scan: DataFrame, small: int = SMALL) -> DataFrame:
    """Give a scan with fewer splits than cores to all cores, if it has at most ``small`` bytes.

    For CPU-bound work on small files that cannot be split; anything larger stays as it is,
    unshuffled. ``scan`` must be a plain read, which is not run by counting its splits; its size
    is that of its files.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size <= small and scan.rdd.getNumPartitions() < cores else scan


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several plans read, and read it back with its true size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by key ahead of a join that multiplies the rows.

    The number of partitions is given, so adaptive execution does not merge them by their size
    before the join.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """Write a table bucketed and sorted by ``keys`` below the shared folder, and read it back.

    Joins and groups by exactly these keys read it without an exchange, as long as ``buckets`` is
    not less than ``spark.sql.shuffle.partitions``. The table's entry in the session's catalog is
    dropped at once; its files stay like those of `stored`.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    entry = f"scribelens_{path.rsplit('-', 1)[1]}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(entry)
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return table


def bucket_count(spark, wanted: int = 1) -> int:
    """As many buckets as shuffle partitions at least, within what Spark takes."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))), most)

"""Departures kept by train, so that what follows a train through its stops needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS, ORDER = ("train",), ("departure", "station")
#: Rows of a bucket at most (about), if the trains are many: a task that sorts one takes some 100 MB.
BUCKET_ROWS = 1 << 19


def buckets_for(df: DataFrame, least: int = 8) -> int:
    """A number of buckets that grows with the rows, so that one of them stays small."""
    return max(least, -(-df.count() // BUCKET_ROWS))


def write_history(df: DataFrame, table: str, buckets: int = 64, path: str | None = None, keys=KEYS, order=ORDER) -> None:
    """A table of the catalog, bucketed by train and in order of time within each bucket's files.

    Removal of repeats (keys that begin with the train), `next_stop` and joins by train then read it without an exchange.
    Choose so many buckets that one of them fits the memory of a task (`buckets_for`). Rows come to their buckets in one shuffle, so a
    bucket is one file; `path` puts them outside the warehouse.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_history(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)

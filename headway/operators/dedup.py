"""Removal of the repeats that polling produces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPEAT_KEYS = ("train", "timestamp")


def complete_order(df: DataFrame, order_by) -> list[str]:
    """`order_by` and then all other columns, so that equal rows in it have one order on any partitioning."""
    return [*order_by, *(c for c in df.columns if c not in order_by)]


def dedup_departures(df: DataFrame, keys=REPEAT_KEYS, order_by=None) -> DataFrame:
    """One row per `keys`: the first in `order_by` and, among equals, by the remaining columns.

    Spark reduces each partition to one candidate per key before the shuffle (group
    limit below the window), so a key that is repeated without bound moves no more rows
    than there are partitions.
    """
    first = Window.partitionBy(*keys).orderBy(*complete_order(df, order_by or ()))
    return df.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") == 1).drop("_nth")


def distinct_stops(df: DataFrame) -> DataFrame:
    """Distinct stops; on a stream, those of each stop's first record."""
    stops = df.select("train", "station", "departure", "mode", "mission", "terminus")
    return stops.dropDuplicates() if df.isStreaming else stops.distinct()

"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.clock import epoch, instant, seconds_of


def realtime_only(df: DataFrame) -> DataFrame:
    """Departures announced in real-time mode."""
    return df.filter(F.col("mode") == "R")


def with_epoch(df: DataFrame) -> DataFrame:
    """`timestamp` replaced by `departure`, in epoch seconds."""
    return df.withColumn("departure", seconds_of("timestamp")).drop("timestamp")


def around(df: DataFrame, as_of=None, width_s: int = 3600) -> DataFrame:
    """Rows whose `departure` is at most half of `width_s` before or after `as_of`."""
    half = int(width_s / 2)
    return df.filter(F.col("departure").between(epoch(as_of) - half, epoch(as_of) + half))


def around_instant(df: DataFrame, as_of=None, width_s: int = 3600) -> DataFrame:
    """`around` on the `timestamp` column itself, so that the filter reaches the scan.

    `departure` is in whole seconds, hence the open upper bound one second later.
    """
    half = int(width_s / 2)
    second = F.date_trunc("second", instant(as_of))
    return df.filter(
        (F.col("timestamp") >= second - F.expr(f"interval {half} seconds"))
        & (F.col("timestamp") < second + F.expr(f"interval {half + 1} seconds"))
    )


def known_terminus(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Departures whose terminus is a registered station."""
    return df.join(stations.select(F.col("station").alias("terminus")), "terminus", "left_semi")


def in_progress(df: DataFrame, as_of=None) -> DataFrame:
    """Legs under way at `as_of`; both ends count as under way. Last stops are left out."""
    now = epoch(as_of)
    past = (now > F.col("departure")) & (now > F.col("next_departure"))
    future = (now < F.col("departure")) & (now < F.col("next_departure"))
    return df.filter(F.col("next_departure").isNotNull() & ~past & ~future)


def by_direction(df: DataFrame, way: int) -> DataFrame:
    """Published trains of one direction, +1 or -1."""
    return df.filter(F.col("direction") == way)


def line_track(rail: DataFrame, lines, track: str = "V1", line_col: str = "code_ligne",
               track_col: str = "nom_voie") -> DataFrame:
    """Rail segments of `lines` on one track."""
    return rail.filter(F.col(line_col).isin(*lines) & (F.col(track_col) == track))

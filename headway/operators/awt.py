"""Average waiting time (AWT): window length over number of trains, per station."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.clock import epoch, floor_to, seconds_of
from headway.functions.scalars import round_half_even

BLOCK_WINDOWS = 16  # windows' lengths per block of `trains_per_window`


def trains_per_window(
    df: DataFrame,
    keys=("station",),
    ts: str = "timestamp",
    window_minutes: int = 60,
    slide_minutes: int = 2,
    counted: str = "train",
    method: str = "panes",
) -> DataFrame:
    """Trains per `keys` in sliding windows: `keys, window(start, end), nt`.

    Windows are half-open and aligned to the epoch; `nt` counts non-NULL `counted`.
    `expand` is Spark's own sliding window, which copies each row into every window that
    holds it; it also runs on streams. `panes` first counts each row once, in the pane
    of the slide it falls in, and copies only the counts, so the copying no longer grows
    with the rows. The counts are first brought together by key and block of time (those at
    the start of a block also go to the block before, whose last windows reach into it),
    so the copies are added up where they are made and are not shuffled.
    """
    if method == "expand" or df.isStreaming:
        window = F.window(ts, f"{window_minutes} minutes", f"{slide_minutes} minutes")
        return df.groupBy(*keys, window).agg(F.count(counted).alias("nt"))
    if method != "panes":
        raise ValueError(f"unknown method {method!r}")
    length, slide = 60 * window_minutes, 60 * slide_minutes
    pane = gcd(length, slide)
    panes = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, floor_to(seconds_of(ts), pane).alias("_pane"))
        .agg(F.count(counted).alias("_n"))
    )
    slides = -(-length // slide)
    block = BLOCK_WINDOWS * slides * slide
    reached = (
        panes.withColumn("_last", floor_to(F.col("_pane"), slide))
        .withColumn("_first", F.col("_last") - slide * F.floor((F.col("_last") + length - F.col("_pane") - pane) / slide))
        .withColumn("_own", floor_to(F.col("_pane"), block))
    )
    own = F.col("_own")
    in_blocks = F.when(F.col("_pane") - own < length, F.array(own, own - block)).otherwise(F.array(own))
    blocks = reached.select(*keys, "_n", "_first", "_last", F.explode(in_blocks).alias("_block"))
    limited = (
        blocks.repartition(*keys, "_block")
        .withColumn("_from", F.greatest("_first", "_block"))
        .withColumn("_to", F.least(F.col("_last"), F.col("_block") + (block - slide)))
        .filter(F.col("_from") <= F.col("_to"))
    )
    steps = F.sequence("_from", "_to", F.lit(slide).cast("long"))
    starts = limited.select(*keys, "_block", "_n", F.explode(steps).alias("_start"))
    counts = starts.groupBy(*keys, "_block", "_start").agg(F.sum("_n").alias("nt"))
    return counts.select(*keys, _window(F.col("_start"), length).alias("window"), "nt")


def _window(start: Column, length: int) -> Column:
    return F.struct(
        F.timestamp_seconds(start).alias("start"), F.timestamp_seconds(start + F.lit(length)).alias("end")
    )


def with_awt(df: DataFrame, window_minutes: int = 60, decimals: int = 1) -> DataFrame:
    """`awt` in minutes, rounded half to even; NULL where no train was counted."""
    return df.withColumn("awt", round_half_even(F.try_divide(F.lit(float(window_minutes)), F.col("nt")), decimals))


def _last_start(as_of, window_minutes: int, slide_minutes: int, policy: str) -> Column:
    """Start of the window selected at `as_of`; NULL if the policy selects none."""
    length, slide = 60 * window_minutes, 60 * slide_minutes
    now = epoch(as_of)
    if policy == "latest":
        return floor_to(now - length, slide)
    if policy == "compat":
        start = floor_to(now - slide // 2 - length, slide)
        return F.when(start >= now - length - slide, start)
    raise ValueError(f"unknown policy {policy!r}")


def last_window(
    windows: DataFrame, as_of=None, window_minutes: int = 60, slide_minutes: int = 2, policy: str = "latest"
) -> DataFrame:
    """The last complete window at `as_of`.

    `latest` is the latest window that has ended. `compat` keeps windows that start at
    most one window and one slide ago and ended at least half a slide ago: that is one
    window in 61 of the 120 seconds of a two-minute slide, and none in the others.
    """
    start = _last_start(as_of, window_minutes, slide_minutes, policy)
    return windows.filter(F.col("window.start") == F.timestamp_seconds(start))


def last_window_counts(
    df: DataFrame,
    as_of=None,
    keys=("station",),
    ts: str = "timestamp",
    window_minutes: int = 60,
    slide_minutes: int = 2,
    policy: str = "latest",
    counted: str = "train",
) -> DataFrame:
    """`last_window(trains_per_window(df))`, computed from the rows of that window only.

    The bounds are constants for a given `as_of`, so they reach the scan as a filter.
    """
    start = _last_start(as_of, window_minutes, slide_minutes, policy)
    length = 60 * window_minutes
    inside = (F.col(ts) >= F.timestamp_seconds(start)) & (F.col(ts) < F.timestamp_seconds(start + F.lit(length)))
    counts = df.filter(inside).groupBy(*keys).agg(F.count(counted).alias("nt"))
    return counts.select(*keys, _window(start, length).alias("window"), "nt")


def ordered_awt(batch: DataFrame) -> DataFrame:
    """Stations by waiting time, shortest first; those without one come last."""
    return batch.select("station", "awt").orderBy(F.asc_nulls_last("awt"), "station")


def global_awt(batch: DataFrame) -> DataFrame:
    """Number of stations and the plain mean of their waiting times."""
    return batch.agg(F.count("station").alias("number_of_stations"), F.avg("awt").alias("global_awt"))


def min_awt(batch: DataFrame) -> DataFrame:
    """Station with the shortest waiting time, if any has one; the lowest code among equals."""
    return batch.orderBy(F.asc_nulls_last("awt"), "station").limit(1).select("station", F.col("awt").alias("min_awt"))


def max_awt(batch: DataFrame) -> DataFrame:
    """Station with the longest waiting time; the lowest code among equals."""
    return batch.orderBy(F.desc("awt"), "station").limit(1).select("station", F.col("awt").alias("max_awt"))


def awt_with_station(view: DataFrame, stations: DataFrame) -> DataFrame:
    """Waiting times with the label and the place of their stations."""
    return view.join(stations, "station", "inner")

"""Legs between two stops of a train, and the progress of the trains under way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.clock import clock_text, epoch
from headway.functions.scalars import between_points, direction, progress_percent, round_half_even
from headway.model import INBOUND_MISSIONS
from headway.operators.dims import with_station
from headway.operators.filters import in_progress

PROGRESS_COLUMNS = (
    "train", "departure", "arrival", "departure_uts", "arrival_uts", "mission",
    "from_st", "to_st", "from_st_lb", "to_st_lb", "time_to_st", "progress", "direction",
    "train_lt", "train_lg", "train_alt", "train_alg",
)


def next_stop(df: DataFrame, keys=("train",), order=("departure", "station"), span_s: int | None = None) -> DataFrame:
    """Adds `next_departure`, `next_station` and `time_to_st` to each stop of a train.

    Stops are ordered by `order`, which starts with `departure`. A train's stops meet in one
    task; that is bounded when the rows are unique stops of a short time range. For whole
    histories give `span_s`: then only the stops of one train within one span of that many
    seconds meet. The first and the last stop of each span, two rows per train and span,
    are linked across spans in a second step that reads the same shuffle. What follows is kept in columns of its own, so
    that those nobody asks for are left out of the shuffles.
    """
    def following(over) -> dict[str, Column]:
        return {f"next_{c}": F.lead(c).over(over) for c in ("departure", "station")}

    if span_s is None:
        return _with_leg(df, following(Window.partitionBy(*keys).orderBy(*order)))

    within = Window.partitionBy(*keys, "_span").orderBy(*order)
    spans = df.withColumn("_span", F.floor(F.col("departure") / span_s))
    placed = spans.withColumns({
        "_is_last": F.lead(F.lit(False), 1, True).over(within), "_is_first": F.lag(F.lit(False), 1, True).over(within),
    })
    across = Window.partitionBy(*keys).orderBy("_span", "_is_last")
    inside = _with_leg(placed, following(within)).filter(~F.col("_is_last"))
    linked = _with_leg(placed.filter(F.col("_is_last") | F.col("_is_first")), following(across)).filter("_is_last")
    return inside.unionByName(linked).drop("_span", "_is_first", "_is_last")


def _with_leg(df: DataFrame, following: dict[str, Column]) -> DataFrame:
    return df.withColumns(following).withColumn("time_to_st", F.col("next_departure") - F.col("departure"))


def with_progress(df: DataFrame, as_of=None) -> DataFrame:
    """Adds the unrounded `progress` of each leg, in percent."""
    return df.withColumn("progress", progress_percent(epoch(as_of), F.col("departure"), F.col("next_departure")))


def with_direction(df: DataFrame, inbound=INBOUND_MISSIONS) -> DataFrame:
    return df.withColumn("direction", direction(F.col("mission"), inbound))


def coarse_position(df: DataFrame) -> DataFrame:
    """Adds `train_lt, train_lg`: the point on the straight line between the two stations."""
    def at(axis: str) -> Column:
        return between_points(F.col(f"from_st_{axis}"), F.col(f"to_st_{axis}"), F.col("progress"))

    return df.withColumn("train_lt", at("lt")).withColumn("train_lg", at("lg"))


def trains_under_way(stops: DataFrame, stations: DataFrame, as_of=None, inbound=INBOUND_MISSIONS,
                     span_s: int | None = None, salts: int = 1) -> DataFrame:
    """Trains between two stops at `as_of`, with their position on the straight line.

    `stops` are distinct `(train, station, departure, mission)`. `progress` is rounded
    after the coarse position has been taken from it.
    """
    legs = in_progress(next_stop(stops, span_s=span_s), as_of)
    legs = with_direction(with_progress(legs, as_of), inbound)
    named = legs.select(
        "train",
        clock_text(F.col("departure")).alias("departure"),
        clock_text(F.col("next_departure")).alias("arrival"),
        F.col("departure").alias("departure_uts"),
        F.col("next_departure").alias("arrival_uts"),
        "mission",
        F.col("station").alias("from_st"),
        F.col("next_station").alias("to_st"),
        "time_to_st",
        "progress",
        "direction",
    )
    placed = with_station(with_station(named, stations, "from_st", salts), stations, "to_st", salts)
    return coarse_position(placed).withColumn("progress", round_half_even(F.col("progress"), 1))

"""Positions of trains along the track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.clock import epoch
from headway.functions.scalars import between_points, percent_elapsed
from headway.functions.spline import bends, with_curve, with_piece
from headway.operators.dims import attach


def fit_paths(paths: DataFrame) -> DataFrame:
    """Fits each path once: `(from_st, to_st, lat, lon, lat_bend, lon_bend)`, arrays by point.

    The fit is a vectorised map over rows; nothing is shuffled.
    """
    split = paths.select(
        "from_st", "to_st",
        F.col("points.lat").alias("lat"),
        F.col("points.lon").alias("lon"),
    )
    return split.select("*", bends("lat").alias("lat_bend"), bends("lon").alias("lon_bend"))


def fit_segments(fitted: DataFrame, ahead: bool = False) -> DataFrame:
    """The fitted curves as cubic pieces: `(from_st, to_st, seg, x0, width, a0..a3, b0..b3)`.

    From `x0` to `x0 + width`, latitude is `a0 + a1 d + a2 d^2 + a3 d^3` with
    `d = percent - x0`, and longitude the same with `b`. ahead: also `next_a0..next_a3, next_b0..next_b3`, the
    coefficients of the path's next piece (NULL at its last), and `last`, the number of its last piece: they are at hand
    where a piece is made, so that neighbours needn't be brought together again.
    """
    step = F.lit(100.0) / (F.size("lat") - 1)
    pieces = fitted.filter(F.size("lat") > 1).select(
        "from_st", "to_st", "lat", "lon", "lat_bend", "lon_bend", step.alias("h"),
        F.explode(F.sequence(F.lit(0), F.size("lat") - 2)).alias("seg"),
    )

    def coefficients(values: str, bent: str, letter: str, seg: Column):
        y0, y1 = F.get(values, seg), F.get(values, seg + 1)
        m0, m1 = F.get(bent, seg), F.get(bent, seg + 1)
        h = F.col("h")
        return [
            y0.alias(f"{letter}0"),
            ((y1 - y0 - (2.0 * m0 + m1) / 6.0) / h).alias(f"{letter}1"),
            (m0 / 2.0 / (h * h)).alias(f"{letter}2"),
            ((m1 - m0) / 6.0 / (h * h * h)).alias(f"{letter}3"),
        ]

    own, more = F.col("seg"), []
    if ahead:
        last = F.size("lat") - 2
        following = F.when(own < last, own + 1)
        more = [
            last.alias("last"), *coefficients("lat", "lat_bend", "next_a", following), *coefficients("lon", "lon_bend", "next_b", following),
        ]
    return pieces.select(
        "from_st", "to_st", "seg", (F.col("h") * own).alias("x0"), F.col("h").alias("width"),
        *coefficients("lat", "lat_bend", "a", own), *coefficients("lon", "lon_bend", "b", own), *more,
    )


def accurate_position(df: DataFrame, fitted: DataFrame, salts: int = 1) -> DataFrame:
    """Adds `train_alt, train_alg`: the point of the track at `progress`.

    A train that stands (`from_st = to_st`) is at its station. Legs without a known path
    keep their coarse position.
    """
    placed = with_piece(attach(df, fitted, ["from_st", "to_st"], "left", salts), "lat", F.col("progress"))
    for out, coarse, axis in (("train_alt", "train_lt", "lat"), ("train_alg", "train_lg", "lon")):
        placed = with_curve(placed, "_along", axis, f"{axis}_bend")
        standing = F.when(F.col("from_st") == F.col("to_st"), F.get(axis, F.lit(0)))
        placed = placed.withColumn(out, F.coalesce(standing, "_along", coarse)).drop("_along")
    return placed.select(*df.columns, "train_alt", "train_alg")


def with_position(df: DataFrame, fitted: DataFrame | None, accurate: bool = True, salts: int = 1) -> DataFrame:
    """`accurate_position`, or the coarse position in its place when switched off."""
    if accurate and fitted is not None:
        return accurate_position(df, fitted, salts)
    return df.withColumn("train_alt", F.col("train_lt")).withColumn("train_alg", F.col("train_lg"))


def _at(published: DataFrame, now, fitted: DataFrame, accurate: bool, salts: int) -> DataFrame:
    moving = published.withColumn("progress", percent_elapsed(now, F.col("departure_uts"), F.col("arrival_uts")))
    placed = with_piece(attach(moving, fitted, ["from_st", "to_st"], "left", salts), "lat", F.col("progress"))
    for out, axis in (("lat_at", "lat"), ("lon_at", "lon")):
        first, last = F.get(axis, F.lit(0)), F.get(axis, F.size(axis) - 1)
        if accurate:
            placed = with_curve(placed, "_along", axis, f"{axis}_bend")
            along = F.when(F.col("from_st") == F.col("to_st"), first).otherwise(F.col("_along"))
        else:
            along = between_points(first, last, F.col("progress"))
        coarse = "train_lt" if axis == "lat" else "train_lg"
        placed = placed.withColumn(out, F.coalesce(along, coarse) if coarse in published.columns else along)
    kept = [c for c in published.columns if c not in ("progress", "lat", "lon")]
    return placed.select(*kept, "progress", F.col("lat_at").alias("lat"), F.col("lon_at").alias("lon"))


def positions_at(published: DataFrame, as_of, fitted: DataFrame, accurate: bool = True, salts: int = 1) -> DataFrame:
    """Published trains with `progress, lat, lon` at another instant.

    Progress is not rounded. Before its departure a train is at the first point of its path
    and after its arrival at the last; the coarse line runs between these two points. A leg without a known path
    keeps its published coarse position, if `published` has it.
    """
    return _at(published, epoch(as_of), fitted, accurate, salts)


def positions_track(
    published: DataFrame, start, end, step_s: int, fitted: DataFrame, accurate: bool = True, salts: int = 1,
    under_way: bool = True,
) -> DataFrame:
    """`positions_at` for every `step_s` seconds from `start` to `end`, as column `at_uts`.

    A leg has rows for the instants between its departure and arrival; with `under_way=False` for all instants,
    also those at which it stands at either end.
    """
    first, last, step = epoch(start), epoch(end), F.lit(step_s).cast("long")
    if under_way:
        late = F.greatest(F.lit(0).cast("long"), F.col("departure_uts") - first)
        first = first + F.ceil(late / step).cast("long") * step
        last = F.least(last, F.col("arrival_uts"))
    ticks = F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last), step)))
    return _at(published.withColumn("at_uts", ticks), F.col("at_uts"), fitted, accurate, salts)

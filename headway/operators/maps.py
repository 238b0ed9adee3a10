"""Inputs of maps: layers, rail segments, station labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.scalars import short_label


def map_layers(trains: DataFrame, stations: DataFrame, rail: DataFrame | None = None) -> DataFrame:
    """Trains, stations and optionally rail stacked in one table, with a `layer` column.

    Same rows as a full outer join on a condition that never holds, without the join.
    """
    layers = trains.withColumn("layer", F.lit("train"))
    layers = layers.unionByName(stations.withColumn("layer", F.lit("station")), allowMissingColumns=True)
    if rail is not None:
        layers = layers.unionByName(rail.withColumn("layer", F.lit("rail")), allowMissingColumns=True)
    return layers


def segment_endpoints(rail: DataFrame, start=("lat1", "lon1"), end=("lat2", "lon2")) -> DataFrame:
    """Each rail segment as two rows, its start (`end_no` 0) and its end (1), in one scan."""
    ends = [
        F.struct(F.lit(n).alias("end_no"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        for n, (lat, lon) in enumerate((start, end))
    ]
    others = [c for c in rail.columns if c not in (*start, *end)]
    return rail.select(*others, F.explode(F.array(*ends)).alias("_e")).select(*others, "_e.*")


def distinct_points(rail: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The distinct points of the segments."""
    return rail.select(lat, lon).distinct()


def station_labels(stations: DataFrame) -> DataFrame:
    """Stations with `short_label` for the map."""
    return stations.withColumn("short_label", short_label(F.col("label")))

"""Joins of facts to reference tables, and upkeep of those tables.

No side is broadcast by hint. Spark broadcasts a reference table by its measured size
(`spark.sql.autoBroadcastJoinThreshold`, again at run time with adaptive execution) and
otherwise shuffles; `salts` spreads hot fact keys over several tasks in that case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(fact: DataFrame, dim: DataFrame, on, how: str = "left", salts: int = 1) -> DataFrame:
    """Equi-join of `fact` to `dim` on the columns `on`.

    With `salts` above 1 each fact row takes a salt from a hash of its own values and
    each dimension row is repeated once per salt, so the rows of one hot key are spread
    over that many tasks. The result is the same.
    """
    on = [on] if isinstance(on, str) else list(on)
    kept = fact.columns if how == "left_semi" else [*fact.columns, *[c for c in dim.columns if c not in on]]
    if salts <= 1:
        return fact.join(dim, on, how).select(*kept)
    if how not in ("left", "inner", "left_semi"):
        raise ValueError("salted joins keep or filter fact rows only")
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).select(*kept)


def with_station(df: DataFrame, stations: DataFrame, col: str, salts: int = 1) -> DataFrame:
    """Adds `{col}_lt, {col}_lg, {col}_lb`: place and label of the station in `col`."""
    dim = stations.select(
        F.col("station").alias(col),
        F.col("latitude").alias(f"{col}_lt"),
        F.col("longitude").alias(f"{col}_lg"),
        F.col("label").alias(f"{col}_lb"),
    )
    return attach(df, dim, col, "left", salts)


def line_stations(raw: DataFrame, line: str = "l") -> DataFrame:
    """Open-data stations served by `line`, without places yet."""
    return raw.filter(F.col(f"fields.{line}").isNotNull()).select(
        F.col("fields.code_uic").cast("int").alias("station"),
        F.col("fields.libelle_point_arret").alias("label"),
        F.lit(0.0).alias("latitude"),
        F.lit(0.0).alias("longitude"),
    )


def open_data_places(raw: DataFrame) -> DataFrame:
    """Open-data rows as `(station, latitude, longitude, seq)`."""
    return raw.select(
        F.col("fields.code_uic").try_cast("int").alias("station"),
        F.get("geometry.coordinates", F.lit(1)).alias("latitude"),
        F.get("geometry.coordinates", F.lit(0)).alias("longitude"),
        "seq",
    )


def with_coordinates(stations: DataFrame, places: DataFrame, order_by: str = "seq") -> DataFrame:
    """Stations with the place given last in `order_by`; unknown ones keep theirs."""
    complete = places.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    last = F.max(F.struct(order_by, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).alias("_last")
    latest = complete.groupBy("station").agg(last).select(
        "station", F.col("_last.lat").alias("_lat"), F.col("_last.lon").alias("_lon")
    )
    joined = stations.join(latest, "station", "left")
    return joined.select(
        "station",
        "label",
        F.coalesce("_lat", "latitude").alias("latitude"),
        F.coalesce("_lon", "longitude").alias("longitude"),
    )


def upsert(dim: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """`dim` with the rows of `patch` added, or put in place of those with the same key."""
    return dim.join(patch.select(key), key, "left_anti").unionByName(patch)


def inject(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Departures with further records added."""
    return df.unionByName(extra)

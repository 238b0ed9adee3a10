"""Positions along fitted paths as functions of SQL, inlined by Catalyst into the queries that call them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POINT = "STRUCT<lat: DOUBLE, lon: DOUBLE>"
_FIT = "STRUCT<lat: ARRAY<DOUBLE>, lon: ARRAY<DOUBLE>, lat_bend: ARRAY<DOUBLE>, lon_bend: ARRAY<DOUBLE>>"


def _axis(axis: str) -> str:
    """The curve of one coordinate at place `t` of piece `i` of the fit `f`; `j` is the piece's end."""
    y0, y1, m0, m1 = (f"get(f.{axis}{bend}, {at})" for bend in ("", "_bend") for at in ("i", "j"))
    return f"(1 - t) * {y0} + t * {y1} + ((power(1 - t, 3) - (1 - t)) * {m0} + (power(t, 3) - t) * {m1}) / 6"


def register_functions(spark: SparkSession, fitted: DataFrame, prefix: str = "") -> None:
    """Creates functions over a table of fitted paths, one row for each `(from_st, to_st)`:

    position_of(from_st, to_st, progress)   the point `(lat, lon)` at `progress` percent; NULL without a path, the first
                                            point where both stations are one
    track_of(from_st, to_st, step)          a table `(progress, lat, lon)` of the path's points every `step` percent

    The functions are the session's. They read the view `{prefix}fitted_paths`, which is made here.
    """
    view = f"{prefix}fitted_paths"
    fitted.createOrReplaceTempView(view)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}point_at(f {_FIT}, i INT, j INT, t DOUBLE) RETURNS {_POINT}
        RETURN named_struct('lat', {_axis("lat")}, 'lon', {_axis("lon")})
    """)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}piece_at(f {_FIT}, u DOUBLE) RETURNS {_POINT}
        RETURN {prefix}point_at(
          f, greatest(least(CAST(floor(u) AS INT), size(f.lat) - 2), 0), least(greatest(least(CAST(floor(u) AS INT), size(f.lat) - 2), 0) + 1, size(f.lat) - 1),
          u - greatest(least(CAST(floor(u) AS INT), size(f.lat) - 2), 0))
    """)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}curve_at(f {_FIT}, progress DOUBLE) RETURNS {_POINT}
        RETURN {prefix}piece_at(f, progress / 100 * (size(f.lat) - 1))
    """)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}position_of(a INT, b INT, progress DOUBLE) RETURNS {_POINT}
        RETURN {prefix}curve_at(
          (SELECT any_value(named_struct('lat', p.lat, 'lon', p.lon, 'lat_bend', p.lat_bend, 'lon_bend', p.lon_bend))
           FROM {view} p WHERE p.from_st = position_of.a AND p.to_st = position_of.b),
          CASE WHEN a = b THEN 0 ELSE progress END)
    """.replace("position_of.", f"{prefix}position_of."))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}track_of(a INT, b INT, step DOUBLE)
        RETURNS TABLE (progress DOUBLE, lat DOUBLE, lon DOUBLE)
        RETURN SELECT progress, point.lat, point.lon FROM (
          SELECT progress, {prefix}curve_at(named_struct('lat', lat, 'lon', lon, 'lat_bend', lat_bend, 'lon_bend', lon_bend), progress) AS point
          FROM (
            SELECT *, explode(transform(sequence(0, CAST(floor(100 / track_of.step) AS INT)), n -> n * track_of.step)) AS progress
            FROM {view} WHERE from_st = track_of.a AND to_st = track_of.b
          )
        )
    """.replace("track_of.", f"{prefix}track_of."))

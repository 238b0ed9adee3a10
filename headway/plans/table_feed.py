"""Star-schema tables as a departure feed, so that the operators can run on them.

`events` gives departures of few trains at many minutes, `lineitem` many trains with few
daily stops each, `supplier` the stations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def station_of_event() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def as_departures(events: DataFrame, *more: str) -> DataFrame:
    """Events as departures; `event_id` tells which record came first."""
    return events.select(
        station_of_event().alias("station"),
        F.col("user_id").cast("string").alias("train"),
        F.date_trunc("minute", F.col("ts")).cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "error", "T").otherwise("R").alias("mode"),
        F.col("event_type").alias("mission"),
        F.pmod(F.col("event_id"), F.lit(150)).cast("int").alias("terminus"),
        "event_id",
        *more,
    )


def event_departures(spark: SparkSession, folder: str, between: tuple[Column, Column] | None = None) -> DataFrame:
    """Departures from `events`, or those whose minute can be `between` two instants.

    A departure is at its minute's begin, so bounds on the minute become bounds on `ts`, which reach the scan.
    """
    events = table(spark, folder, "events")
    if between:
        start, end = between
        events = events.filter(
            (F.col("ts") >= start.cast("timestamp_ntz"))
            & (F.col("ts") < (end + F.expr("interval 1 minute")).cast("timestamp_ntz"))
        )
    return as_departures(events)


def line_departures(spark: SparkSession, folder: str) -> DataFrame:
    """Departures from `lineitem`: train = order, station = supplier, one stop per shipping day."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("station"),
        F.col("l_orderkey").cast("string").alias("train"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.lit("R").alias("mode"),
        F.col("l_linestatus").alias("mission"),
        F.col("l_partkey").alias("terminus"),
        "l_linenumber",
    )


def supplier_stations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("int").alias("station"),
        F.col("s_name").alias("label"),
        (F.lit(48.8) + F.col("s_suppkey") / F.lit(1000.0)).alias("latitude"),
        (F.lit(2.2) + F.col("s_suppkey") / F.lit(500.0)).alias("longitude"),
    )


def supplier_order(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as a binary tree: the parent of key k is k div 2, the branch code its digits."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.cast("int").alias("station"),
        F.when(key == 0, "0").otherwise(F.concat(F.lit("0"), F.bin(key))).alias("pos"),
        F.lit(0).alias("order"),
    )


def supplier_track(spark: SparkSession, folder: str) -> DataFrame:
    """Two track points between each supplier and its parent, at one and two thirds of the way up."""
    key = F.col("s_suppkey")
    edges = table(spark, folder, "supplier").filter(key > 0).select(
        F.floor(key / 2).cast("int").alias("depart"),
        key.cast("int").alias("arrivee"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("order_point"),
    )
    share = (F.col("order_point") + 1) / F.lit(3.0)
    at = F.col("depart") + share * (F.col("arrivee") - F.col("depart"))
    return edges.select(
        "depart", "arrivee", "order_point",
        (F.col("arrivee").cast("bigint") * 2 + F.col("order_point")).alias("idreseau"),
        (F.lit(2.2) + at / F.lit(500.0)).alias("longitude"),
        (F.lit(48.8) + at / F.lit(1000.0)).alias("latitude"),
    )


def comb_order(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as a comb: even keys on the main branch in order, odd ones on five branches that fork off in its middle.

    The parent of an even key is the one before it; odd keys below 10 hang on the even key before them, others on
    the key ten lower.
    """
    key, half = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 2)
    tooth = F.substring(F.lit("abcde"), (half % 5 + 1).cast("int"), F.lit(1))
    return table(spark, folder, "supplier").select(
        key.cast("int").alias("station"),
        F.when(key % 2 == 0, "0").otherwise(F.concat(F.lit("0"), tooth)).alias("pos"),
        F.when(key % 2 == 0, half).otherwise(F.floor(half / 5)).cast("int").alias("order"),
    )


def comb_track(spark: SparkSession, folder: str) -> DataFrame:
    """A track point half way between each supplier of the comb and its parent, without a number of its own."""
    key = F.col("s_suppkey")
    parent = F.when(key % 2 == 0, key - 2).when(key < 10, key - 1).otherwise(key - 10)
    middle = (key + parent) / F.lit(2.0)
    return table(spark, folder, "supplier").filter(key > 0).select(
        parent.cast("int").alias("depart"), key.cast("int").alias("arrivee"), F.lit(0).alias("order_point"),
        F.lit(None).cast("bigint").alias("idreseau"),
        (F.lit(2.2) + middle / F.lit(500.0)).alias("longitude"), (F.lit(48.8) + middle / F.lit(1000.0)).alias("latitude"),
    )


def straight_paths(pairs: DataFrame, stations: DataFrame) -> DataFrame:
    """Paths of two points, the stations themselves, for the distinct `(from_st, to_st)`."""
    def end(col: str, name: str) -> DataFrame:
        return stations.select(
            F.col("station").alias(col), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias(name)
        )

    ends = pairs.select("from_st", "to_st").distinct().join(end("from_st", "a"), "from_st").join(end("to_st", "b"), "to_st")
    return ends.select("from_st", "to_st", F.array("a", "b").alias("points"), F.lit(2).alias("number_step"))


def parents_of_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.cast("int").alias("station"), F.when(key > 0, F.floor(key / 2)).cast("int").alias("parent")
    )


def event_boards(spark: SparkSession, folder: str) -> DataFrame:
    """A departure board per event: its train, and except for views a second one five minutes later."""
    minute = F.date_trunc("minute", F.col("ts"))

    def train(number: Column, ts: Column) -> Column:
        return F.concat(
            F.lit('<train><date mode="R">'), F.date_format(ts, "dd/MM/yyyy HH:mm"), F.lit("</date><num>"),
            number.cast("string"), F.lit("</num><miss>"), F.upper("event_type"), F.lit("</miss><term>"),
            F.pmod(F.col("event_id"), F.lit(150)).cast("string"), F.lit("</term></train>"),
        )

    second = train(F.col("user_id") + 1, minute + F.expr("interval 5 minutes"))
    body = F.concat(
        train(F.col("user_id"), minute), F.when(F.col("event_type") == "view", "").otherwise(second)
    )
    return table(spark, folder, "events").select(
        "event_id",
        station_of_event().alias("station"),
        F.concat(F.lit("<passages>"), body, F.lit("</passages>")).alias("xml"),
    )


def lineitem_rail(spark: SparkSession, folder: str) -> DataFrame:
    """Rail segments from `lineitem`: line = return flag, track by line number."""
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("code_ligne"),
        F.concat(F.lit("V"), F.col("l_linenumber").cast("string")).alias("nom_voie"),
        (F.lit(48.0) + F.col("l_suppkey") / F.lit(1000.0)).alias("lat1"),
        (F.lit(2.0) + F.col("l_partkey") / F.lit(100000.0)).alias("lon1"),
        (F.lit(48.0) + F.col("l_quantity") / F.lit(1000.0)).alias("lat2"),
        (F.lit(2.0) + F.col("l_discount")).alias("lon2"),
    )

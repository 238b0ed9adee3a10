"""Departure boards: one XML document per station, with a list of trains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.clock import board_timestamp
from headway.model import BOARD


def parse_boards(df: DataFrame, xml_col: str = "xml", station_col: str = "station", bad: str = "fail",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One departure per `<train>` of each board.

    Boards with one train work like any other, and those without trains give no row. bad: a board that cannot be
    read ends the query with `fail`, gives no row with `drop`, one row of NULLs beside its station with `keep`, and with
    `quarantine` such a row with its text as `bad_value` (NULL on the others).
    """
    if bad not in ("fail", "drop", "keep", "quarantine"):
        raise ValueError(f"unknown bad-record policy {bad!r}")
    whole = T.StructType([*BOARD.fields, T.StructField("_bad", T.StringType())])
    # As a generator's output, so that the board is read once for all that is taken from it.
    parsed = df.select(
        F.col(station_col).cast("int").alias("station"), *keep, F.col(xml_col).alias("_xml"),
        F.explode(F.array(F.from_xml(F.col(xml_col), whole, {"columnNameOfCorruptRecord": "_bad"}))).alias("_board"),
    )
    broken, trains_type = F.col("_board").isNull() | F.col("_board._bad").isNotNull(), BOARD["train"].dataType
    trains = F.coalesce("_board.train", F.array().cast(trains_type))
    if bad == "fail":
        told = F.raise_error(F.concat(F.lit("unreadable board: "), F.coalesce(F.substring("_xml", 1, 200), F.lit("no text"))))
        listed = F.explode(F.when(broken, told.cast(trains_type)).otherwise(trains))
    elif bad == "drop":
        listed = F.explode(F.when(~broken, trains))
    else:
        nothing = F.array(F.lit(None).cast(trains_type.elementType))
        listed = F.explode(F.when(broken, nothing).otherwise(trains))
    more = [F.when(broken, F.coalesce("_xml", F.lit(""))).alias("bad_value")] if bad == "quarantine" else []
    return parsed.select("station", *keep, *more, listed.alias("_t")).select(
        "station",
        F.col("_t.num").alias("train"),
        board_timestamp(F.col("_t.date._VALUE")).alias("timestamp"),
        F.col("_t.date._mode").alias("mode"),
        F.col("_t.miss").alias("mission"),
        F.col("_t.term").try_cast("int").alias("terminus"),
        *keep, *(["bad_value"] if more else []),
    )


def read_boards(spark: SparkSession, path: str, streaming: bool = False, wholetext: bool = False, **options) -> DataFrame:
    """Boards `(station, xml, ingest_ts)` kept below `path` in a folder `station=<code>` each, as they were polled.

    A file holds a board per line or, with `wholetext`, one board. As a stream, files come once each, in the order of their
    times, `maxFilesPerTrigger` of them in a batch; what has been read is kept with the query's checkpoint.
    """
    reader = (spark.readStream if streaming else spark.read).schema("value string, station int").options(**options)
    raw = reader.text(path, wholetext=wholetext)
    return raw.select("station", F.col("value").alias("xml"), F.col("_metadata.file_modification_time").alias("ingest_ts"))

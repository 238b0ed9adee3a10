"""Departure messages: stream sources, JSON decoding and message sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.clock import message_text, message_timestamp
from headway.model import DEPARTURE, DEPARTURE_MESSAGE, TIMESTAMP_FORMATS


def kafka_options(servers: str, topic: str, starting: str = "earliest", **extra: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        **extra,
    }


def departures_stream(spark: SparkSession, source: str, **options) -> DataFrame:
    """A stream of raw messages `(value, ingest_ts, ...)`.

    source: `kafka` (options of `kafka_options`; needs the Kafka connector on the class
    path), `files` (`path`: folder of JSON-lines files) or `rate` (ticks, for smoke runs).
    """
    if source == "kafka":
        reader = spark.readStream.format("kafka").options(**kafka_options(**options))
        return reader.load().withColumnRenamed("timestamp", "ingest_ts")
    if source == "files":
        path = options.pop("path")
        raw = spark.readStream.options(**options).text(path)
        return raw.select("value", F.col("_metadata.file_modification_time").alias("ingest_ts"))
    if source == "rate":
        raw = spark.readStream.format("rate").options(**options).load()
        return raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts"))
    raise ValueError(f"unknown source {source!r}")


def decode_departures(
    df: DataFrame,
    schema: T.StructType = DEPARTURE_MESSAGE,
    formats=TIMESTAMP_FORMATS,
    bad: str = "null",
    value: str = "value",
    keep: tuple[str, ...] = (),
    required: tuple[str, ...] = ("station", "train", "timestamp"),
) -> DataFrame:
    """JSON messages to departures, with the `keep` columns of the envelope.

    bad: what happens to messages that can't be read, have a field of another type, or lack one of
    `required`: `null` keeps them as they are decoded, `drop` removes them, `quarantine` adds their text as
    `bad_value` (NULL on good rows; empty for a message that is NULL), so that one pass can be split in two.
    """
    text = F.col(value).cast("string")
    if bad == "null":
        parsed = F.from_json(text, schema)
    else:
        whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
        parsed = F.from_json(text, whole, {"columnNameOfCorruptRecord": "_bad"})
    flat = df.select(text.alias("_text"), parsed.alias("_d"), *keep)
    fields = [
        (message_timestamp(F.col("_d.timestamp"), formats) if f.name == "timestamp" else F.col(f"_d.{f.name}"))
        .alias(f.name)
        for f in schema
    ]
    if bad == "null":
        return flat.select(*fields, *keep)
    rows = flat.select(*fields, *keep, "_text", F.col("_d._bad").alias("_bad"))
    broken = F.col("_bad").isNotNull()
    for name in required:
        broken = broken | F.col(name).isNull()
    if bad == "drop":
        return rows.filter(~broken).drop("_text", "_bad")
    if bad == "quarantine":
        return rows.withColumn("bad_value", F.when(broken, F.coalesce("_text", F.lit("")))).drop("_text", "_bad")
    raise ValueError(f"unknown bad-record policy {bad!r}")


def decode_variant(
    df: DataFrame, schema: T.StructType = DEPARTURE_MESSAGE, formats=TIMESTAMP_FORMATS, value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """JSON messages whose fields change over time, to departures and what doesn't fit them.

    Each field is read by itself, so a field of another type costs that field and not the record: it is NULL, and its
    name is in the array `drifted`, unless its value can be cast, as a number in quotes can. `more` maps fields that
    the schema doesn't have, nested ones among them, to their JSON. A message that isn't JSON, or no object, is NULL in
    all columns.
    """
    text = F.col(value).cast("string")
    parsed = df.select(
        text.alias("_text"), F.try_parse_json(text).alias("_v"), F.from_json(text, "map<string,string>").alias("_all"), *keep
    )
    known = [f.name for f in schema]
    fields, lost = [], []
    for f in schema:
        kept = F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString())
        kept = message_timestamp(kept, formats) if f.name == "timestamp" else kept
        fields.append(kept.alias(f.name))
        lost.append(F.when(F.get_json_object("_text", f"$.{f.name}").isNotNull() & kept.isNull(), F.lit(f.name)))
    more = F.map_filter("_all", lambda name, _: ~name.isin(*known))
    return parsed.select(*fields, F.array_compact(F.array(*lost)).alias("drifted"), more.alias("more"), *keep)


def split_quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good departures, and the texts of the bad messages."""
    bad = F.col("bad_value").isNotNull()
    return decoded.filter(~bad).drop("bad_value"), decoded.filter(bad).select("bad_value")


def encode_departures(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Departures as JSON messages `(value)`, with the `keep` columns beside them."""
    def field(name: str) -> Column:
        return message_text(F.col(name)).alias(name) if name == "timestamp" else F.col(name)

    return df.select(F.to_json(F.struct(*[field(f.name) for f in DEPARTURE])).alias("value"), *keep)


def write_departures(df: DataFrame, sink: str, checkpoint: str | None = None, **options):
    """One JSON message per departure to `kafka` or to `files` (folder of text files).

    A streaming frame starts a query that needs `checkpoint` and is returned; a batch
    frame is written at once. `acks` and the like go through as `kafka.*` options.
    """
    messages = encode_departures(df)
    target = {"kafka": "kafka", "files": "text"}[sink]
    if df.isStreaming:
        writer = messages.writeStream.format(target).options(**options).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").start()
    messages.write.format(target).options(**options).mode("append").save()
    return None


def with_volume_metric(df: DataFrame, name) -> DataFrame:
    """Counts the rows that pass, as metric `rows` of the observation or listener `name`."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))

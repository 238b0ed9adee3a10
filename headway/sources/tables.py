"""Reference tables: stations, their order, track points, paths, open data; and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.model import KEYED_PATH, OPEN_DATA, STATION, STATION_ORDER, TRACK_POINT


def read_stations(spark: SparkSession, path: str, ordered: bool = False, view: str | None = None) -> DataFrame:
    """Station table with header; `ordered` sorts by code, `view` registers it by name."""
    df = spark.read.schema(STATION).csv(path, header=True)
    if ordered:
        df = df.orderBy("station")
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_station_order(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATION_ORDER).csv(path, header=True)


def read_track_points(spark: SparkSession, path: str) -> DataFrame:
    """Track points by position; header names and byte-order marks are ignored."""
    return spark.read.schema(TRACK_POINT).csv(path, header=True, enforceSchema=True)


def read_open_data(spark: SparkSession, path: str) -> DataFrame:
    """Open-data JSON arrays; `file` and `seq` keep the order of each file.

    An array is read by one task, as it can't be split; large data should come as several files.
    """
    raw = spark.read.schema(OPEN_DATA).json(path, multiLine=True)
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))


def read_keyed_json(
    spark: SparkSession, path: str, value_schema: T.StructType, lines: bool = True, bad: str = "fail"
) -> DataFrame:
    """JSON objects `{key: {...}}` as rows `(key, fields...)`.

    A file holds one object per line, which Spark can split, or with `lines=False` one object, read by one task.
    bad: an object that can't be read ends the query with `fail`, is left out with `drop`, and gives a row of NULLs
    with its text as `bad_value` with `quarantine` (NULL on good rows). Blank lines are skipped.
    """
    text = spark.read.text(path, wholetext=not lines).filter(F.trim("value") != "")
    objects = text.select("value", F.from_json("value", T.MapType(T.StringType(), value_schema)).alias("entries"))
    if bad == "fail":
        told = F.raise_error(F.concat(F.lit("unreadable keyed JSON: "), F.substring("value", 1, 200)))
        entries = F.coalesce("entries", told.cast(objects.schema["entries"].dataType))
        return objects.select(F.explode(entries).alias("key", "entry")).select("key", "entry.*")
    if bad == "drop":
        return objects.select(F.explode("entries").alias("key", "entry")).select("key", "entry.*")
    if bad == "quarantine":
        text = F.when(F.col("entries").isNull(), F.col("value")).alias("bad_value")
        kept = objects.filter("entries IS NULL OR size(entries) > 0")
        return kept.select(text, F.explode_outer("entries").alias("key", "entry")).select("key", "entry.*", "bad_value")
    raise ValueError(f"unknown bad-record policy {bad!r}")


def read_keyed_paths(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """A path file keyed by `from-to` as a path table."""
    raw = read_keyed_json(spark, path, KEYED_PATH, lines)
    ends = F.split("key", "-")
    return raw.select(
        F.element_at(ends, 1).cast("int").alias("from_st"),
        F.element_at(ends, 2).cast("int").alias("to_st"),
        F.transform(
            "geoPoints",
            lambda p: F.struct(p["latitude"].cast("double").alias("lat"), p["longitude"].cast("double").alias("lon")),
        ).alias("points"),
        "number_step",
    )


def write_reference(df: DataFrame, path: str, fmt: str = "parquet", key: str | None = None) -> None:
    """A reference table as `parquet`, `json`, `csv` (with header) or `keyed_json`.

    `keyed_json` writes one object `{key: {other columns}}` per line.
    """
    if fmt == "keyed_json":
        others = F.struct(*[c for c in df.columns if c != key])
        df = df.select(F.to_json(F.create_map(F.col(key).cast("string"), others)).alias("value"))
        df.write.mode("overwrite").text(path)
    elif fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def read_locale_csv(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ";", decimal_comma: tuple[str, ...] = (),
    ranges: dict[str, tuple[float, float]] | None = None, bad: str = "fail",
) -> DataFrame:
    """CSV with padded fields, byte-order marks, carriage returns and decimal commas.

    The `decimal_comma` columns have a comma as decimal sign. If the field separator is a comma too and values are not
    quoted, each of them takes one field of the row, if it is a whole number, or two. `aligned` finds which;
    `ranges` are the values that a column can have. bad: a row whose fields don't fit the schema in just one way ends the
    query with an error (`fail`), gives NULLs (`null`), or NULLs and its text as `bad_value`, NULL on good rows
    (`quarantine`).
    """
    if bad not in ("fail", "null", "quarantine"):
        raise ValueError(f"unknown bad-record policy {bad!r}")
    split = [f.name for f in schema if f.name in decimal_comma] if sep == "," else []
    if split:
        # Whole lines, without the header; cut at commas that an even number of quotes follows.
        lines = spark.read.schema("line string").csv(path, header=True, sep="\u0001", quote="", enforceSchema=True)
        cut = F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        fields = F.transform(cut, lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$|\r', "")))
        return aligned(lines.select(fields.alias("fields")), schema, split, ranges or {}, bad)
    raw_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(raw_schema).csv(
        path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True
    )

    def field(f: T.StructField):
        text = F.replace(F.trim(f.name), F.lit(","), F.lit(".")) if f.name in decimal_comma else F.trim(f.name)
        return text.try_cast(f.dataType).alias(f.name)

    return raw.select(*[field(f) for f in schema])


def aligned(rows: DataFrame, schema: T.StructType, decimals: list[str], ranges: dict[str, tuple[float, float]], bad: str) -> DataFrame:
    """Rows of an array `fields` of texts as the columns of a schema, `decimals` of which take one field or two.

    From the last column to the first, for each number of fields that the columns before may have taken besides
    their own, the ways are counted in which the rest of the fields fits the rest of the columns. Just one way in
    all gives the values; each column is a projection of its own, so the work is their number times the decimals'.
    """
    n, most = len(schema), len(decimals)

    def at(i: int, more):
        return F.get("fields", F.lit(i) + more)

    def value(i: int, more, whole: bool):
        """What a column is, if it starts `more` fields late; NULL if that is none of its type and range."""
        f = schema[i]
        if f.name not in decimals:
            return at(i, more).try_cast(f.dataType)
        number = F.regexp_extract(at(i, more), r"^[+-]?\d+$", 0)
        text = number if whole else F.concat(number, F.lit("."), F.regexp_extract(at(i + 1, more), r"^\d+$", 0))
        fits = number != "" if whole else (number != "") & F.rlike(at(i + 1, more), F.lit(r"^\d+$"))
        found = F.when(fits, text.try_cast(f.dataType))
        low, high = ranges.get(f.name, (None, None))
        return found if low is None else F.when(found.between(low, high), found)

    def fits(i: int, more, whole: bool = True):
        f, there = schema[i], at(i, more).isNotNull()
        if f.name in decimals:
            return value(i, more, whole).isNotNull()
        return there & ((at(i, more) == "") | value(i, more, whole).isNotNull())

    ways = rows.withColumn(f"_w{n}", F.transform(F.sequence(F.lit(0), F.lit(most)), lambda e: (F.size("fields") == n + e).cast("int")))

    def counted(i: int):
        after = f"_w{i + 1}"

        def count(e):
            one = F.when(fits(i, e), F.get(after, e)).otherwise(0)
            if schema[i].name not in decimals:
                return one
            return one + F.when((e < most) & fits(i, e, False), F.coalesce(F.get(after, e + 1), F.lit(0))).otherwise(0)

        return F.transform(F.sequence(F.lit(0), F.lit(most)), count)

    for i in reversed(range(n)):
        ways = ways.withColumn(f"_w{i}", counted(i))
    placed = ways.withColumn("_e0", F.lit(0)).withColumn("_one", F.get("_w0", F.lit(0)) == 1)
    for i in range(n):
        more = F.col(f"_e{i}")
        two = F.lit(False)
        if schema[i].name in decimals:
            two = fits(i, more, False) & (F.coalesce(F.get(f"_w{i + 1}", more + 1), F.lit(0)) > 0)
            placed = placed.withColumn(f"_two{i}", two)
            two = F.col(f"_two{i}")
        found = F.when(two, value(i, more, False)).otherwise(value(i, more, True)) if schema[i].name in decimals else value(i, more, True)
        placed = placed.withColumn(f"_v{i}", F.when(F.col("_one"), found)).withColumn(f"_e{i + 1}", more + two.cast("int"))
    text = F.array_join("fields", ",")
    values = [F.col(f"_v{i}").alias(f.name) for i, f in enumerate(schema)]
    if bad == "fail":
        told = F.raise_error(F.concat(F.lit("fields that don't fit in just one way: "), text))
        values[0] = F.when(F.col("_one"), F.col("_v0")).otherwise(told.cast(schema[0].dataType)).alias(schema[0].name)
    more = [F.when(~F.col("_one"), text).alias("bad_value")] if bad == "quarantine" else []
    return placed.select(*values, *more)

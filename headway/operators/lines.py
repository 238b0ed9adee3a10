"""Sub-lines and missions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.functions.scalars import mission_lines, mission_service, mission_terminus, mission_via
from headway.model import STRETCHES, SUB_LINES


def line_membership(stretches: DataFrame, span: int | None = None) -> DataFrame:
    """`(line, pos, label)` from the stretches `(line, seq, labels)` each line runs over.

    Stretches are joined end to end in the order of `seq`, unique per line. Only their
    sizes are summed, the labels are not gathered. With `span` only the stretches of one
    line whose `seq` fall in one span of that width meet in a task; what lies before
    the span comes from a summary of one row per line and span.
    """
    sized = stretches.filter(F.col("line").isNotNull()).withColumn("_n", F.size("labels"))
    earlier = (Window.unboundedPreceding, -1)
    if span is None:
        before = Window.partitionBy("line").orderBy("seq").rowsBetween(*earlier)
        placed = sized.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        spans = sized.withColumn("_span", F.floor(F.col("seq") / span))
        totals = spans.groupBy("line", "_span").agg(F.sum("_n").alias("_total"))
        over_spans = Window.partitionBy("line").orderBy("_span").rowsBetween(*earlier)
        base = totals.select("line", "_span", F.coalesce(F.sum("_total").over(over_spans), F.lit(0)).alias("_base"))
        within = Window.partitionBy("line", "_span").orderBy("seq").rowsBetween(*earlier)
        local = spans.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        placed = local.join(base, ["line", "_span"]).withColumn("_first", F.col("_base") + F.col("_in"))
    return placed.select("line", "_first", F.posexplode("labels").alias("_i", "label")).select(
        "line", (F.col("_first") + F.col("_i")).cast("long").alias("pos"), "label"
    )


def known_stretches(spark: SparkSession) -> DataFrame:
    """The stretches of the known sub-lines, as input of `line_membership`."""
    rows = [(line, seq, STRETCHES[name]) for line, names in SUB_LINES.items() for seq, name in enumerate(names)]
    return spark.createDataFrame(rows, "line string, seq int, labels array<string>")


def decode_mission(df: DataFrame) -> DataFrame:
    """Adds what the letters of `mission` mean; NULL for letters without a meaning."""
    mission = F.col("mission")
    return (
        df.withColumn("mission_terminus", mission_terminus(mission))
        .withColumn("mission_lines", mission_lines(mission))
        .withColumn("mission_service", mission_service(mission))
        .withColumn("mission_via", mission_via(mission))
    )

"""Helpers of the operators: written intermediate tables, functions over Arrow batches, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from headway.model import shared_folder


def scratch(spark, name: str) -> str:
    """A new place in the folder that all executors see."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and kept if executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_rows(df: DataFrame, schema: str, function: Callable[[], Callable[[dict], Iterable[tuple]]]) -> DataFrame:
    """Runs a row function over Arrow batches; memory is bounded by one batch and its results.

    `function` is called once per task and gives the function that makes result tuples from
    the columns of one batch, given as lists.
    """
    types = StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = function()
        for batch in batches:
            rows = list(make({n: batch.column(i).to_pylist() for i, n in enumerate(names)}))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, types)


def unused(name: str, df: DataFrame) -> str:
    """The name, made longer until no column of the frame has it."""
    while name in df.columns:
        name += "_"
    return name


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(0)).cast("int")


#: Ids that are sent to all tasks at most: some 32 MB.
SENT_IDS = 1 << 20


def few_or_shuffled(ids: DataFrame) -> DataFrame:
    """A table of ids, written, to join rows with: sent to all tasks up to SENT_IDS of them, else joined by a shuffle.

    Rows with texts then move only if the ids are many.
    """
    kept = written(ids, "ids")
    return F.broadcast(kept) if kept.count() <= SENT_IDS else kept


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `df` whose doc_id isn't among the ids; rows with a null id stay."""
    gone = few_or_shuffled(ids.select(F.col("doc_id").alias("_gone")).distinct())
    return df.join(gone, df["doc_id"] == gone["_gone"], "left_anti")


def keep_rows(df: DataFrame, function: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """Rows whose `text` passes a test, with all their columns and without a shuffle.

    `function` is called once per task and gives the test.
    """
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = function()
        for batch in batches:
            yield batch.filter(pa.array([passes(t.as_py()) for t in batch.column(at)], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)

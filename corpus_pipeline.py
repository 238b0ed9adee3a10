"""A corpus from raw documents to packed sequences: each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import decontaminate, packing, repeats, simhash, similar, toxicity
from headway.llm.common import without, written
from headway.llm.components import components
from headway.llm.queries import TOKENIZER
from headway.llm.queries import prepare as prepare_queries


def prepare(spark: SparkSession) -> None:
    """Settings of the operators, with smaller batches: all stages share the executors' Python workers and buffers, which
    keep the memory that the largest batch took."""
    prepare_queries(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorization machine, learned from the labels, doesn't take for toxic."""
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash fingerprints, or by five-word shingles that are 0.8 similar, the one with the
    smallest doc_id that can be reached.

    Fingerprints at two differing bits miss near copies with a few changed words; the shingles find these exactly, and the
    links of both make the groups. Rows that repeat a doc_id stay or go together.
    """
    prepare(spark)
    prints = simhash.near_duplicates(docs.where("doc_id is not null"))
    links = prints.select("doc_id", "component_id").union(similar.near_copies(docs).select("doc_id", "component_id"))
    groups = components(links.toDF("a", "b"))
    return without(docs, groups.where("component < node").select(F.col("node").alias("doc_id")))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines and sentences that an earlier document or place has; n_chars follows the text."""
    prepare(spark)
    found = repeats.remove_repeats(docs, spans=False)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    prepare(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

#: Fingerprints, token ids and a fitted model are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

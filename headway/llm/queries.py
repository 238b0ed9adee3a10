"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import (
    decontaminate, language, mixing, packing, prefix_trie, quality, repeats, sharding, simhash, spelling, token_counts,
    token_files, toxicity,
)
from headway.model import ship_package

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return function(spark, folder)

    _registered[function.__name__] = run
    return run


def prepare(spark: SparkSession) -> None:
    """Settings the operators count on: batches small enough that long texts fit in a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def registered() -> dict[str, Query]:
    return dict(_registered)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@query
def op2_substring_dedup(spark, folder):
    """The documents without repeats; the spans taken out and kept as `start+length` of the original text."""
    found = repeats.remove_repeats(_table(spark, folder, "documents"))

    def listed(spans):
        texts = F.transform(spans, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string")))
        return F.array_join(texts, " ")

    return found.withColumns({name: listed(name) for name in ("removed", "kept")})


@query
def op3_best_fit_packing(spark, folder):
    return packing.pack_documents(_table(spark, folder, "documents"), TOKENIZER)


@query
def op5_token_files(spark, folder):
    return token_files.encode_documents(_table(spark, folder, "documents"), TOKENIZER)


@query
def op6_sharding(spark, folder):
    return sharding.shard_documents(_table(spark, folder, "documents"))


@query
def op9_token_counts(spark, folder):
    return token_counts.count_tokens(_table(spark, folder, "documents"), PIECES)


@query
def op10_decontamination(spark, folder):
    found = decontaminate.find_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("bits")


@query
def op7_toxicity(spark, folder):
    documents = _table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.train(documents, _table(spark, folder, "labels")))


@query
def op8_line_quality(spark, folder):
    return quality.rate_quality(_table(spark, folder, "documents"))


@query
def op4_language_id(spark, folder):
    documents = _table(spark, folder, "documents")
    return language.predict(documents, language.train(documents))


@query
def op13_mixing(spark, folder):
    return mixing.mix_documents(_table(spark, folder, "documents"))


@query
def op11_prefix_trie(spark, folder):
    return prefix_trie.rebuilt_trie(_table(spark, folder, "conversations")).drop("node", "parent")


@query
def op12_spelling_groups(spark, folder):
    return spelling.spelling_groups(spelling.count_words(_table(spark, folder, "documents")))

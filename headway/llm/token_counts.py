"""Token counts of whole texts under a SentencePiece BPE model, from counts of distinct pre-tokens.

A pre-token is a word with the spaces before it, or a line feed and what follows it up to the next space. No piece of
the model reaches over its bounds, so a text has as many tokens as its pre-tokens have together. Every
distinct pre-token of the corpus is counted once, into a table. The documents' pre-token
frequencies are joined to it: the frequent part, at most HEAD rows, is sent to the tasks, where it covers most
occurrences; the other pre-tokens of a document are joined by a shuffle. No ids are made.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from headway.llm.common import written

#: Rows of the pre-token table that are sent to every task at most, and characters of each: at most about 100 MB in a worker.
HEAD, HEAD_CHARS = 1 << 19, 40
#: Distinct pre-tokens that a task holds while it counts them.
HELD = 400_000
_SPACE = "▁"  # the model's mark of a space; in a text it counts as one
_UNITS = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")


class PieceCounter:
    """Number of pieces of a pre-token.

    A pre-token is given without its first space, as the model puts one before every text; one that begins with a
    line feed is given with it.
    """

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [
            self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        ]
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model reach over the bounds of words or lines")
        if self.model.encode(" a  b") != self.model.encode(f" a {_SPACE}b") or len(self.model.encode("a\n")) != 2:
            raise ValueError("this model changes spaces or line feeds")

    def __call__(self, pre_token: str) -> int:
        if not pre_token:
            return 1
        return len(self.model.encode(pre_token)) - (pre_token[0] == "\n")


@cache
def counter(path: str) -> PieceCounter:
    """One model per worker process and file."""
    return PieceCounter(path)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, as PieceCounter takes them; none for an empty text."""
    if not text:
        return []
    text = text.replace(_SPACE, " ")
    if "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
        return [u[1:] if u[0] == " " else u for u in _UNITS.findall(" " + text)]
    found: list[str] = []
    for number, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if number:
            words[0] = "\n" + words[0]
        found += words
    return found


def piece_table(texts: DataFrame, model: str) -> DataFrame:
    """(pre_token, uses, pieces) for every distinct pre-token of the column `text`."""
    schema = pa.schema([("pre_token", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), type=pa.string()), pa.array(list(held.values()), type=pa.int64())], schema=schema
            )

        for batch in batches:
            for text in batch.column(0):
                held.update(pre_tokens(text.as_py() or ""))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([of(p) for p in batch.column(0).to_pylist()], type=pa.int64())],
                names=["pre_token", "uses", "pieces"],
            )

    distinct = texts.select("text").mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n"))
    return distinct.mapInArrow(pieces, "pre_token string, uses long, pieces long")


def head_of(table: DataFrame) -> dict[str, int]:
    """The most used pre-tokens with their counts, at most HEAD, none longer than HEAD_CHARS."""
    short = table.where(F.length("pre_token") <= HEAD_CHARS).withColumn("scale", F.floor(F.log2("uses") * 4))
    fits, least = 0, None
    for row in sorted(short.groupBy("scale").count().collect(), reverse=True):  # some 250 rows at most
        fits += row["count"]
        if fits > HEAD:
            break
        least = row["scale"]
    if least is None:
        return {}
    chosen = short.where(F.col("scale") >= least).select("pre_token", "pieces").toArrow()
    return dict(zip(chosen.column(0).to_pylist(), chosen.column(1).to_pylist(), strict=True))


def count_tokens(documents: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above `limit`).

    A null text counts as empty and has no tokens. Rows that repeat a doc_id are counted each; null ids are
    carried. Other columns are ignored; no rows give none.
    """
    spark = documents.sparkSession
    table = written(piece_table(documents, model), "pre-tokens")
    head = spark.sparkContext.broadcast(head_of(table))
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()),
        ("others", pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int64())]))),
    ])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces_of, row = head.value.get, TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                tokens = pre_tokens(text)
                counts = list(map(pieces_of, tokens))
                others: Counter = Counter()
                if None in counts:
                    others.update(t for t, n in zip(tokens, counts, strict=True) if n is None)
                rows.append((
                    row, doc_id, len(text.encode()), sum(filter(None, counts)),
                    [{"pre_token": t, "n": n} for t, n in others.items()],
                ))
                row += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(rows.mapInArrow(
        known, "row long, doc_id long, n_bytes long, known long, others array<struct<pre_token:string,n:bigint>>"
    ), "known-tokens")
    others = found.select("row", F.explode("others").alias("other")).select("row", "other.*")
    counts = table.select(F.col("pre_token").alias("t"), "pieces")
    summed = others.join(counts, others["pre_token"] == counts["t"]).groupBy("row").agg(
        F.sum(F.col("n") * F.col("pieces")).alias("more")
    ).withColumnRenamed("row", "r")
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return found.drop("others").join(summed, F.col("row") == F.col("r"), "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")
    )

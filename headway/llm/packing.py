"""Best-fit packing of documents into sequences of bounded length, planned on counts of lengths.

Only the number of pieces of each length (at most `limit` numbers, whatever the size of the corpus) reaches
the planner. It opens a sequence with the longest piece left and fills the gap exactly: by one piece, by a pair or by
a triple whose lengths sum to it, under the counts that are left. Sequences whose gap no combination fills
take the longest piece that fits, again and again. A plan is a list of patterns (lengths) with how often
each is used. Pieces get their places by their rank among those of their length, so no task sees more than its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import written
from headway.llm.tokenizing import encoder

END_ID = 0


class _Stock:
    """Counts of pieces by length, with the lengths that are left."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.left = np.zeros(limit + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def take(self, pattern: list[int], times: int) -> None:
        for length in pattern:
            self.left[length] -= times

    def times(self, pattern: list[int]) -> int:
        return min(int(self.left[length]) // pattern.count(length) for length in pattern)

    def single(self, gap: int) -> list[int]:
        return [gap] if self.left[gap] > 0 else []

    def pair(self, gap: int) -> list[int]:
        """Two lengths that sum to the gap, the longer one as long as can be."""
        low = np.arange(1, gap // 2 + 1)
        found = (self.left[low] > 0) & (self.left[gap - low] > 0) & ((low * 2 != gap) | (self.left[low] > 1))
        at = np.flatnonzero(found)
        return [gap - int(low[at[0]]), int(low[at[0]])] if len(at) else []

    def triple(self, gap: int) -> list[int]:
        """Three lengths that sum to the gap, the longest one as long as can be."""
        for longest in np.flatnonzero(self.left[: max(0, gap - 1)])[::-1].tolist():
            if longest * 3 < gap:
                break
            self.left[longest] -= 1
            rest = self.pair(gap - longest)
            self.left[longest] += 1
            if rest:
                return [longest, *rest]
        return []

    def longest(self, gap: int) -> int:
        at = np.flatnonzero(self.left[: gap + 1])
        return int(at[-1]) if len(at) else 0


def plan(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each summing to `limit` at most, and how often each is used; all pieces are used."""
    stock, patterns = _Stock(counts, limit), []
    while first := stock.longest(limit):
        stock.left[first] -= 1
        gap = limit - first
        rest = stock.single(gap) or stock.pair(gap) or stock.triple(gap) if gap else []
        if gap and not rest:
            while gap and (next_ := stock.longest(gap)):
                stock.left[next_] -= 1
                rest.append(next_)
                gap -= next_
                if gap and (end := stock.single(gap) or stock.pair(gap) or stock.triple(gap)):
                    for length in end:
                        stock.left[length] -= 1
                    rest.extend(end)
                    gap = 0
            for length in rest:
                stock.left[length] += 1
        stock.left[first] += 1
        pattern = [first, *rest]
        times = stock.times(pattern)
        stock.take(pattern, times)
        patterns.append((pattern, times))
    return patterns


def token_pieces(documents: DataFrame, tokenizer: str, limit: int, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `limit` ids: doc_id, piece, start, length, ids_crc32, part, own_rank (and ids).

    A document is its ids and the end id; a null or empty text has the end id only. Longer ones are
    cut from the end, so that the first piece may be the shorter one. `part` is the task that read a document and
    `own_rank` the piece's rank among those of its length there.
    """
    fields = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("own_rank", pa.int64()),
    ] + ([("ids", pa.binary())] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(limit + 1, dtype=np.int64)
        for batch in batches:
            ids, bounds = encode(batch.column(1), END_ID)
            content, rows = memoryview(ids.astype("<u4")).cast("B"), []
            for doc_id, first, last in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                n = last - first
                cuts = [0, *range(n % limit or limit, n, limit), n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = content[4 * (first + a) : 4 * (first + b)]
                    row = (doc_id, piece, a, b - a, zlib.crc32(own), part, int(seen[b - a]))
                    rows.append((*row, own.tobytes()) if with_ids else row)
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                if rows else [pa.array([], type=f.type) for f in schema], schema=schema,
            )

    types = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, own_rank long"
    return documents.select("doc_id", "text").mapInArrow(run, types + (", ids binary" if with_ids else ""))


def place(pieces: DataFrame, limit: int) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length, part and own_rank.

    Sequences are numbered from 0; within one the pieces follow each other from offset 0 without gaps.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Bounded: at most `limit` lengths, and every pattern but a last few uses up the pieces of some length.
    intervals, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, limit):
        offset = 0
        for length in pattern:
            intervals.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    # As an Arrow table: rows would start Python workers of their own on the executors, beside those of the operators.
    names = ("p_length", "p_from", "p_to", "p_sequence", "p_offset")
    places = spark.createDataFrame(pa.Table.from_arrays(
        [pa.array([row[i] for row in intervals], type=pa.int64()) for i in range(len(names))], names=names
    ))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(
        F.col("length").alias("s_length"), F.col("part").alias("s_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s_start"),
    )
    ranked = pieces.join(
        starts, (pieces["length"] == starts["s_length"]) & (pieces["part"] == starts["s_part"])
    ).withColumn("s_rank", F.col("s_start") + F.col("own_rank"))
    placed = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("p_length")) & (F.col("s_rank") >= F.col("p_from")) & (F.col("s_rank") < F.col("p_to")),
    )
    others = [c for c in pieces.columns if c not in ("part", "own_rank")]
    return placed.select(
        *others,
        (F.col("p_sequence") + F.col("s_rank") - F.col("p_from")).alias("sequence_id"),
        F.col("p_offset").alias("offset"),
    )


def pack_documents(documents: DataFrame, tokenizer: str, limit: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids as bytes).

    `start` counts the document's ids before the piece. Null texts count as empty and give a piece with the end id.
    Rows that repeat a doc_id are packed like others; other columns are ignored; no rows give none.
    """
    return place(written(token_pieces(documents, tokenizer, limit, with_ids), "pieces"), limit)

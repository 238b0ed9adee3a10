"""Substring deduplication by hashing normalised units of lines.

A unit is a line, or a sentence of a line that has several. Units are normalised (lower case, single
spaces) and hashed; the digest's earliest occurrence by (doc_id, text, place in the text) is the original, all others are
repeats. Repeats that follow each other form a run. Runs of at least `least_chars` normalised code points are taken out,
and so are lines of at least `least_line` of them whose units are all repeats. Code points measure all scripts alike. What
is shorter, a lone "Yes.", recurs by chance in texts that have nothing else in common, and stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from headway.llm.common import over_rows, unused, written

LEAST_CHARS, LEAST_LINE = 40, 24
# A unit reaches to the end of its line, or to the end of a sentence and the spaces after it. Sentences of scripts that
# put no spaces end without one.
_UNIT = re.compile(
    r"[^\n]*?(?:[.!?…][\"'”’)\]]*(?:[ \t]+|(?=\n|\Z))|[。！？][\"'”’)\]」』]*[ \t]*)|[^\n]+|\n"
)


def units(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, normalised text, line) of the units of a text, in code points, without gaps.

    White space belongs to the unit before it; at the text's begin it is a unit without words.
    """
    start = end = line = own_line = 0
    held = ""
    for match in _UNIT.finditer(text):
        found = match.group()
        if not found.strip():
            line += found == "\n"
            end = match.end()
            continue
        if held or end > start:
            yield start, end, held, own_line
        start, end, held, own_line = match.start(), match.end(), " ".join(found.lower().split()), line
    if end > start:
        yield start, end, held, own_line


def _digests(documents: DataFrame) -> DataFrame:
    """A row per unit with words: its digest as two longs, and its place (doc_id, print of the text, number)."""

    def start():
        def rows(columns):
            for doc_id, text, own in zip(columns["doc_id"], columns["text"], columns["print"], strict=True):
                for number, (_, _, words, _) in enumerate(units(text or "")):
                    if words:
                        digest = xxhash.xxh3_128_intdigest(words)
                        yield (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), doc_id, own, number
        return rows

    return over_rows(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")),
        "high long, low long, doc_id long, print long, number int", start,
    )


def repeated_units(documents: DataFrame) -> DataFrame:
    """Per text with repeats: doc_id, print (xxhash64 of the text), numbers (of the units that are repeats).

    Documents with a null doc_id are last in rank, so they are never originals of others' units.
    """
    found = written(_digests(documents), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print", "number")
    firsts = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written, so that the join below stands on two plain shuffles and Spark can split a digest that very many units have.
    firsts = written(firsts.select(
        F.col("high").alias("h"), F.col("low").alias("l"), F.col("first.doc_id").alias("first_doc"),
        F.col("first.print").alias("first_print"), F.col("first.number").alias("first_number"),
    ), "repeated-digests")
    original = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("print") == F.col("first_print"))
    again = found.join(firsts, (found["high"] == firsts["h"]) & (found["low"] == firsts["l"])).where(
        ~(original & (F.col("number") == F.col("first_number")))
    )
    return again.where("doc_id is not null").groupBy("doc_id", "print").agg(F.collect_set("number").alias("numbers"))


def taken_out(
    found: list[tuple[int, int, str, int]], numbers: set[int], least_chars: int = LEAST_CHARS, least_line: int = LEAST_LINE
) -> set[int]:
    """Of the repeats among a text's units, those in runs that are long enough, and those of whole lines that are."""
    lines: dict[int, int] = {}
    for _, _, words, line in found:
        lines[line] = lines.get(line, 0) + len(words)
    kept = {line for k, (_, _, words, line) in enumerate(found) if words and k not in numbers}
    out: set[int] = set()
    run: list[int] = []
    chars = 0
    for number in [*sorted(numbers), -1]:
        if run and number != run[-1] + 1:
            out.update(run if chars >= least_chars else (
                k for k in run if found[k][3] not in kept and lines[found[k][3]] >= least_line
            ))
            run, chars = [], 0
        if number >= 0:
            run.append(number)
            chars += len(found[number][2])
    return out


def remove_repeats(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_line: int = LEAST_LINE, spans: bool = True
) -> DataFrame:
    """All columns of the documents, with repeats taken out of `text`, and with `spans` two more:

    removed   array of (start, length): the spans taken out, as code points of the original text, ascending
    kept      array of (start, length): the spans that stay; joined, they are the new text

    A null text stays null and an empty one empty. Repeats within one document count. Rows that repeat a doc_id and its
    text are one document: all keep the same units. Rows of one doc_id with different texts are documents of their own,
    ranked by a hash of the text. Rows with a null doc_id stay as they are. Columns named like the two are replaced.
    Every row of the documents is returned.
    """
    rows = documents.drop("removed", "kept") if spans else documents
    gone_id, gone_print, gone_numbers = (unused(name, rows) for name in ("gone_id", "gone_print", "gone_numbers"))
    gone = repeated_units(documents).select(
        F.col("doc_id").alias(gone_id), F.col("print").alias(gone_print), F.col("numbers").alias(gone_numbers)
    )
    same = (rows["doc_id"] == gone[gone_id]) & (F.xxhash64(rows["text"]) == gone[gone_print])
    joined = rows.join(gone, same, "left").drop(gone_id, gone_print)
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    names = rows.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, kept = [], [], []
            for text, numbers in zip(batch.column(at), batch.column(len(names)), strict=True):
                text, numbers = text.as_py(), set(numbers.as_py() or ())
                found = list(units(text or "")) if numbers else []
                numbers = taken_out(found, numbers, least_chars, least_line)
                out, stay = [], []
                for number, (start, end, _, _) in enumerate(found) if numbers else ():
                    side = out if number in numbers else stay
                    if side and side[-1][1] == start:
                        side[-1] = (side[-1][0], end)
                    else:
                        side.append((start, end))
                if not numbers and text:
                    stay = [(0, len(text))]
                texts.append("".join(text[a:b] for a, b in stay) if numbers else text)
                removed.append([{"start": a, "length": b - a} for a, b in out])
                kept.append([{"start": a, "length": b - a} for a, b in stay])
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, type=columns[at].type)
            more = [pa.array(removed, type=span), pa.array(kept, type=span)] if spans else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "removed", "kept"][: len(names) + len(more)])

    more = StructType.fromDDL(
        "removed array<struct<start:int,length:int>>, kept array<struct<start:int,length:int>>"
    )
    return joined.mapInArrow(run, StructType([*rows.schema.fields, *(more.fields if spans else ())]))

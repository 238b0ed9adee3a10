"""Line-first cleaning: rules on lines take lines out; documents that lose too much are rejected.

A line without words is no line here. A line fails if it is
  navigation    at least two bars or arrows stand alone between its words, as in "Home | News | Login"
  boilerplate   it names cookies, scripts, logins, rights or licences in a phrase of BOILERPLATE, one in every PHRASE_WORDS
                words or more: a long line that mentions one is prose
  symbols       over SYMBOLS of its words hold a character of `#*$%&|<>`, or end in "!!"
  unfinished    it ends without closing punctuation, has fewer than UNFINISHED_WORDS words and isn't the first
The document's words in lines that stay are counted against all its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import keep_rows

LEAST_WORDS, MOST_REPEATED = 50, 0.5
SYMBOLS, UNFINISHED_WORDS, PHRASE_WORDS = 0.3, 8, 25
#: Share of its words that a document must keep.
LEAST_KEPT = 0.5
_SYMBOL = "#*$%&|<>"
_MARKS = {m.encode() for m in ("|", "»", "›", "→", "/", ">")}
_BOILERPLATE = re.compile(
    r"\b(?:uses? cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript"
    r"|javascript is (?:disabled|required)|sign in|log in|subscribe to our|click here|licensed under"
    r"|released under|lorem ipsum)\b",
    re.IGNORECASE,
)
_SYMBOL_WORD = re.compile(rb"[#*$%&|<>]|!!")
_CLOSED = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*[ \t\v\f\r]*\Z")


def line_fails(line: str, first: bool) -> bool:
    """Whether a line with words breaks a rule."""
    words = line.encode().split()
    if sum(w in _MARKS for w in words) >= 2:
        return True
    if _BOILERPLATE.search(line) and len(words) <= PHRASE_WORDS * len(_BOILERPLATE.findall(line)):
        return True
    if any(c in line for c in _SYMBOL) or "!!" in line:
        if sum(1 for w in words if _SYMBOL_WORD.search(w)) > SYMBOLS * len(words):
            return True
    return not first and len(words) < UNFINISHED_WORDS and not _CLOSED.search(line)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text has at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, bool, bool, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words that stay."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, _SYMBOL))
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    again = repeated_words(words)
    failed = len(words) < LEAST_WORDS or again > MOST_REPEATED * len(words)
    stay = 0
    for number, line in enumerate(lines):
        if not line_fails(line, number == 0):
            stay += len(line.encode().split())
    kept = not failed and stay >= LEAST_KEPT * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), again, failed, kept, stay


def cleaned(text: str) -> str:
    """The text without the lines that fail; lines without words stay."""
    out, first = [], True
    for line in text.split("\n"):
        worded = bool(line.strip(" \t\v\f\r"))
        if not (worded and line_fails(line, first)):
            out.append(line)
        first = first and not worded
    return "\n".join(out)


def rate_quality(documents: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed, kept and n_kept_words.

    Counts are over the whole text; a null text counts as empty, has no words and so fails. Rows that repeat a
    doc_id are rated each; null ids are carried. Other columns are ignored.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
        ("n_kept_words", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))],
                schema=schema,
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_kept_words long",
    )


def clean_documents(documents: DataFrame) -> DataFrame:
    """Documents that are kept, with all their columns and failed lines taken out of `text`."""
    kept = keep_rows(documents, lambda: lambda text: measure(text)[6])
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([cleaned(t.as_py()) for t in batch.column(at)], type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return kept.mapInArrow(run, kept.schema)

"""Token ids in files of 64-bit words (Simple-8b), written and read by Spark tasks.

A word has a selector in its top four bits and, below, as many ids as the selector says, first id lowest. Ids
are coded in blocks of BLOCK, so that any block can be decoded alone. Ids that 60 bits can't hold
are escapes: a zero stands in the words, their place and value in a list of their own. Decoding takes all
words of one selector at once.

A file is little-endian, eight bytes a number:
MAGIC | words | escape places | escape values | per block its first word | doc_ids | ids per document |
number of words, escapes, blocks, documents, ids | MAGIC
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import scratch, written
from headway.llm.packing import END_ID
from headway.llm.tokenizing import encoder

MAGIC = b"HWTOK001"
BLOCK = 1 << 16
#: Ids after which a task begins another file; a file is read as one row.
FILE_IDS = 1 << 23
#: The encoder's words kept per worker, some 120 MB, and bytes of text at once: a worker has little else to hold.
MEMO_WORDS, AT_ONCE = 690_000, 6 << 20

# Fixed values of the format: how many ids a word holds and in how many bits each, by selector.
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
#: Words that are passed at once in looking for where words begin, a power of two.
STRIDE = 16
# Bits of the ids of any usual vocabulary.
_WIDTHS = np.frexp(np.arange(1 << 18, dtype=np.float64))[1].astype(np.uint8)


def _chain(choice: np.ndarray) -> np.ndarray:
    """Where words begin if the first begins at 0 and each after the ids of the one before."""
    size = len(choice)
    after = np.append(np.minimum(np.arange(size) + _COUNTS[choice], size), size).astype(np.int32)
    far, stride = after, 1
    while stride < STRIDE:
        far, stride = far[far], stride * 2
    leap, anchors, i = memoryview(far), [], 0
    while i < size:
        anchors.append(i)
        i = leap[i]
    columns = [np.array(anchors, dtype=np.int32)]
    for _ in range(STRIDE - 1):
        columns.append(after[columns[-1]])
    first = np.stack(columns, axis=1).ravel()
    return first[first < size]


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words of one block of ids below 2^60. The last word may hold fewer ids than its selector says."""
    size = len(ids)
    if not size:
        return np.zeros(0, dtype="<u8")
    # Bits of each id (above 2^53 perhaps one more than needed) and, by doubling, the most in a window of n ids. Past
    # the end are zeros.
    widths = np.zeros(size + SELECTORS[0][0], dtype=np.uint8)
    if int(ids.max()) < len(_WIDTHS):
        widths[:size] = _WIDTHS[ids.astype(np.int32)]
    else:
        widths[:size] = np.minimum(np.frexp(ids.astype(np.float64))[1], SELECTORS[-1][1])
    most = {1: widths}
    while (n := max(most)) * 2 <= SELECTORS[0][0]:
        most[n * 2] = np.maximum(most[n][:-n], most[n][n:])
    # Whatever suits a selector suits those after it, of fewer and wider ids: so the first that suits follows from their number.
    choice = np.full(size, len(SELECTORS) - 1, dtype=np.uint8)
    for n, bits in SELECTORS[:-1]:
        half = 1 << (n.bit_length() - 1)
        widest = np.maximum(most[half][:size], most[half][n - half : n - half + size])
        choice -= (widest <= bits).view(np.uint8)
    first = _chain(choice)
    chosen = choice[first]
    padded = np.concatenate([ids, np.zeros(SELECTORS[0][0], dtype=np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (n, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == selector)
        if bits and len(own):
            at, packed = first[own], words[own]
            for k in range(n):
                packed |= padded[at + k] << np.uint64(k * bits)
            words[own] = packed
    return words.astype("<u8")


def decode_block(words: np.ndarray, size: int) -> np.ndarray:
    """The `size` ids of one block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector, (n, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(selectors == selector)
        if bits and len(own):
            shifts = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            out[starts[own][:, None] + np.arange(n)] = (words[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out[:size]


class Writer:
    """Collects documents and gives the bytes of a file; holds coded words, not ids, beyond one block."""

    def __init__(self):
        self.words, self.firsts, self.n_words = [], [], 0
        self.escape_at, self.escape_ids = [], []
        self.open, self.open_ids, self.done = [], 0, 0
        self.doc_ids, self.lengths = [], []

    @property
    def ids(self) -> int:
        return self.done + self.open_ids

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(np.iinfo(np.int64).min if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.open.append(ids.astype(np.uint64))
        self.open_ids += len(ids)
        if self.open_ids >= BLOCK:
            self._flush(self.open_ids // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, dtype=np.uint64)
        for a in range(0, upto, BLOCK):
            block = ids[a : min(a + BLOCK, upto)].copy()
            large = np.flatnonzero(block >> np.uint64(60))
            self.escape_at.extend((self.done + large).tolist())
            self.escape_ids.extend(block[large].tolist())
            block[large] = 0
            words = encode_block(block)
            self.firsts.append(self.n_words)
            self.words.append(words)
            self.n_words += len(words)
            self.done += len(block)
        self.open, self.open_ids = [ids[upto:]], len(ids) - upto

    def content(self) -> bytes:
        self._flush(self.open_ids)
        parts = [
            *self.words, np.array(self.escape_at, dtype="<u8"), np.array(self.escape_ids, dtype="<u8"),
            np.array(self.firsts, dtype="<u8"), np.array(self.doc_ids, dtype="<i8"), np.array(self.lengths, dtype="<u8"),
            np.array([self.n_words, len(self.escape_at), len(self.firsts), len(self.doc_ids), self.done], dtype="<u8"),
        ]
        return MAGIC + b"".join(p.tobytes() for p in parts) + MAGIC


def documents_of(content: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of each document of a file, in order; one block at a time."""
    if content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a whole token file")
    n_words, n_escapes, n_blocks, n_docs, n_ids = np.frombuffer(content, "<u8", 5, len(content) - 48).tolist()
    at = 8
    sections = []
    for kind, n in (("<u8", n_words), ("<u8", n_escapes), ("<u8", n_escapes), ("<u8", n_blocks), ("<i8", n_docs), ("<u8", n_docs)):
        sections.append(np.frombuffer(content, kind, n, at))
        at += 8 * n
    words, places, values, firsts, doc_ids, lengths = sections
    ends = [*firsts[1:].tolist(), n_words]
    held, block, start = np.zeros(0, dtype=np.uint64), 0, 0
    for doc_id, length in zip(doc_ids.tolist(), lengths.tolist(), strict=True):
        got, have = [held], len(held)
        while have < length:
            size = min(BLOCK, n_ids - block * BLOCK)
            ids = decode_block(words[int(firsts[block]) : ends[block]], size)
            own = slice(*np.searchsorted(places, [block * BLOCK, block * BLOCK + size]))
            ids[places[own].astype(np.int64) - block * BLOCK] = values[own]
            got.append(ids)
            have += size
            block += 1
        held = np.concatenate(got) if len(got) > 1 else held
        yield None if doc_id == np.iinfo(np.int64).min else doc_id, start, held[:length]
        held, start = held[length:], start + length


def write_token_files(documents: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes files of ids in ascending order of doc_id; gives their list: file, part, number, n_docs, n_ids.

    Each document's ids are followed by the end id; null texts count as empty. Null ids come first, rows
    that repeat a doc_id follow each other in order of their text. Each attempt of a task writes files of
    its own name, and only the list names the valid ones, so a task that runs twice does no harm. `folder` is a URI
    that executors can write to through pyarrow's file systems.
    """
    schema = pa.schema([
        ("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, MEMO_WORDS, AT_ONCE)
        part, attempt, files = TaskContext.get().partitionId(), uuid4().hex[:12], []
        system, path = pafs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)

        def close(writer: Writer) -> None:
            name = f"part-{part:06d}-{len(files):04d}-{attempt}.tok"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(writer.content())
            files.append((name, part, len(files), len(writer.doc_ids), writer.done))

        writer = Writer()
        for batch in batches:
            ids, bounds = encode(batch.column(1), END_ID)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                writer.add(doc_id, ids[a:b])
                if writer.ids >= FILE_IDS:
                    close(writer)
                    writer = Writer()
        if writer.doc_ids:
            close(writer)
        if files:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*files, strict=True), schema, strict=True)], schema=schema
            )

    rows = documents.select("doc_id", "text")
    order = ("doc_id", "text")
    ranged = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), *order)
    return written(
        ranged.mapInArrow(run, "file string, part int, number int, n_docs long, n_ids long"), "token-files"
    )


def read_token_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """Per document of the listed files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("own_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
        ("file", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rpartition("/")[2]
                rows = [
                    (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name)
                    for doc_id, start, ids in documents_of(content.as_py())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

    # The list has one row per file, so its running sum may stand in one task.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        F.col("file").alias("_file"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_start")
    )
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    found = raw.mapInArrow(run, "doc_id long, own_start long, n_tokens long, ids_crc32 long, file string")
    return found.join(starts, found["file"] == starts["_file"]).select(
        "doc_id", (F.col("_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(documents: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids and reads the files back: doc_id, start, n_tokens, ids_crc32 per document.

    Null texts count as empty and have the end id only. No rows give no files and no rows.
    """
    spark = documents.sparkSession
    folder = folder or scratch(spark, "tokens")
    files = write_token_files(documents, tokenizer, folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, files)

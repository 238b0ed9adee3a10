"""Benchmark items in documents: SimHash of item-sized windows, found by Hamming blocks, verified exactly.

Items of equal length form a class. A document's windows of that length get a SimHash over their five-word
shingles; a table per byte of the fingerprint gives the items whose byte is close, which by the pigeonhole
principle misses no item within RADIUS. Candidates are verified by the exact weighted similarity of their shingles (the
sum of least counts over the sum of greatest counts). A window that shares no shingle with any item of its class
has similarity 0 with all of them, so only windows around shared shingles are fingerprinted.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import keep_rows

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits allowed. Fingerprints of texts that are 0.8 similar differ in 10 of 64 bits on average,
#: with a deviation of 3; 23 = 8 bytes times (2 + 1) less 1 keeps within two bits in some byte.
RADIUS, BYTE_RADIUS = 23, 2
#: Items that one pass over the documents looks for; more items take more passes.
ITEMS_PER_PASS = 20_000
#: Pairs of a window and an item in memory at once.
PAIRS = 1 << 21
_FILTER_BITS = 20
# Which byte values are close to which.
_CLOSE = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]) <= BYTE_RADIUS


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` shingles at the starts."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    counts = sums[starts + size] - sums[starts]
    return np.packbits(2 * counts > size, axis=1, bitorder="little").view("<u8").ravel()


def _counts(words: list[bytes], size: int) -> Counter:
    return Counter(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


class _Class:
    """Items of one length in words."""

    def __init__(self, length: int, items: list[tuple[int, list[bytes]]]):
        self.length, self.size = length, min(SHINGLE, length)
        self.places = [i for i, _ in items]
        self.counts = [_counts(words, self.size) for _, words in items]
        hashes = [shingle_hashes(words, self.size) for _, words in items]
        self.shingles = np.unique(np.concatenate(hashes))
        self.prints = np.array(
            [window_fingerprints(h, np.array([0]), len(h))[0] for h in hashes], dtype=np.uint64
        )
        values = self.prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        self.tables = [_CLOSE[:, values[:, byte]] for byte in range(8)]  # byte value -> items

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius; PAIRS of them are looked at at once."""
        found = []
        step = max(1, PAIRS // len(self.prints))
        for a in range(0, len(prints), step):
            part = prints[a : a + step]
            values = part.astype("<u8").view(np.uint8).reshape(-1, 8)
            near = self.tables[0][values[:, 0]].copy()
            for byte in range(1, 8):
                near |= self.tables[byte][values[:, byte]]
            window, item = np.nonzero(near)
            distance = np.bitwise_count(part[window] ^ self.prints[item])
            within = distance <= RADIUS
            found.append((window[within] + a, item[within], distance[within]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Benchmark:
    """Items to look for. Items without words match nothing; items that share an id, or have none, are items each."""

    def __init__(self, items: list[tuple[int, str | None]]):
        by_length = defaultdict(list)
        self.ids = [item_id for item_id, _ in items]
        for place, (_, text) in enumerate(items):
            if words := words_of(text):
                by_length[len(words)].append((place, words))
        self.classes = [_Class(n, found) for n, found in sorted(by_length.items())]
        self.sizes = sorted({c.size for c in self.classes})
        self.seeds = {}
        for size in self.sizes:
            own = [(h, i) for i, c in enumerate(self.classes) if c.size == size for h in c.shingles.tolist()]
            hashes = np.array([h for h, _ in own], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            flags = np.zeros(1 << _FILTER_BITS, dtype=bool)
            flags[hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.seeds[size] = hashes[order], np.array([i for _, i in own])[order], flags

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int, float]]:
        """(item_id, first word, words, differing bits, similarity): the best window per item that is similar enough.

        Of equally similar windows the first counts.
        """
        words, best = words_of(text), {}
        for size in self.sizes:
            hashes = shingle_hashes(words, size)
            sorted_seeds, seed_class, flags = self.seeds[size]
            at = np.flatnonzero(flags[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
            low, high = (np.searchsorted(sorted_seeds, hashes[at], side=s) for s in ("left", "right"))
            shared = high > low
            if not shared.any():
                continue
            per_class = defaultdict(list)
            for p, a, b in zip(at[shared].tolist(), low[shared].tolist(), high[shared].tolist(), strict=True):
                for c in seed_class[a:b].tolist():
                    per_class[c].append(p)
            for c, places in per_class.items():
                self._verify(self.classes[c], words, hashes, np.array(places), best)
        return [(self.ids[place], *found) for place, found in sorted(best.items())]

    def _verify(self, of: _Class, words: list[bytes], hashes: np.ndarray, places: np.ndarray, best: dict) -> None:
        length = min(of.length, len(words))  # a document shorter than the items is one window
        size = length - of.size + 1
        open_ = np.zeros(len(words) - length + 2, dtype=np.int32)  # windows that hold a shared shingle
        np.add.at(open_, np.maximum(places - size + 1, 0), 1)
        np.add.at(open_, np.minimum(places, len(words) - length) + 1, -1)
        starts = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
        prints = []
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            for a in range(0, len(run), 4096):
                part = run[a : a + 4096]
                prints.append(window_fingerprints(hashes[part[0] : part[-1] + size], part - part[0], size))
        window, item, distance = of.candidates(np.concatenate(prints))
        held = {}
        for w, i, bits in zip(window.tolist(), item.tolist(), distance.tolist(), strict=True):
            start = int(starts[w])
            if start not in held:
                held = {start: _counts(words[start : start + length], of.size)}
            own, other = held[start], of.counts[i]
            least = sum(min(n, other[s]) for s, n in own.items() if s in other)
            similarity = least / (own.total() + other.total() - least)
            known = best.get(of.places[i])
            if similarity >= SIMILARITY and (known is None or similarity > known[3] or similarity == known[3] and start < known[0]):
                best[of.places[i]] = (start, length, bits, similarity)


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in lists of bounded length."""
    items: list[tuple[int, str | None]] = []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        items.append((row["item_id"], row["text"]))
        if len(items) == ITEMS_PER_PASS:
            yield items
            items = []
    if items:
        yield items


def find_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item found in it: doc_id, item_id, start, n_words, bits, similarity.

    The window has `n_words` words from word `start` on (words split at white space) and is at least 0.8 similar to
    the item; it is the document's best for that item. Null and empty texts have no items. Rows that
    repeat a doc_id are searched each; null ids are carried. Other columns are ignored; without documents or items
    there are no rows.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()),
        ("bits", pa.int32()), ("similarity", pa.float64()),
    ])
    types = "doc_id long, item_id long, start int, n_words int, bits int, similarity double"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = documents.sparkSession.createDataFrame([], types)
    for items in _passes(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Benchmark(items)
            for batch in batches:
                out = [
                    (doc_id, *match)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for match in index.matches(text.as_py())
                ]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                    )

        found = found.union(rows.mapInArrow(run, types))
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns; texts without words stay."""
    for items in _passes(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        def clean(items=items):
            index = Benchmark(items)
            return lambda text: not index.matches(text)

        documents = keep_rows(documents, clean)
    return documents

"""SimHash fingerprints of documents, and their links by a partitioned vantage-point tree.

A vantage point v and a threshold t split fingerprints by their Hamming distance to v: inside are those at t or
less, outside those above t - radius. By the triangle inequality the distances of two linked
fingerprints to v differ by the radius at most, so any two share a side; those near the boundary are on both. The
upper part of the tree is fitted on a bounded sample and deals all distinct fingerprints to shards;
within a shard the same splitting goes on until blocks are small enough to compare directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import written
from headway.llm.components import components

SEED = 42
#: Fingerprints that the tree is fitted on at most, and how many stand for one in the sample at least.
SAMPLE, SAMPLE_EVERY = 1 << 17, 64
#: Sampled fingerprints per shard, points tried as vantage points, and fingerprints that are compared directly.
SHARD_SAMPLE, TRIED, DIRECT = 64, 12, 768
_CHUNK = 1 << 15


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a whole text; 0 for a text without words.

    Words are runs without ASCII white space, A-Z in lower case. Every shingle counts, repeats included; a bit
    is set if it is set in over half of the shingles' XXH64. A text of fewer words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - words_per_shingle + 1)
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashed, seed = xxhash.xxh64_intdigest, SEED
    set_bits = np.zeros(64, dtype=np.int64)
    for a in range(0, n, _CHUNK):
        hashes = [hashed(whole[i:j], seed) for i, j in zip(starts[a : a + _CHUNK], stops[a : a + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row of the documents, fp as a signed 64-bit number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and threshold with the least work left, or None if splitting saves nothing.

    Work is taken as the squares of both sides' sizes; the points tried are spread evenly.
    """
    best, least = None, 0.8 * len(points) ** 2
    for vantage in points[:: max(1, len(points) // TRIED)][:TRIED]:
        below = np.cumsum(np.bincount(_distances(points, vantage), minlength=65))
        t = np.arange(radius, 64)
        inside, outside = below[t], len(points) - below[t - radius]
        work = inside.astype(float) ** 2 + outside.astype(float) ** 2
        work[(inside == len(points)) | (outside == len(points))] = np.inf
        at = int(np.argmin(work))
        if work[at] < least:
            best, least = (vantage, int(t[at])), work[at]
    return best


def fit_tree(sample: np.ndarray, radius: int, shard_sample: int = SHARD_SAMPLE) -> list[tuple]:
    """Nodes of the tree: (vantage, threshold, inside, outside) or (shard,); the first is the root."""
    nodes: list[tuple] = [()]
    work, shards = [(0, np.unique(sample))], 0
    while work:
        at, points = work.pop()
        split = best_split(points, radius) if len(points) > shard_sample else None
        if split is None:
            nodes[at] = (shards,)
            shards += 1
            continue
        d = _distances(points, split[0])
        nodes[at] = (*split, len(nodes), len(nodes) + 1)
        work += [(len(nodes), points[d <= split[1]]), (len(nodes) + 1, points[d > split[1] - radius])]
        nodes += [(), ()]
    return nodes


def shards_of(points: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(place among the points, shard) for every shard that a point belongs to."""
    places, shards = [], []
    work = [(0, np.arange(len(points)))]
    while work:
        at, own = work.pop()
        node = nodes[at]
        if not len(own):
            continue
        if len(node) == 1:
            places.append(own)
            shards.append(np.full(len(own), node[0]))
            continue
        d = _distances(points[own], node[0])
        work += [(node[2], own[d <= node[1]]), (node[3], own[d > node[1] - radius])]
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *places]), np.concatenate([empty, *shards])


def _least_labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place is connected to by the links (a, b)."""
    label = np.arange(size)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def linked_in(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all distinct points within the radius, as places: each point to its least.

    Not all pairs: what a block of points is connected to within the block is enough.
    """
    found_a, found_b = [], []
    work = [np.arange(len(points))]
    while work:
        own = work.pop()
        mine = points[own]
        split = best_split(mine, radius) if len(own) > DIRECT else None
        if split is not None:
            d = _distances(mine, split[0])
            work += [own[d <= split[1]], own[d > split[1] - radius]]
            continue
        for i in range(0, len(own), DIRECT):  # a block that no vantage point splits is compared in strips
            for j in range(i, len(own), DIRECT):
                left, right = own[i : i + DIRECT], own[j : j + DIRECT]
                x, y = np.nonzero(np.bitwise_count(points[left][:, None] ^ points[right][None, :]) <= radius)
                apart = left[x] != right[y]
                if apart.any():
                    both, at = np.unique(np.concatenate([left[x[apart]], right[y[apart]]]), return_inverse=True)
                    half = len(at) // 2
                    least = _least_labels(len(both), at[:half], at[half:])
                    linked = least != np.arange(len(both))
                    found_a.append(both[linked])
                    found_b.append(both[least[linked]])
    empty = np.zeros(0, dtype=np.int64)
    least = _least_labels(len(points), np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b]))
    linked = np.flatnonzero(least != np.arange(len(points)))
    return linked, least[linked]


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within the radius.

    The sample for the tree is drawn by hash, at most about SAMPLE and one in SAMPLE_EVERY, and only it
    reaches the driver. Every fingerprint goes through the tree to its shards.
    """
    total = distinct.count()
    share = min(1 / SAMPLE_EVERY, SAMPLE / max(total, 1))
    drawn = distinct.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = np.array([r[0] for r in drawn.select("fp").toLocalIterator()], dtype=np.int64).view(np.uint64)
    nodes = fit_tree(np.sort(sample), radius)
    dealt_schema = pa.schema([("shard", pa.int32()), ("fp", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False)
            at, shard = shards_of(points.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(points[at])], schema=dealt_schema
            )

    def link(table: pa.Table) -> pa.Table:
        points = np.unique(table.column("fp").to_numpy().view(np.uint64))
        a, b = linked_in(points, radius)
        return pa.table({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(documents: DataFrame, words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest doc_id
    that can be reached, the document's own included. Null and empty texts have fingerprint zero and are linked like
    others. Rows that repeat a doc_id are rows like others; a null doc_id is never a component's id, and a component
    of such rows only has a null one. Other columns are ignored; no rows give none.
    """
    prints = written(fingerprints(documents, words_per_shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    parts = components(fingerprint_links(distinct, radius))
    member = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    # Fingerprints without links keep their own least id; only linked ones are gathered by component.
    linked = member.join(parts.select(F.col("component").alias("c")).distinct(), F.col("component") == F.col("c"))
    of_parts = linked.groupBy("component").agg(F.min("least").alias("part_least")).withColumnRenamed("component", "c")
    found = member.join(of_parts, member["component"] == of_parts["c"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("part_least", "least").alias("component_id")
    )
    return prints.join(found, prints["fp"] == found["_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

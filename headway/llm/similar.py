"""Near copies of documents by the Jaccard similarity of their sets of word shingles, found by a prefix join.

Shingles have one order over the corpus: those that a sample shows in several documents come last, the others go by hash.
Two sets of a similarity of at least t share one of the first n - ceil(t n) + 1 shingles of either (n: its size), whatever
the order, so joining documents on these misses no pair; the sample only keeps hot shingles out.

Groups of near copies are linked first to one member each, the smallest that shares one of a set's least hashes, so that
the join then looks for pairs between different groups only: k near copies cost k links, not k^2 pairs. Candidates are
limited by size and place in the order, then by a bitmap of each set, whose differing bits are never more than the sets'
differing shingles. Only what passes is compared by its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import few_or_shuffled, over_rows, without, written
from headway.llm.components import components
from headway.llm.decontaminate import shingle_hashes, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Documents that the order is fitted on at most, and how many stand for one in the sample at least.
SAMPLE, SAMPLE_EVERY = 1 << 15, 8
#: Shingles that come last in the order at most, and sampled documents that such a shingle is in at least.
COMMON, COMMON_DOCUMENTS = 1 << 17, 3
#: Documents of one shingle that are compared in place; more, and common shingles, are joined over SALTS parts.
RUN, SALTS = 256, 16
#: Least hashes of a set by which near copies are linked ahead of the join.
FIRST = 4
_EDGE = 1e-9


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, min(SHINGLE, len(words)))) if words else np.zeros(0, dtype=np.uint64)


def similar(a: set[bytes], b: set[bytes], similarity: float = SIMILARITY) -> bool:
    """Whether the sets' Jaccard similarity is high enough."""
    common = len(a & b)
    return common >= similarity * (len(a) + len(b) - common) - _EDGE


def shingle_set(text: str | None) -> set[bytes]:
    words = words_of(text)
    size = min(SHINGLE, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the order, and whether they are common; `common` ascends, `ranks` are from 1 on."""
    n = len(hashes)
    size = n - int(np.ceil(SIMILARITY * n - _EDGE)) + 1 if n else 0
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    order = np.argsort(rank, kind="stable")[:size]
    return hashes[order], rank[order] > 0


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A set as bits, one for each shingle at least: how often a place is hit, modulo two."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    hits = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little")


def may_be_similar(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """Whether the bitmaps of sets of n and m shingles leave a similarity of SIMILARITY possible.

    The larger bitmap is folded to the size of the smaller, which is the bitmap its set would have there.
    """
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    apart = int(np.bitwise_count(a ^ b).sum())
    return apart <= (1 - SIMILARITY) / (1 + SIMILARITY) * (n + m) + _EDGE


def pairs_in(rows: np.ndarray) -> np.ndarray:
    """(a, b) of rows (shingle, node, size, place, group), sorted by shingle, that share one, are of different groups and
    may be similar."""
    found = [np.zeros((0, 2), dtype=np.int64)]
    for apart in range(1, len(rows)):
        x, y = rows[:-apart], rows[apart:]
        same = np.flatnonzero(x[:, 0] == y[:, 0])
        if not len(same):
            break
        x, y = x[same], y[same]
        short, long = np.minimum(x[:, 2], y[:, 2]), np.maximum(x[:, 2], y[:, 2])
        left = np.minimum(x[:, 2] - x[:, 3], y[:, 2] - y[:, 3])
        near = (short >= SIMILARITY * long - _EDGE) & (x[:, 4] != y[:, 4])
        near &= left >= SIMILARITY / (1 + SIMILARITY) * (short + long) - _EDGE
        x, y = x[near, 1], y[near, 1]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _common(documents: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's common shingles, ascending, and their ranks by number of documents. Bounded by COMMON."""
    share = min(1 / SAMPLE_EVERY, SAMPLE / max(total, 1))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1 << 40)) < int(share * (1 << 40))

    def start():
        return lambda columns: ((int(h),) for t in columns["text"] for h in shingles(t).view(np.int64))

    counted = over_rows(documents.where(drawn).select("text"), "shingle long", start).groupBy("shingle").count()
    top = counted.where(F.col("count") >= COMMON_DOCUMENTS).orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    known = np.array([r["shingle"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], (len(known) - np.arange(len(known)))[order]


def set_prints(documents: DataFrame, common: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """node, size, bits, firsts, known, least: each document's set as a bitmap, its first shingles in the order, which of
    them are common, and the set's least hashes."""
    order = documents.sparkSession.sparkContext.broadcast((common, ranks))
    schema = pa.schema([
        ("node", pa.int64()), ("size", pa.int32()), ("bits", pa.binary()), ("firsts", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())),
        ("least", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = order.value
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for a in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py()) for t in batch.column(1)[a : a + 256]]
                firsts = [prefix(s, last, rank) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(nodes[a : a + 256], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                    pa.array([f.view(np.int64) for f, _ in firsts], pa.list_(pa.int64())),
                    pa.array([k for _, k in firsts], pa.list_(pa.bool_())),
                    pa.array([x[:FIRST].view(np.int64) for x in sets], pa.list_(pa.int64())),
                ], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "node long, size int, bits binary, firsts array<long>, known array<boolean>, least array<long>"
    )


def first_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), each once: documents and the smallest one that has one of their least hashes too.

    The least hashes are drawn from the whole set, as the first shingles of the order are not: in a large group of near
    copies those that all have come last there, and what each has for itself first.
    """
    rows = prints.select("node", F.explode("least").alias("shingle"))
    least = rows.groupBy("shingle").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("shingle", "a")
    return rows.join(written(least, "first-shingles"), "shingle").where("a < node").select("a", F.col("node").alias("b")).distinct()


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, each once, from prints with a `group`: all of different groups whose similarity
    is high enough, and some others."""
    run_length, salts = RUN, SALTS
    found_schema = pa.schema([
        ("shingle", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("group", pa.int64()),
    ])

    def listed(pairs: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        no, nothing = pa.nulls(len(pairs), pa.int32()), pa.nulls(len(hot), pa.int64())
        empty = pa.nulls(len(pairs), pa.int64())
        return pa.Table.from_batches([
            pa.RecordBatch.from_arrays([empty, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), no, no, empty], schema=found_schema),
            pa.RecordBatch.from_arrays([
                pa.array(hot[:, 0]), pa.array(hot[:, 1]), nothing, pa.array(hot[:, 2].astype(np.int32)),
                pa.array(hot[:, 3].astype(np.int32)), pa.array(hot[:, 4]),
            ], schema=found_schema),
        ]).combine_chunks().to_batches()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_one = np.zeros((0, 5), dtype=np.int64), None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            rows, known = np.stack(columns, axis=1), batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            if hot_one is not None:
                known |= rows[:, 0] == hot_one
            hot, rows = rows[known], np.concatenate([held, rows[~known]])
            starts = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1)) if len(rows) else np.zeros(0, dtype=np.int64)
            lengths = np.diff(starts, append=len(rows))
            long = np.repeat(lengths > run_length, lengths)
            if len(lengths) and lengths[-1] > run_length:
                hot_one, cut = rows[-1, 0], len(rows)
            else:
                cut = int(starts[-1]) if len(starts) else 0
            done, held = rows[:cut], rows[cut:]
            yield from listed(pairs_in(done[~long[:cut]]), np.concatenate([hot, done[long[:cut]]]))
        yield from listed(pairs_in(held), np.zeros((0, 5), dtype=np.int64))

    rows = prints.select("node", "size", "group", F.posexplode(F.arrays_zip("firsts", "known")).alias("place", "one")).select(
        F.col("one.firsts").alias("shingle"), "node", "size", "place", "group", F.col("one.known").alias("common")
    )
    part = F.when(F.col("common"), F.pmod(F.xxhash64("node"), F.lit(salts))).otherwise(F.lit(0))
    found = written(
        rows.repartition("shingle", part).sortWithinPartitions("shingle").mapInArrow(
            pair, "shingle long, a long, b long, size int, place int, group long"
        ), "shared-shingles",
    )
    # A hot shingle of one group only has no pair to look for. In the others, one side of a pair is outside the group that
    # most of its documents are in.
    hot = found.where("shingle is not null")
    sizes = hot.groupBy("shingle", "group").agg(F.count("*").alias("rows"))
    groups = written(sizes.groupBy("shingle").agg(
        F.max_by("group", F.struct("rows", "group")).alias("most"), F.count("*").alias("groups")
    ).where("groups > 1").select("shingle", "most"), "hot-shingles")
    mixed = hot.join(groups, "shingle").select(
        "shingle", F.col("a").alias("x"), F.col("size").alias("n"), F.col("place").alias("i"), F.col("group").alias("g"), "most",
        F.pmod(F.xxhash64("a"), F.lit(salts)).alias("salt"),
    )
    minor = mixed.where("g <> most").select(
        "shingle", F.col("x").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("g").alias("h"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
    )
    t = SIMILARITY
    near = mixed.join(minor, ["shingle", "salt"]).where(
        (F.col("g") != F.col("h")) & ((F.col("g") == F.col("most")) | (F.col("x") < F.col("y")))
        & (F.least("n", "m") >= t * F.greatest("n", "m") - _EDGE)
        & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= t / (1 + t) * (F.col("n") + F.col("m")) - _EDGE)
    ).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return found.where("shingle is null").select("a", "b").union(near).distinct()


def verified(pairs: DataFrame, prints: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents are similar enough: by their bitmaps first, then by their words.

    Texts go only to pairs that the bitmaps leave, which hardly differ in more shingles than similar ones do.
    """
    def sides(table: DataFrame, node: str, *columns: str) -> tuple[DataFrame, DataFrame]:
        return tuple(table.select(F.col(node).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "ab")

    def sift():
        def rows(columns):
            for a, b, *rest in zip(*(columns[c] for c in ("a", "b", "bits_a", "bits_b", "size_a", "size_b")), strict=True):
                bits = [np.frombuffer(x, dtype=np.uint8) for x in rest[:2]]
                if may_be_similar(*bits, *rest[2:]):
                    yield a, b
        return rows

    left, right = sides(prints, "node", "bits", "size")
    sized = pairs.join(left, "a").join(right, "b")
    short, long = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    likely = written(over_rows(sized.where(short >= SIMILARITY * long - _EDGE), "a long, b long", sift), "likely-pairs")
    ids = few_or_shuffled(likely.select(F.explode(F.array("a", "b")).alias("_own")).distinct())
    texts = written(documents.join(ids, F.col("doc_id") == F.col("_own"), "left_semi").select("doc_id", "text"), "candidates")

    def start():
        def rows(columns):
            held, own = None, set()
            for a, b, text_a, text_b in zip(columns["a"], columns["b"], columns["text_a"], columns["text_b"], strict=True):
                if held is None or text_a != held:
                    held, own = text_a, shingle_set(text_a)
                if similar(own, shingle_set(text_b)):
                    yield a, b
        return rows

    left, right = sides(texts, "doc_id", "text")
    return over_rows(likely.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), "a long, b long", start)


def similar_pairs(documents: DataFrame, total: int) -> DataFrame:
    """Links (a, b) that join all documents of distinct ids whose similarity is high enough, directly or by others."""
    prints = written(set_prints(documents, *_common(documents, total)), "set-prints")
    links = written(verified(first_links(prints), prints, documents), "first-links")
    groups = written(components(links), "groups").select("node", F.col("component").alias("group"))
    grouped = prints.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    pairs = written(candidates(grouped), "pairs")
    return links.union(verified(pairs, prints, documents))


def near_copies(documents: DataFrame) -> DataFrame:
    """A row per row of the documents with an id: doc_id, component_id.

    Documents whose sets of SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more are linked;
    component_id is the smallest doc_id that can be reached, the document's own included. Texts of the same words,
    A to Z in either case, are linked, null and empty ones among them. Rows with a null doc_id link nothing. Other
    columns are ignored.
    """
    documents = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def start():
        return lambda columns: (
            (i, xxhash.xxh3_128_digest(b" ".join(words_of(t)))) for i, t in zip(columns["doc_id"], columns["text"], strict=True)
        )

    prints = written(over_rows(documents, "doc_id long, digest binary", start), "texts")
    firsts = prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    again = firsts.where("n > 1").select(F.col("digest").alias("_digest"), "least")
    own = written(prints.join(again, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", F.coalesce("least", "doc_id").alias("least")
    ), "first-texts")
    copies = own.groupBy("doc_id").agg(F.max("least").alias("least")).where("least < doc_id").select("doc_id")
    parts = components(similar_pairs(without(documents, copies), own.count()))
    return own.join(parts, own["least"] == parts["node"], "left").select(
        "doc_id", F.coalesce("component", "least").alias("component_id")
    )

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from headway.llm import sharding
from headway.llm.sharding import Shard, even_tree, shard_documents, shard_of


def test_messy_rows(messy):
    rows = shard_documents(messy).collect()
    assert len(rows) == 13
    want = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in messy.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    shards = {}
    for r in rows:
        assert shards.setdefault(r["doc_id"], r["shard"]) == r["shard"]


def test_growth_takes_rows_only_into_the_new_shard(spark):
    ids = spark.range(20_000).select(
        shard_of(F.col("id").cast("string"), even_tree(16)).alias("old"), shard_of(F.col("id").cast("string"), even_tree(16, 1)).alias("new")
    )
    moved = Counter((r["old"], r["new"]) for r in ids.collect())
    assert all(a == b or b == 16 for a, b in moved)
    grown = sum(n for (_, b), n in moved.items() if b == 16)
    assert abs(grown - 20_000 / 17) < 5 * (20_000 / 17) ** 0.5


def test_weights_and_confined_movement(spark):
    """A heavier shard takes its share; draws inside other racks and regions stay."""
    tree = [Shard(n, f"r{n // 4}", f"k{n // 2 % 2}", 1.0 + (n == 5)) for n in range(8)]
    even = [Shard(s.number, s.region, s.rack) for s in tree]
    rows = spark.range(30_000).select(
        shard_of(F.col("id").cast("string"), even).alias("old"), shard_of(F.col("id").cast("string"), tree).alias("new")
    ).collect()
    share = sum(r["new"] == 5 for r in rows) / len(rows)
    assert abs(share - 2 / 9) < 0.015
    # Region r1 (4 to 7) grew: nothing moves within r0 or out of r1, nor from rack k0 of r1 to k1.
    for r in rows:
        if r["old"] != r["new"]:
            assert r["new"] >= 4 and not (r["old"] in (4, 5) and r["new"] in (6, 7))


def test_numbering_of_one_hot_group(spark):
    rows = spark.range(5_000).select(F.lit(3).alias("g"), F.col("id").alias("k"))
    assert sorted(r["slot"] for r in sharding.numbered(rows, "g", ["k"], 16).collect()) == list(range(5_000))


def test_bad_trees_and_no_rows(documents):
    with pytest.raises(ValueError, match="weight"):
        shard_of(F.lit("x"), [Shard(0, "r", "k", 0.0)])
    with pytest.raises(ValueError, match="shards"):
        shard_of(F.lit("x"), [])
    assert shard_documents(documents([])).count() == 0


def plain_shard(key, tree):
    """The tree walked from its root in plain Python: region, then rack, then shard."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.encode(), 42)

    def draw(node, weight):
        uniform = ((xxhash.xxh64_intdigest(node.encode(), seed) >> 11) + 0.5) * 2.0**-53
        return -math.log(uniform) / weight

    def weight(inside):
        return sum(s.weight for s in tree if inside(s))

    region = min(
        dict.fromkeys(s.region for s in tree), key=lambda r: draw(r, weight(lambda s: s.region == r))
    )
    rack = min(
        dict.fromkeys(s.rack for s in tree if s.region == region),
        key=lambda k: draw(f"{region}/{k}", weight(lambda s: (s.region, s.rack) == (region, k))),
    )
    own = [s for s in tree if (s.region, s.rack) == (region, rack)]
    return min(own, key=lambda s: draw(f"{region}/{rack}/{s.number}", s.weight)).number


def test_shards_against_a_plain_walk(documents):
    rows = shard_documents(documents([(i, f"text {i}") for i in range(-50, 400)] + [(None, "x")])).collect()
    for r in rows:
        key = None if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (plain_shard(key, even_tree(16)), plain_shard(key, even_tree(16, 1)))


def test_uneven_trees_against_a_plain_walk(spark):
    tree = [Shard(n, f"r{n % 3}", f"k{n % 5 % 2}", 0.5 + n) for n in range(11)]
    found = spark.range(500).select(F.col("id"), shard_of(F.col("id").cast("string"), tree).alias("shard")).collect()
    assert [r["shard"] for r in found] == [plain_shard(str(r["id"]), tree) for r in found]

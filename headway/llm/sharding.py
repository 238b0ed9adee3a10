"""Documents to shards by a hierarchical weighted hash tree, with DataFrame functions only.

At each level every child of the chosen node draws -ln(u) / weight, u from a hash of id and
child, and the least draw wins. A child's weight is the sum of its shards' weights. When
weights change, a document moves only towards a subtree whose share grew or away from
one whose share shrank; draws below other nodes stay as they are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, the names of its region and rack, and its weight."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, grown: int = 0, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """`shards` equal shards laid out in racks and regions, then `grown` later ones.

    Each later shard forms a region of its own, so that its subtree is the only one whose weight
    rises: it takes documents from all others, and none moves between those.
    """
    first = [
        Shard(n, f"region{n // (racks * per_rack)}", f"rack{n // per_rack % racks}") for n in range(shards)
    ]
    return first + [Shard(n, f"added{n}", "rack0") for n in range(shards, shards + grown)]


def _least(draws: list[tuple[Column, Column]]) -> Column:
    """The outcome that belongs to the least draw; the first of equal ones."""
    if len(draws) == 1:
        return draws[0][1]
    return F.array_min(F.array(*[
        F.struct(draw.alias("draw"), F.lit(i).alias("at"), outcome.alias("outcome"))
        for i, (draw, outcome) in enumerate(draws)
    ]))["outcome"]


def _draw(key: Column, node: str, weight: float) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(weight)


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard of a key. A null key is a key like any other. Shards need positive weights."""
    if not tree or any(not (s.weight > 0 and math.isfinite(s.weight)) for s in tree):
        raise ValueError("a tree needs shards, all of positive finite weight")
    regions: dict[str, dict[str, list[Shard]]] = defaultdict(lambda: defaultdict(list))
    for shard in tree:
        regions[shard.region][shard.rack].append(shard)
    by_region = []
    for region, racks in regions.items():
        by_rack = []
        for rack, leaves in racks.items():
            place = f"{region}/{rack}"
            leaf = _least([(_draw(key, f"{place}/{s.number}", s.weight), F.lit(s.number)) for s in leaves])
            by_rack.append((_draw(key, place, sum(s.weight for s in leaves)), leaf))
        weight = sum(s.weight for leaves in racks.values() for s in leaves)
        by_region.append((_draw(key, region, weight), _least(by_rack)))
    return _least(by_region)


def numbered(df: DataFrame, group: str, order: Sequence[str], parts: int) -> DataFrame:
    """Adds `slot`, gapless from 0 within each group, without sorting a whole group in one task.

    A group's rows are dealt by a hash of `order` into `parts` parts; each part is numbered on
    its own and starts where the parts before it end. Rows that are equal in `order` get any order.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    own = Window.partitionBy(group, "_part").orderBy(*order)
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1)
    joined = ranked.join(starts, (ranked[group] == starts["_group"]) & (ranked["_part"] == starts["_p"]))
    return joined.withColumn("slot", F.col("_start") + F.col("_own")).select(*df.columns, "slot")


def shard_documents(documents: DataFrame, shards: int = 16, parts: int = 256) -> DataFrame:
    """One row per document: its size, checksum, shard, place in the shard, and shard after growth by one.

    Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one. Only doc_id and the number of
    shards decide (law `key`): rows that share a doc_id share a shard, a null doc_id has one too. Other
    columns are ignored; an empty table gives an empty one. `parts` bounds what one task numbers.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.col("doc_id").cast("string")
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, even_tree(shards)).alias("shard"),
        shard_of(key, even_tree(shards, 1)).alias("grown_shard"),
    )
    slots = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], parts)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

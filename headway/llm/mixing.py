"""A mixture of sources that meets target weights, fitted by counts of lengths.

Documents are counted by their exact length per source. What a source has to give beyond whole passes is a sum
of a subset of its documents: most of it is spread evenly over the lengths, and a bounded knapsack over what is
left of each length closes the remaining budget. Which documents of a length are taken is drawn by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Words that the knapsack fits. All longer budgets are first brought down to it.
LAST_BUDGET = 1 << 14
#: Parts of the draw. Documents of one length of one source are ranked within a part only.
DRAWS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(
    documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 42
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Sources in code-point order, null last and a source of its own, get `weights` in turn and share `share` of all
    words by them; no target is above `most` times its source's words, and the excess is shared again. `size` is the
    document's number of words, 0 for a null text; `taken` is `size` times the passes that the mix makes over it,
    `most` at most. Draws depend on seed and doc_id alone, so rows that repeat a doc_id, or have none, are told
    apart only by their length and source; which of equals is taken twice is then left open, how many is not. A
    table without rows gives none. Other columns are ignored.
    """
    sized = written(documents.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), word_count(F.col("text")).alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(DRAWS)).cast("int").alias("draw"),
        F.xxhash64(F.lit(seed + 1), "doc_id").alias("place"),
    ), "sized")
    tally = written(sized.groupBy("key", "size", "draw").agg(F.count("*").alias("n")), "tally")
    targets = written(source_targets(
        tally.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most
    ), "targets")
    whole = F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(most))
    targets = targets.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int"))
    lengths = tally.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n"))
    budgets = lengths.join(targets.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")), "key")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        extra = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["budget"].iloc[0]), seed)
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "extra": extra})

    extras = written(budgets.groupBy("key").applyInPandas(plan, "key string, size long, extra long"), "extras")
    before = Window.partitionBy("key", "size").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))
    quotas = tally.join(extras.where("extra > 0"), ["key", "size"]).withColumn("quota", F.least(left, F.col("n"))).where("quota > 0")
    dealt = sized.join(quotas.select("key", "size", "draw", "quota", "n"), ["key", "size", "draw"], "left")
    among = Window.partitionBy("key", "size", "draw").orderBy("place", "doc_id")
    drawn = dealt.where("quota < n").withColumn("more", (F.row_number().over(among) <= F.col("quota")).cast("int"))
    rest = dealt.where("quota IS NULL OR quota = n").withColumn("more", F.col("quota").isNotNull().cast("int"))
    mixed = drawn.unionByName(rest).join(targets, "key")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"))


def source_targets(totals: DataFrame, weights: Sequence[int], share: Fraction, most: int) -> DataFrame:
    """(key, source_size, target) from (key, source_size); an empty key is the null source and comes last.

    The level, words for each unit of weight, rises in rounds of one aggregation until no source below its limit would
    get more than that; only sums come to the driver.
    """
    ranged = written(
        totals.repartitionByRange(F.col("key") == "", "key").sortWithinPartitions(F.col("key") == "", "key")
        .withColumn("part", F.spark_partition_id()), "sources"
    )
    parts = ranged.groupBy("part").agg(F.count("*").alias("k"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the sort
    starts = parts.select("part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(F.col("key") == "", "key")
    numbered = ranged.join(starts, "part").withColumn("number", F.col("start") + F.row_number().over(within) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = written(numbered.select("key", "source_size", weight.cast("long").alias("weight")), "weights")

    def sums(rows: DataFrame) -> tuple[int, int]:
        row = rows.agg(F.sum("source_size"), F.sum("weight")).first()
        return int(row[0] or 0), int(row[1] or 0)

    size, weight = sums(weighed)
    full, before = (0, 0), None
    level, limited = Fraction(0), F.lit(False)
    while weight and full != before:
        level = (share * size - most * full[0]) / (weight - full[1])
        number, divisor = (F.lit(str(x)).cast("decimal(38,0)") for x in (level.numerator, level.denominator * most))
        limited = F.col("weight") * number > F.col("source_size") * divisor
        before, full = full, sums(weighed.where(limited))
    given = F.lit(None).cast("double")
    for w in sorted(set(weights)):
        given = F.when(F.col("weight") == w, F.lit(float(level * w))).otherwise(given)
    return weighed.select(
        "key", "source_size", F.when(limited, (F.col("source_size") * most).cast("double")).otherwise(given).alias("target")
    )


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float, seed: int = 42) -> np.ndarray:
    """How many documents of each size to take, `counts` at most, so that their words come next to the budget."""
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    taken = np.zeros(len(sizes), dtype=np.int64)
    left = round(budget)
    if left <= 0 or not len(sizes):
        return taken
    order = sorted(range(len(sizes)), key=lambda i: _mixed(int(sizes[i]), seed))
    # Every length gives its share; what it can't give in whole documents goes on to the next.
    share, carry = min(1.0, budget / float((sizes * counts).sum())), 0.0
    for i in order:
        carry += share * float(sizes[i] * counts[i])
        taken[i] = min(counts[i], int(carry // sizes[i]))
        carry -= float(taken[i] * sizes[i])
    left -= int((taken * sizes).sum())
    last = max(LAST_BUDGET, min(8 * int(sizes.min()), 1 << 22))
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if left > last and size <= left:
            k = min(int(counts[i] - taken[i]), left // size, -(-(left - last) // size))
            taken[i] += k
            left -= k * size
    # Documents given back, one of each length in turn, leave the knapsack a choice of sums.
    more = True
    while more:
        more = False
        for i in order:
            size = int(sizes[i])
            if taken[i] and (left + size <= last or left < 0):
                taken[i] -= 1
                left += size
                more = True
    return taken + _knapsack(sizes, counts - taken, left, order)


def _knapsack(sizes: np.ndarray, free: np.ndarray, budget: int, order: list[int]) -> np.ndarray:
    """How many of each size, `free` at most, sum up next to the budget; the lower of two sums equally near.

    A sum above twice the budget is further away than none, so sums up to there are tried.
    """
    top = 2 * budget
    chosen = np.zeros(len(sizes), dtype=np.int64)
    if budget <= 0:
        return chosen
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    by = np.full(top + 1, -1, dtype=np.int32)
    items: list[tuple[int, int]] = []
    for i in order:
        size, many, step = int(sizes[i]), min(int(free[i]), top // int(sizes[i])), 1
        while many and not reached[budget]:
            step = min(step, many)
            many -= step
            width = step * size
            if width <= top:
                new = reached[: top + 1 - width] & ~reached[width:]
                at = np.flatnonzero(new) + width
                reached[at] = True
                by[at] = len(items)
                items.append((i, step))
            step *= 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, step = items[by[at]]
        chosen[i] += step
        at -= step * int(sizes[i])
    return chosen


def _mixed(value: int, seed: int) -> int:
    """A fixed random-looking number for a value."""
    x = (value * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    return x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF

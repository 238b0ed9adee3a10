"""Positions along a path by parametric interpolation.

The points of a path are evenly spaced on a 0-100 % axis. Paths of up to four
points are interpolated linearly, longer ones by a cubic spline with not-a-knot
ends. A path is fitted once: `bends` gives the second derivative at each point
(per point index), and `with_curve` evaluates the curve with column expressions.
All-zero bends make it the linear interpolation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

LONGEST_LINEAR = 4


def solve_ragged(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot splines through rows of so many of the values each, one after the other.

    Unknowns m satisfy m[i-1] + 4 m[i] + m[i+1] = 6 (y[i-1] - 2 y[i] + y[i+1]).
    Not-a-knot ends make m linear over the first and the last three points, which
    fixes m[1] and m[n-2] directly and leaves a tridiagonal system between them.
    Its pivots are the same for all rows, so a step is one for all rows that have it, the longest ones first.
    """
    bends = np.zeros(len(values))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > LONGEST_LINEAR]
    if not len(order):
        return bends
    first, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
    last, inner = first + n - 1, n - 4  # points 2 .. n-3
    rhs = np.zeros(len(values))
    rhs[1:-1] = 6.0 * (values[:-2] - 2.0 * values[1:-1] + values[2:])  # at a row's ends of no use
    bends[first + 1] = rhs[first + 1] / 6.0
    bends[last - 1] = rhs[last - 1] / 6.0
    rhs[first + 2] -= bends[first + 1]
    rhs[last - 2] -= bends[last - 1]
    steps = int(inner[0])
    longer = np.searchsorted(-inner, -np.arange(steps + 1), side="left")  # rows that have a step
    pivot = np.empty(steps)
    pivot[0] = 4.0
    for i in range(1, steps):
        pivot[i] = 4.0 - 1.0 / pivot[i - 1]
        at = first[:longer[i]] + (2 + i)
        rhs[at] -= rhs[at - 1] / pivot[i - 1]
    for i in range(steps - 1, -1, -1):
        at = first[:longer[i]] + (2 + i)
        solved, more = rhs[at], longer[i + 1]
        solved[:more] -= bends[at[:more] + 1]
        bends[at] = solved / pivot[i]
    bends[first] = 2.0 * bends[first + 1] - bends[first + 2]
    bends[last] = 2.0 * bends[last - 1] - bends[last - 2]
    return bends


def solve_bends(values: np.ndarray) -> np.ndarray:
    """`solve_ragged` for the rows of `values`."""
    rows, n = values.shape
    return solve_ragged(np.ascontiguousarray(values).reshape(-1), np.full(rows, n)).reshape(rows, n)


@arrow_udf(T.ArrayType(T.DoubleType()))
def bends(values: pa.Array) -> pa.Array:
    """Bends of each row's points; the rows of a batch are solved together."""
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    solved = solve_ragged(values.flatten().to_numpy(zero_copy_only=False), lengths)
    missing = np.append(values.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=missing), pa.array(solved))


def with_piece(df: DataFrame, values: str, percent: Column) -> DataFrame:
    """Adds `_left` (piece of the curve through `values`, from 0) and `_t` (place in it, 0 to 1).

    Each step is a projection of its own. Written as one expression, the parts that occur
    again and again would make the generated code too long for the JVM to compile.
    """
    placed = df.withColumn("_last", F.size(values) - 1)
    placed = placed.withColumn("_u", percent / F.lit(100.0) * F.col("_last"))
    left = F.greatest(F.least(F.floor("_u").cast("int"), F.col("_last") - 1), F.lit(0))
    placed = placed.withColumn("_left", left)
    return placed.withColumn("_t", F.col("_u") - F.col("_left")).drop("_last", "_u")


def with_curve(df: DataFrame, out: str, values: str, bent: str) -> DataFrame:
    """Adds `out`, the value of the curve at the place given by `_left` and `_t`.

    A path of one point has its only value everywhere.
    """
    right = F.least(F.col("_left") + 1, F.size(values) - 1)
    ends = df.withColumns({
        "_y0": F.get(values, F.col("_left")), "_y1": F.get(values, right),
        "_m0": F.get(bent, F.col("_left")), "_m1": F.get(bent, right),
    }).withColumn("_s", F.lit(1.0) - F.col("_t"))
    t, s = F.col("_t"), F.col("_s")
    value = (
        s * F.col("_y0") + t * F.col("_y1")
        + ((s * s * s - s) * F.col("_m0") + (t * t * t - t) * F.col("_m1")) / F.lit(6.0)
    )
    return ends.withColumn(out, value).drop("_y0", "_y1", "_m0", "_m1", "_s")

"""Column functions without time: rounding, labels, missions, direction, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.model import INBOUND_MISSIONS, MISSION_SERVICE, MISSION_TERMINUS, MISSION_VIA


def round_half_even(col: Column, decimals: int = 1) -> Column:
    return F.bround(col, decimals)


def short_label(col: Column, longest: int = 16, kept: int = 12) -> Column:
    """Labels above `longest` characters are cut to `kept` characters and an ellipsis."""
    return F.when(F.length(col) > longest, F.concat(F.substring(col, 1, kept), F.lit("..."))).otherwise(col)


def direction(mission: Column, inbound=INBOUND_MISSIONS) -> Column:
    """+1 towards Paris, -1 otherwise, NULL missions included."""
    return F.when(mission.isin(*inbound), F.lit(1)).otherwise(F.lit(-1))


def _within_percent(share: Column) -> Column:
    """`share` limited to [0, 100]; NULL stays NULL, which `greatest` and `least` would not do."""
    return F.when(share < 0.0, F.lit(0.0)).when(share > 100.0, F.lit(100.0)).otherwise(share)


def progress_percent(now: Column, departure: Column, arrival: Column) -> Column:
    """Share of a leg covered at `now`, in [0, 100]; NULL for a leg of no duration."""
    share = F.try_divide(F.lit(100.0) * F.abs(now - departure), F.abs(arrival - departure))
    return _within_percent(share)


def percent_elapsed(now: Column, departure: Column, arrival: Column) -> Column:
    """`progress_percent` at any instant: 0 before the departure, 100 after the arrival."""
    share = F.try_divide(F.lit(100.0) * (now - departure), arrival - departure)
    return _within_percent(share)


def between_points(start: Column, end: Column, percent: Column) -> Column:
    """Point of the straight line from `start` to `end`."""
    return start + (percent / F.lit(100.0)) * (end - start)


def _lookup(values: dict[str, str], letter: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, letter)


def mission_terminus(mission: Column) -> Column:
    return _lookup({k: v[0] for k, v in MISSION_TERMINUS.items()}, F.substring(mission, 1, 1))


def mission_lines(mission: Column) -> Column:
    """Sub-lines of the mission's terminus, as an array."""
    joined = _lookup({k: ",".join(v[1]) for k, v in MISSION_TERMINUS.items()}, F.substring(mission, 1, 1))
    return F.split(joined, ",")


def mission_service(mission: Column) -> Column:
    return _lookup(MISSION_SERVICE, F.substring(mission, 2, 1))


def mission_via(mission: Column) -> Column:
    return _lookup(MISSION_VIA, F.substring(mission, 3, 1))

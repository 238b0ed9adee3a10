"""The two reports, from decoded departures to published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.clock import instant
from headway.model import Settings
from headway.operators.awt import last_window_counts, with_awt
from headway.operators.dedup import dedup_departures, distinct_stops
from headway.operators.filters import around_instant, realtime_only, with_epoch
from headway.operators.positions import with_position
from headway.operators.progress import PROGRESS_COLUMNS, trains_under_way


def awt_range(as_of, settings: Settings = Settings()) -> tuple[Column, Column]:
    """Instants between which `last_hour_awt` needs the departures."""
    now = instant(as_of)
    return now - F.expr(f"interval {settings.window_minutes + 2 * settings.slide_minutes} minutes"), now


def progress_range(as_of, settings: Settings = Settings()) -> tuple[Column, Column]:
    """Instants between which `train_progress` needs the departures."""
    now, half = instant(as_of), F.expr(f"interval {settings.around_seconds // 2 + 1} seconds")
    return now - half, now + half


def last_hour_awt(
    departures: DataFrame, as_of=None, settings: Settings = Settings(), keys=("station",), order_by=None,
    policy: str = "latest", decimals: int = 1,
) -> DataFrame:
    """Waiting times `keys, window, nt, awt` in the last complete window.

    The time filter is on a key of the repeats, so Spark moves it below their removal.
    """
    unique = dedup_departures(departures, order_by=order_by)
    counts = last_window_counts(
        unique, as_of, keys, "timestamp", settings.window_minutes, settings.slide_minutes, policy
    )
    return with_awt(counts, settings.window_minutes, decimals)


def train_stops(departures: DataFrame, as_of=None, settings: Settings = Settings(), order_by=None) -> DataFrame:
    """Distinct real-time stops around `as_of`, in epoch seconds.

    The time filter comes first (it is on a key of the repeats), the mode filter after
    the repeats are removed: the first record of a departure decides its mode.
    """
    near = around_instant(departures, as_of, settings.around_seconds)
    unique = dedup_departures(near, order_by=order_by)
    # By train from here on: the distinct stops and the order of a train's stops share the shuffle.
    return distinct_stops(with_epoch(realtime_only(unique)).repartition("train"))


def train_progress(
    departures: DataFrame, stations: DataFrame, fitted: DataFrame | None = None, as_of=None,
    settings: Settings = Settings(), order_by=None, accurate: bool = True, salts: int = 1,
) -> DataFrame:
    """The published table of trains under way, 17 columns.

    Repeats are gone and the range is `around_seconds`, so the stops of a train are at most
    one per second of that range and its window stays small.
    """
    stops = train_stops(departures, as_of, settings, order_by)
    coarse = trains_under_way(stops, stations, as_of, settings.inbound_missions, salts=salts)
    return with_position(coarse, fitted, accurate, salts).select(*PROGRESS_COLUMNS)

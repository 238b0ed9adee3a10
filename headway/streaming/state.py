"""Stateful steps of streams: sliding windows from the counts of their panes, and legs that follow late stops.

Both keep little per key. They need the RocksDB state store, which `with_rocksdb` sets for the session.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import gcd

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- windows from panes ------------------------------------------------------------

class PaneRing(StatefulProcessor):
    """Emits each window of a key once the watermark has passed its end, from the counts of its panes.

    The state is one row per key: the counts of the panes that windows still to come reach into, and the start of the
    next such window. One timer per key stands at that window's end.
    """

    def __init__(self, key: str, length: int, slide: int):
        self.key, self.length, self.slide = key, length, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "starts array<bigint>, counts array<bigint>, next bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key, [(r["pane"], r["n"]) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues, fired=expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, new, timerValues, fired: int | None = None) -> Iterator[Row]:
        counts: dict[int, int] = {}
        following, timer = None, None
        if self.ring.exists():
            starts, stored, following, timer = self.ring.get()
            counts = dict(zip(starts, stored, strict=True))
        for pane, n in new:
            counts[pane] = counts.get(pane, 0) + n
        closed = timerValues.getCurrentWatermarkInMs() // 1000
        coming = (closed - self.length) // self.slide * self.slide + self.slide  # the first window that isn't closed
        panes = sorted(counts)
        first = (panes[0] - self.length) // self.slide * self.slide + self.slide if panes else coming
        start = first if following is None else max(first, following)
        while start < coming and panes:
            inside = [counts[p] for p in panes[bisect_left(panes, start) : bisect_left(panes, start + self.length)]]
            if inside:
                yield Row(**{self.key: key[0], "window_start": start, "window_end": start + self.length, "nt": sum(inside)})
                start += self.slide
            else:  # nothing until the next pane
                ahead = panes[bisect_left(panes, start) :]
                start = max(start + self.slide, (ahead[0] - self.length) // self.slide * self.slide + self.slide) if ahead else coming
        kept = [p for p in panes if p >= coming]
        due = max(coming, (kept[0] - self.length) // self.slide * self.slide + self.slide) + self.length if kept else None
        if timer is not None and timer * 1000 != fired and timer != due:
            self.handle.deleteTimer(timer * 1000)
        if due is None:
            self.ring.clear()
            return
        if timer != due or fired == due * 1000:
            self.handle.registerTimer(due * 1000)
        self.ring.update((kept, [counts[p] for p in kept], coming, due))


def windows_by_panes(departures: DataFrame, key: str = "station", ts: str = "timestamp", window_minutes: int = 60,
                     slide_minutes: int = 2, watermark: str | None = "1 minutes") -> DataFrame:
    """`key, window_start, window_end, nt` of a stream: every sliding window that has rows, once it is closed.

    A first step counts rows in tumbling panes; a second keeps the panes of the windows still open. A row is counted
    once and moved once, where Spark's own sliding window copies it into each of the window_minutes / slide_minutes
    windows that hold it, in the shuffle and in the state. watermark: None for a stream that has one on `ts`.
    """
    length, slide = 60 * window_minutes, 60 * slide_minutes
    pane = gcd(length, slide)
    delayed = departures.withWatermark(ts, watermark) if watermark else departures
    panes = delayed.groupBy(key, F.window(ts, f"{pane} seconds")).agg(F.count(F.lit(1)).alias("n"))
    rows = panes.select(key, F.window_time("window").alias("at"), F.unix_seconds("window.start").alias("pane"), "n")
    types = dict(rows.dtypes)
    return rows.groupBy(key).transformWithState(
        PaneRing(key, length, slide), f"{key} {types[key]}, window_start bigint, window_end bigint, nt bigint", "append", "eventTime"
    )


# --- legs -------------------------------------------------------------------------

class Legs(StatefulProcessor):
    """Keeps a train's stops in order, in spans of time, and emits the legs that new stops make or change.

    A stop between two known ones splits their leg: both parts come out, the first as a later version of the old leg.
    Spans that ended more than `keep_s` before the watermark are dropped, but for the last of them, whose last stop may
    still get a next one. Stops that late no longer change what was emitted.
    """

    def __init__(self, span_s: int, keep_s: int):
        self.span_s, self.keep_s = span_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span bigint", "departures array<bigint>, stations array<int>")
        self.version = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        come: dict[int, set] = {}
        for r in rows:
            departure = r["departure"]
            come.setdefault(departure // self.span_s, set()).add((departure, r["station"]))
        known = {k[0] for k in self.spans.keys()}
        fresh, held, read = set(), {}, {}

        def stored(span: int) -> list[tuple[int, int]]:
            """The span's stops before these rows; each call of the state is a message, so a span is asked for once."""
            if span not in read:
                read[span] = list(zip(*self.spans.getValue((span,)), strict=True)) if span in known else []
            return read[span]

        for span, stops in come.items():
            before = stored(span)
            stops -= set(before)
            if not stops:
                continue
            fresh |= stops
            held[span] = sorted([*before, *stops])
            self.spans.updateValue((span,), ([d for d, _ in held[span]], [s for _, s in held[span]]))
            if span not in known:
                self.handle.registerTimer(((span + 1) * self.span_s + self.keep_s) * 1000)
        if not fresh:
            return
        version = (self.version.get()[0] if known else 0) + 1
        self.version.update((version,))
        order = sorted(known | set(held))
        place = {span: i for i, span in enumerate(order)}
        near = {x for span in held for x in order[max(0, place[span] - 1) : place[span] + 2]}
        at_hand = {span: held.get(span) or stored(span) for span in sorted(near)}
        stops = [s for own in at_hand.values() for s in own]
        bounds = {own[-1]: place[span] for span, own in at_hand.items()}
        for i, stop in enumerate(stops):
            following = stops[i + 1] if i + 1 < len(stops) else None
            if stop in bounds:  # the next span may not be at hand: then nothing changes at this end
                j = bounds[stop] + 1
                if j < len(order) and order[j] not in near:
                    continue
            if stop in fresh or following in fresh:
                departure, station = stop
                yield Row(
                    train=key[0], station=station, departure=departure, next_departure=following and following[0],
                    next_station=following and following[1], time_to_st=following and following[0] - departure, version=version,
                )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs() // 1000 - self.keep_s
        old = sorted(k[0] for k in self.spans.keys() if (k[0] + 1) * self.span_s <= closed)
        for span in old[:-1]:
            self.spans.removeKey((span,))
        yield from ()


def leg_updates(stops: DataFrame, span_s: int = 86400, keep_s: int = 86400, watermark: str = "8 hours") -> DataFrame:
    """`train, station, departure, next_departure, next_station, time_to_st, version` from a stream of unique stops.

    stops: `train, station, departure` in epoch seconds, without repeats of a stop. Only legs that a batch makes or
    changes come out; of a stop's legs the one with the highest version holds.
    """
    rows = stops.select("train", "station", "departure", F.timestamp_seconds("departure").alias("at")).withWatermark("at", watermark)
    schema = (
        "train string, station int, departure bigint, next_departure bigint, next_station int, time_to_st bigint, version bigint"
    )
    return rows.groupBy("train").transformWithState(Legs(span_s, keep_s), schema, "update", "eventTime")


def current_legs(updates: DataFrame) -> DataFrame:
    """The legs that hold, of the updates of all batches."""
    leg = F.max_by(F.struct("next_departure", "next_station", "time_to_st"), "version").alias("leg")
    return updates.groupBy("train", "station", "departure").agg(leg).select("station", "train", "departure", "leg.*")

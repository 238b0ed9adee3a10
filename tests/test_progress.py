"""Legs, progress and the published table."""

import random

import pytest
from pyspark.sql import functions as F

from headway.functions.scalars import direction, progress_percent
from headway.model import STATION, Settings
from headway.operators.dims import attach, with_station
from headway.operators.filters import around, around_instant, by_direction, in_progress, known_terminus, realtime_only
from headway.operators.progress import PROGRESS_COLUMNS, next_stop
from headway.plans.reports import train_progress, train_stops

STOPS = "train string, departure long, station int"


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("span", [1, 7, 50, 10**6])
def test_spans_give_the_same_legs(make, span):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-20, 200), rng.randrange(3)) for _ in range(150)]
    rows += [("hot", i, i % 2) for i in range(300)] + [("single", 3, 1)]
    df = make(list(rows), STOPS)
    assert as_set(next_stop(df)) == as_set(next_stop(df, span_s=span))


def test_what_nobody_asks_for_is_left_out_of_the_shuffles(make):
    """Links across spans carry the next station only, where only stations are asked for; no structs travel."""
    stops = make([("7", 1, 10), ("7", 2, 200), ("7", 3, 210), ("8", 4, 5)], "train string, station int, departure long")
    legs = next_stop(stops, span_s=100).select("station", "next_station")
    plan = legs._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan and "next_departure" not in plan
    assert sorted((r[0], r[1] or 0) for r in legs.collect()) == [(1, 2), (2, 3), (3, 0), (4, 0)]


def test_next_stop_values(make):
    df = make([("a", 30, 3), ("a", 10, 1), ("a", 20, 2)], STOPS)
    got = {(r.station, r.next_station, r.next_departure, r.time_to_st) for r in next_stop(df).collect()}
    assert got == {(1, 2, 20, 10), (2, 3, 30, 10), (3, None, None, None)}


def test_in_progress_keeps_both_ends(make):
    legs = make(
        [("past", 80, 90), ("ends", 90, 100), ("runs", 90, 110), ("starts", 100, 110), ("future", 101, 110), ("last", 90, None)],
        "train string, departure long, next_departure long",
    )
    assert {r.train for r in in_progress(legs, 100).collect()} == {"ends", "runs", "starts"}


def test_progress_is_clamped_and_guarded(spark):
    df = spark.createDataFrame([(0, 10, 5), (0, 10, 30), (0, 0, 5), (0, 10, 0)], "d long, a long, now long")
    got = [r[0] for r in df.select(progress_percent(F.col("now"), F.col("d"), F.col("a"))).collect()]
    assert got == [50.0, 100.0, None, 0.0]


def test_direction(spark):
    df = spark.createDataFrame([("PALS",), ("POPE",), ("UEGE",), (None,)], "mission string")
    assert [r[0] for r in df.select(direction(F.col("mission"))).collect()] == [1, 1, -1, -1]


def test_around_is_the_same_on_seconds_and_on_timestamps(make):
    times = ["08:29:59.999", "08:30:00.000", "09:30:00.000", "09:30:00.999", "09:30:01.000"]
    df = make([(t, f"2019-02-28 {t}") for t in times], "train string, timestamp timestamp")
    seconds = around(df.withColumn("departure", F.unix_seconds("timestamp")), "2019-02-28 09:00:00.5")
    instants = around_instant(df, "2019-02-28 09:00:00.5")
    assert [r.train for r in seconds.collect()] == [r.train for r in instants.collect()] == times[1:4]


STATIONS = [(1, "A", 48.0, 2.0), (2, "B", 49.0, 3.0)]
DEPARTURES = "station int, train string, timestamp timestamp, mode string, mission string, terminus int, seq int"


def test_published_table(spark, make):
    stations = spark.createDataFrame(STATIONS, STATION)
    rows = [
        (1, "t", "2019-02-28 09:00:00", "R", "PALS", 2, 1), (2, "t", "2019-02-28 09:08:00", "R", "PALS", 2, 2),
        (2, "t", "2019-02-28 09:08:00", "R", "PALS", 2, 3),
        (1, "theory", "2019-02-28 09:00:00", "T", "UEGE", 2, 4), (2, "theory", "2019-02-28 09:08:00", "T", "UEGE", 2, 5),
        (2, "stands", "2019-02-28 09:00:00", "R", None, 2, 6), (2, "stands", "2019-02-28 09:08:00", "R", None, 2, 7),
        (9, "away", "2019-02-28 09:00:00", "R", "UEGE", 2, 8), (2, "away", "2019-02-28 09:08:00", "R", "UEGE", 2, 9),
        (1, "far", "2019-02-28 08:00:00", "R", "UEGE", 2, 10), (2, "far", "2019-02-28 09:08:00", "R", "UEGE", 2, 11),
    ]
    got = train_progress(make(rows, DEPARTURES), stations, None, "2019-02-28 09:01:00", Settings(), order_by=["seq"])
    assert tuple(got.columns) == PROGRESS_COLUMNS
    trains = {r.train: r for r in got.collect()}
    assert set(trains) == {"t", "stands", "away"}
    t = trains["t"]
    assert (t.departure, t.arrival, t.from_st_lb, t.to_st_lb) == ("09:00:00", "09:08:00", "A", "B")
    assert (t.time_to_st, t.progress, t.direction) == (480, 12.5, 1)
    assert (t.train_lt, t.train_lg) == (48.125, 2.125)
    assert trains["stands"].train_lt == 49.0 and trains["stands"].direction == -1
    assert trains["away"].from_st_lb is None and trains["away"].train_lt is None and trains["away"].to_st_lb == "B"
    assert by_direction(got, 1).count() == 1


def test_first_record_decides_the_mode(make):
    rows = [(1, "t", "2019-02-28 09:00:00", "T", "X", 2, 1), (1, "t", "2019-02-28 09:00:00", "R", "X", 2, 2)]
    df = make(rows, DEPARTURES)
    assert train_stops(df, "2019-02-28 09:00:00", order_by=["seq"]).isEmpty()
    assert realtime_only(df).count() == 1


def test_known_terminus(spark, make):
    df = make([(1, 1), (2, 7), (3, None)], "station int, terminus int")
    assert [r.station for r in known_terminus(df, spark.createDataFrame(STATIONS, STATION)).collect()] == [1]


def test_salted_join_is_the_same_join(spark, make):
    stations = spark.createDataFrame(STATIONS, STATION)
    df = make([("t%d" % i, 1 if i % 3 else 2) for i in range(200)] + [("x", 9), ("y", None)], "train string, from_st int")
    plain, salted = with_station(df, stations, "from_st"), with_station(df, stations, "from_st", salts=7)
    assert as_set(plain) == as_set(salted)
    with pytest.raises(ValueError):
        attach(df, stations.withColumnRenamed("station", "from_st"), "from_st", "right", salts=2)

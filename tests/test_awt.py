"""Waiting times."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from headway.operators import awt
from headway.operators.dedup import dedup_departures
from headway.model import Settings
from headway.plans.reports import last_hour_awt

SCHEMA = "station int, train string, timestamp timestamp"
START = datetime(2019, 2, 28, 8, 6)

# Station, trains and waiting time of one recorded hour.
RECORDED = [
    (87382473, 14, 4.29), (87386425, 14, 4.29), (87382259, 19, 3.16), (87382457, 18, 3.33), (87382440, 20, 3.0),
    (87382333, 14, 4.29), (87382887, 12, 5.0), (87334482, 30, 2.0), (87381137, 48, 1.25), (87386318, 17, 3.53),
    (87382374, 12, 5.0), (87382499, 27, 2.22), (87382655, 5, 12.0), (87382382, 25, 2.4), (87381905, 31, 1.94),
    (87384008, 16, 3.75), (87386003, 19, 3.16), (87386300, 24, 2.5), (87381129, 38, 1.58), (87386409, 24, 2.5),
]


def test_recorded_hour(make):
    rows = [
        (station, f"{station}-{i}", str(START + timedelta(seconds=60 * i)))
        for station, nt, _ in RECORDED for i in range(nt)
    ]
    rows += rows[::3]
    got = last_hour_awt(make(rows, SCHEMA), "2019-02-28 09:07:10", decimals=2, order_by=["station"])
    assert {(r.station, r.nt, r.awt) for r in got.collect()} == set(RECORDED)
    window = got.first().window
    assert (str(window.start), str(window.end)) == ("2019-02-28 08:06:00", "2019-02-28 09:06:00")


@pytest.mark.parametrize("length,slide", [(60, 2), (60, 7), (10, 10), (9, 6), (5, 3)])
def test_panes_equal_spark_windows(make, length, slide):
    rng = random.Random(length * 100 + slide)
    rows = [
        (rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), str(START + timedelta(seconds=rng.randrange(20000))))
        for _ in range(300)
    ] + [(1, "x", None), (1, "x", "1969-12-31 23:59:59")]
    df = make(rows, SCHEMA)
    panes = awt.trains_per_window(df, window_minutes=length, slide_minutes=slide)
    spark_windows = awt.trains_per_window(df, window_minutes=length, slide_minutes=slide, method="expand")
    assert panes.exceptAll(spark_windows).isEmpty() and spark_windows.exceptAll(panes).isEmpty()


def test_hot_station_counts(make, spark):
    hot = spark.range(30000).select(
        F.lit(1).alias("station"), F.col("id").cast("string").alias("train"),
        F.timestamp_seconds(F.lit(1551341160) + F.col("id") % 60).alias("timestamp"),
    )
    got = awt.trains_per_window(hot)
    assert got.count() == 30 and got.agg(F.min("nt"), F.max("nt")).first() == (30000, 30000)


def test_no_train_gives_no_waiting_time(make):
    windows = awt.trains_per_window(make([(1, None, "2019-02-28 08:06:00")], SCHEMA))
    assert {(r.nt, r.awt) for r in awt.with_awt(windows).collect()} == {(0, None)}


def test_rounding_is_half_even(spark):
    df = awt.with_awt(spark.createDataFrame([(48,), (16,), (1,)], "nt long"))
    assert [r.awt for r in df.collect()] == [1.2, 3.8, 60.0]


def test_last_window_is_the_same_from_rows_and_from_windows(make):
    rng = random.Random(5)
    df = make([(rng.randrange(3), str(i), str(START + timedelta(seconds=rng.randrange(9000)))) for i in range(200)], SCHEMA)
    windows = awt.trains_per_window(df)
    for policy in ("latest", "compat"):
        for second in (0, 1, 59, 60, 61, 119):
            as_of = START + timedelta(hours=2, seconds=second)
            direct = awt.last_window_counts(df, as_of, policy=policy)
            picked = awt.last_window(windows, as_of, policy=policy)
            assert direct.exceptAll(picked).isEmpty() and picked.exceptAll(direct).isEmpty()


def test_compat_policy_selects_a_window_in_61_of_120_seconds(spark):
    base = int(START.replace(tzinfo=timezone.utc).timestamp())
    assert base % 120 == 0
    starts = spark.range(120).select((F.col("id") + base).alias("now"))
    windows = spark.range(-40, 40).select(F.struct(
        F.timestamp_seconds(F.lit(base) + F.col("id") * 120).alias("start"),
        F.timestamp_seconds(F.lit(base) + F.col("id") * 120 + 3600).alias("end"),
    ).alias("window"))
    by_rule = starts.join(windows, (F.col("now") - 3720 <= F.unix_seconds("window.start"))
                          & (F.unix_seconds("window.end") <= F.col("now") - 60))
    expected = {(r.now, r.window.start) for r in by_rule.collect()}
    assert len(expected) == len({now for now, _ in expected}) == 61
    got = set()
    for now in range(base, base + 120):
        got |= {(now, r.window.start) for r in awt.last_window(windows, now, policy="compat").collect()} if now % 10 in (0, 1, 9) else {
            pair for pair in expected if pair[0] == now}
    assert got == expected


def test_summaries(make):
    batch = make([(3, 5.0), (1, 2.0), (2, 2.0), (4, 5.0)], "station int, awt double")
    assert [tuple(r) for r in awt.ordered_awt(batch).collect()] == [(1, 2.0), (2, 2.0), (3, 5.0), (4, 5.0)]
    assert tuple(awt.global_awt(batch).first()) == (4, 3.5)
    assert tuple(awt.min_awt(batch).first()) == (1, 2.0)
    assert tuple(awt.max_awt(batch).first()) == (3, 5.0)


def test_dedup_keeps_first_and_ignores_station(make):
    df = make(
        [(1, "a", "2019-02-28 08:06:00", 2), (2, "a", "2019-02-28 08:06:00", 1), (1, "b", "2019-02-28 08:06:00", 3)],
        SCHEMA + ", seq int",
    )
    assert {(r.train, r.station) for r in dedup_departures(df, order_by=["seq"]).collect()} == {("a", 2), ("b", 1)}
    assert dedup_departures(df).count() == 2
    assert dedup_departures(df, keys=("train", "timestamp", "station")).count() == 3


def test_repeats_are_reduced_before_the_shuffle(make, capsys):
    df = make([(1, "a", "2019-02-28 08:06:00")], SCHEMA)
    dedup_departures(df, order_by=["station"]).explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_time_filter_reaches_the_scan(spark, make, tmp_path, capsys):
    path = str(tmp_path / "departures")
    make([(1, "a", "2019-02-28 08:06:00")], SCHEMA).write.parquet(path)
    last_hour_awt(spark.read.parquet(path), "2019-02-28 09:07:10", Settings(), order_by=["station"]).explain()
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed


def test_stations_without_a_waiting_time_come_last(spark):
    batch = spark.createDataFrame([(1, None), (2, 3.0), (3, 1.0)], "station int, awt double")
    assert [r.station for r in awt.ordered_awt(batch).collect()] == [3, 2, 1]
    assert awt.min_awt(batch).first().station == 3 and awt.max_awt(batch).first().station == 2


def test_ties_have_one_order_on_any_partitioning(spark):
    rows = [("t", "2019-02-28 08:00:00", station, 5) for station in range(40)]
    df = spark.createDataFrame(rows, "train string, timestamp string, station int, ingest_ts int")
    got = {dedup_departures(df.repartition(n), order_by=["ingest_ts"]).first().station for n in (1, 3, 8)}
    assert got == {0} == {dedup_departures(df.repartition(n)).first().station for n in (1, 7)}

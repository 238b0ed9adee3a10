"""Departures kept by train, and functions of SQL over fitted paths."""

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from headway.operators.dedup import dedup_departures
from headway.operators.positions import accurate_position, fit_paths
from headway.operators.progress import next_stop
from headway.plans.sql import register_functions
from headway.plans import queries
from headway.sources import history
from headway.sources.history import read_history, write_history


def test_a_history_needs_no_exchange(spark, tmp_path):
    stops = spark.range(500).select(
        (F.col("id") % 7).cast("string").alias("train"), (F.col("id") * 37 % 400).alias("departure"), (F.col("id") % 11).cast("int").alias("station")
    )
    table = f"h{uuid4().hex}"
    write_history(stops, table, 4, str(tmp_path / "history"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = next_stop(dedup_departures(read_history(spark, table), ("train", "departure"), ["station"]))
        again = kept.join(read_history(spark, table).groupBy("train").count(), "train")
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        whole = next_stop(dedup_departures(stops, ("train", "departure"), ["station"]))
        assert sorted(kept.collect()) == sorted(whole.select(*kept.columns).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")


@pytest.fixture
def fitted(spark):
    paths = spark.createDataFrame(
        [(1, 2, [(48.0, 2.0), (48.1, 2.1), (48.3, 2.15), (48.35, 2.2), (48.4, 2.4)], 5), (2, 2, [(48.4, 2.4)], 1), (3, 4, [(1.0, 1.0), (2.0, 3.0)], 2)],
        "from_st int, to_st int, points array<struct<lat:double,lon:double>>, number_step int",
    )
    return fit_paths(paths)


def test_positions_in_sql(spark, fitted):
    register_functions(spark, fitted)
    legs = [(a, b, float(p)) for a, b in ((1, 2), (2, 2), (3, 4), (7, 8)) for p in (0, 10, 55, 100)] + [(1, 2, None), (None, 2, 5.0)]
    trains = spark.createDataFrame(legs, "from_st int, to_st int, progress double")
    trains.createOrReplaceTempView("legs")
    got = spark.sql("SELECT from_st, to_st, progress, at.lat, at.lon FROM (SELECT *, position_of(from_st, to_st, progress) AS at FROM legs)")
    nowhere = F.lit(None).cast("double")
    want = accurate_position(trains.withColumn("train_lt", nowhere).withColumn("train_lg", nowhere), fitted)
    by = {(r.from_st, r.to_st, r.progress): (r.lat, r.lon) for r in got.collect()}
    assert len(by) == len(legs)
    for r in want.collect():
        assert by[r.from_st, r.to_st, r.progress] == pytest.approx((r.train_alt, r.train_alg)) or r.train_alt is None
    assert by[7, 8, 10.0] == (None, None)


def test_tracks_in_sql(spark, fitted):
    register_functions(spark, fitted, "x_")
    track = [tuple(r) for r in spark.sql("SELECT * FROM x_track_of(3, 4, 50D) ORDER BY progress").collect()]
    assert track == [(0.0, 1.0, 1.0), (50.0, 1.5, 2.0), (100.0, 2.0, 3.0)]
    assert spark.sql("SELECT * FROM x_track_of(9, 9, 50D)").isEmpty()


def test_buckets_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BUCKET_ROWS", 20)
    rows = spark.range(200).selectExpr(
        "id % 50 as l_orderkey", "id % 7 as l_suppkey", "date_add(date'2024-01-01', cast(id as int)) as l_shipdate", "'O' as l_linestatus",
        "id % 3 as l_partkey", "cast(id % 4 as int) as l_linenumber",
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = []
    monkeypatch.setattr(queries, "write_history", lambda df, table, n, path: made.append(n) or write_history(df, table, n, path))
    assert queries.registered()["next_stop_history"](spark, str(tmp_path)).count() == 200
    assert made == [10] and history.buckets_for(rows.limit(5)) == 8

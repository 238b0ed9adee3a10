"""Spline fit and positions along the track."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.functions import spline
from headway.functions.spline import solve_bends
from headway.model import PATH
from headway.operators import positions


def dense_bends(y):
    """The same spline from the full system of equations."""
    n = len(y)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = a[-1, -3:] = [1, -2, 1]
    for i in range(1, n - 1):
        a[i, i - 1:i + 2] = [1, 4, 1]
        b[i] = 6 * (y[i - 1] - 2 * y[i] + y[i + 1])
    return np.linalg.solve(a, b)


@pytest.mark.parametrize("n", [5, 6, 7, 8, 40, 225])
def test_fit_solves_the_full_system(n):
    rng = np.random.default_rng(n)
    y = rng.normal(size=(3, n))
    for row, bent in zip(y, solve_bends(y)):
        assert np.allclose(bent, dense_bends(row), atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_paths_are_linear(n):
    assert not solve_bends(np.arange(2 * n, dtype=float).reshape(2, n) ** 2).any()


def test_rows_of_many_lengths_are_solved_together(monkeypatch):
    """As many steps as the longest row has, whatever the other lengths."""
    rng = np.random.default_rng(3)
    lengths = rng.permutation(np.concatenate([np.arange(60), np.arange(60)]))
    rows = [rng.normal(size=n) for n in lengths]
    steps = []
    monkeypatch.setattr(spline, "range", lambda *of: steps.append(len(range(*of))) or range(*of), raising=False)
    got = np.split(spline.solve_ragged(np.concatenate(rows), lengths), np.cumsum(lengths)[:-1])
    assert steps == [54, 55]
    for y, bent in zip(rows, got):
        assert np.allclose(bent, dense_bends(y) if len(y) > 4 else np.zeros(len(y)), atol=1e-9)


def curve(i, n):
    t = i / max(n - 1, 1)
    return 48.8 + 0.1 * t + 0.02 * t ** 3, 2.2 + 0.05 * t - 0.03 * t ** 2


@pytest.fixture(scope="module")
def paths(spark):
    rows = [(1, to, [curve(i, n) for i in range(n)], n) for to, n in ((2, 2), (3, 4), (4, 5), (5, 40))]
    return spark.createDataFrame(rows + [(1, 1, [curve(0, 1)], 1)], PATH)


def trains(spark, rows):
    return spark.createDataFrame(
        rows, "train string, from_st int, to_st int, progress double, train_lt double, train_lg double"
    )


def test_a_cubic_is_reproduced(spark, paths):
    at = [0.0, 0.1, 12.5, 33.3, 50.0, 99.9, 100.0]
    df = trains(spark, [(str(p), 1, to, p, 0.0, 0.0) for p in at for to in (4, 5)])
    for r in positions.accurate_position(df, positions.fit_paths(paths)).collect():
        lat, lon = curve(r.progress / 100, 2)
        assert math.isclose(r.train_alt, lat, abs_tol=1e-10) and math.isclose(r.train_alg, lon, abs_tol=1e-10)


def test_knots_linear_standing_and_missing(spark, paths):
    fitted = positions.fit_paths(paths)
    df = trains(spark, [
        ("knot", 1, 5, 100.0 * 7 / 39, 0.0, 0.0), ("linear", 1, 3, 50.0, 0.0, 0.0), ("stands", 1, 1, 37.0, 0.0, 0.0),
        ("missing", 1, 77, 50.0, 48.5, 2.5),
    ])
    got = {r.train: (r.train_alt, r.train_alg) for r in positions.accurate_position(df, fitted).collect()}
    assert np.allclose(got["knot"], curve(7, 40), atol=1e-12)
    assert np.allclose(got["linear"], np.mean([curve(1, 4), curve(2, 4)], axis=0), atol=1e-12)
    assert np.allclose(got["stands"], curve(0, 1), atol=0)
    assert got["missing"] == (48.5, 2.5)
    assert positions.accurate_position(df, fitted).columns == [*df.columns, "train_alt", "train_alg"]


def test_switched_off(spark, paths):
    df = trains(spark, [("t", 1, 5, 50.0, 48.5, 2.5)])
    r = positions.with_position(df, positions.fit_paths(paths), accurate=False).first()
    assert (r.train_alt, r.train_alg) == (48.5, 2.5)


def test_segments_join_at_the_points(paths):
    rows = positions.fit_segments(positions.fit_paths(paths)).filter("to_st = 5").orderBy("seg").collect()
    assert len(rows) == 39
    for r in rows:
        d = r.width
        end = r.a0 + r.a1 * d + r.a2 * d ** 2 + r.a3 * d ** 3
        assert np.allclose((r.a0, end), (curve(r.seg, 40)[0], curve(r.seg + 1, 40)[0]), atol=1e-10)
        assert math.isclose(r.x0, 100 * r.seg / 39)


def test_segments_know_the_next_one(paths):
    pieces = positions.fit_segments(positions.fit_paths(paths), ahead=True)
    assert "Window" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.from_st, r.to_st, r.seg): r for r in pieces.collect()}
    names = [f"{axis}{i}" for axis in "ab" for i in range(4)]
    assert len(rows) > 40
    for (a, b, seg), r in rows.items():
        following = rows.get((a, b, seg + 1))
        assert [r[f"next_{n}"] for n in names] == [following and following[n] for n in names]
        assert r.last == max(x for c, d, x in rows if (c, d) == (a, b))


def test_fit_of_batches_with_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(None,), ([],), ([1.0],), ([0.0, 1.0, 4.0, 9.0, 16.0],), (None,)], "y array<double>")
    from headway.functions.spline import bends

    for cores in (1, 5):
        got = sorted((str(r[0]) for r in df.repartition(cores).select(bends("y")).collect()))
        assert got == sorted(["None", "[]", "[0.0]", "[2.0, 2.0, 2.0, 2.0, 2.0]", "None"])


def test_direct_train_from_instant_to_instant(spark, paths):
    """A leg of 60 s on the long path, seen every 6 s, and before and after."""
    fitted = positions.fit_paths(paths)
    published = spark.createDataFrame(
        [("007", 1, 5, 1000, 1060, 3.0)], "train string, from_st int, to_st int, departure_uts long, arrival_uts long, progress double"
    )
    track = positions.positions_track(published, 988, 1072, 6, fitted, under_way=False).orderBy("at_uts").collect()
    assert [r.progress for r in track] == [0.0, 0.0] + [10.0 * i for i in range(11)] + [100.0, 100.0]
    for r in track:
        assert np.allclose((r.lat, r.lon), curve(r.progress / 100, 2), atol=1e-10)
    own = positions.positions_track(published, 988, 1072, 6, fitted).orderBy("at_uts").collect()
    assert [(r.at_uts, r.progress) for r in own] == [(1000 + 6 * i, 10.0 * i) for i in range(11)]
    one = positions.positions_at(published, 1030, fitted).first()
    assert one.progress == 50.0 and np.allclose((one.lat, one.lon), curve(0.5, 2), atol=1e-10)
    straight = positions.positions_at(published, 1030, fitted, accurate=False).first()
    assert np.allclose((straight.lat, straight.lon), np.mean([curve(0, 2), curve(1, 2)], axis=0), atol=1e-12)


def test_evaluation_needs_no_python(spark, paths, tmp_path, capsys):
    path = str(tmp_path / "fitted")
    positions.fit_paths(paths).write.parquet(path)
    df = trains(spark, [("t", 1, 5, 50.0, 0.0, 0.0)])
    positions.accurate_position(df, spark.read.parquet(path)).select(F.col("train_alt")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "ArrowEval" not in plan

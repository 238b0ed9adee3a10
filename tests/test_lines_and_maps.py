"""Sub-lines, missions and inputs of maps."""

import random

from pyspark.sql import functions as F

from headway.functions.scalars import short_label
from headway.model import STATION, STRETCHES
from headway.operators import filters, lines, maps


def test_known_lines(spark):
    members = lines.line_membership(lines.known_stretches(spark))
    sizes = {r.line: r["count"] for r in members.groupBy("line").count().collect()}
    assert sizes == {"L1": 16, "L2": 19, "L3": 5, "L4": 17}
    by_pos = {(r.line, r.pos): r.label for r in members.collect()}
    assert by_pos["L2", 4] == "BECON LES BRUYERES" and by_pos["L2", 5] == "COURBEVOIE"
    assert by_pos["L4", 16] == STRETCHES["becon-cergy"][-1] == "CERGY LE HAUT"


def test_spans_give_the_same_positions(spark):
    rng = random.Random(3)
    rows = [(line, seq, [f"{line}-{seq}-{i}" for i in range(rng.randrange(4))]) for line in (1, 2) for seq in range(0, 90, 3)]
    df = spark.createDataFrame(rows, "line int, seq int, labels array<string>")
    plain = lines.line_membership(df)
    for span in (1, 10, 1000):
        assert plain.exceptAll(lines.line_membership(df, span)).isEmpty()
        assert lines.line_membership(df, span).exceptAll(plain).isEmpty()


def test_missions(spark):
    df = spark.createDataFrame([("FALY",), ("PIBE",), ("SOPA",), ("GERM",), ("",), (None,)], "mission string")
    got = {r.mission: tuple(r)[1:] for r in lines.decode_mission(df).collect()}
    assert got["FALY"] == ("MAISONS LAFFITTE", ["L4"], "semi direct", "La Défense ou Les Vallées")
    assert got["PIBE"][2:] == ("direct", "Bécon les Bruyères")
    assert got["SOPA"] == ("SAINT-NOM LA BRETECHE FORET DE MARLY", ["L2", "L3"], "omnibus", "Pont Cardinet")
    assert got["GERM"] == (None, None, "autres dessertes", None)
    assert got[""] == got[None] == (None, None, None, None)


def test_short_label(spark):
    df = spark.createDataFrame([("SIXTEEN LETTERS.",), ("SEVENTEEN LETTERS",)], "label string")
    assert [r[0] for r in df.select(short_label(F.col("label"))).collect()] == ["SIXTEEN LETTERS.", "SEVENTEEN LE..."]


def test_layers(spark):
    trains = spark.createDataFrame([("t", 48.0)], "train string, train_lt double")
    stations = spark.createDataFrame([(1, "A", 48.0, 2.0)], STATION)
    rail = spark.createDataFrame([("L", 1.0, 2.0, 3.0, 4.0)], "code string, lat1 double, lon1 double, lat2 double, lon2 double")
    ends = maps.segment_endpoints(rail)
    assert sorted(map(tuple, ends.collect())) == [("L", 0, 1.0, 2.0), ("L", 1, 3.0, 4.0)]
    layers = maps.map_layers(trains, stations, ends)
    assert {r.layer: r["count"] for r in layers.groupBy("layer").count().collect()} == {"train": 1, "station": 1, "rail": 2}
    assert layers.filter("layer = 'station' and train is null and label = 'A'").count() == 1
    assert maps.distinct_points(ends.union(ends)).count() == 2


def test_line_track(spark):
    rail = spark.createDataFrame([("326000", "V1"), ("326000", "V2"), ("1", "V1")], "code_ligne string, nom_voie string")
    assert filters.line_track(rail, ["326000"]).count() == 1

"""Reference tables: readers, writers and upkeep."""

import json

import pytest
from pyspark.sql import types as T

from headway.model import KEYED_PATH, KEYED_STATION, STATION, TRACK_POINT
from headway.operators import dims
from headway.sources import tables

MARK = "﻿"


def test_station_csv(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("station,label,latitude,longitude\n2,LE VAL D'OR,48.5,2.5\n1,NANTERRE UNIVERSITÉ,48.0,2.0\n")
    df = tables.read_stations(spark, str(path), ordered=True, view="stations_data")
    assert [r.station for r in df.collect()] == [1, 2]
    assert spark.sql("select * from stations_data").count() == 2 and df.schema == STATION


def test_branch_codes_stay_text(spark, tmp_path):
    path = tmp_path / "order.csv"
    path.write_text('station,pos,order\n1,"0",0\n2,"00",0\n3,"010",4\n')
    assert [r.pos for r in tables.read_station_order(spark, str(path)).orderBy("station").collect()] == ["0", "00", "010"]


def test_track_points_ignore_marks_in_the_header(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text(f'{MARK}{MARK}Depart,Arrivée,P,a,b,c,d,e,f,g,h\n1,2,"00",11,0,326000,Ligne à,V1,308586,2.5,49.5\n')
    row = tables.read_track_points(spark, str(path)).first()
    assert (row.depart, row.path, row.libelle_ligne, row.longitude, row.latitude) == (1, "00", "Ligne à", 2.5, 49.5)


def test_locale_csv(spark, tmp_path):
    padded = tmp_path / "padded.csv"
    padded.write_bytes(f"{MARK}station ;label   ;latitude ;longitude\r\n1 ;A B    ;48.5 ; 2.5 \r\n2 ;É;48,5;2,5\r\n".encode())
    rows = tables.read_locale_csv(spark, str(padded), STATION, decimal_comma=("latitude", "longitude")).collect()
    assert [tuple(r) for r in rows] == [(1, "A B", 48.5, 2.5), (2, "É", 48.5, 2.5)]
    split = tmp_path / "split.csv"
    split.write_text(f'{MARK}Depart,Arrivée,P,a,b,c,d,e,f,g,h\n1,2,"00",11,0,326000,L,V1,308586,2,021280024,49,05091897\n')
    row = tables.read_locale_csv(spark, str(split), TRACK_POINT, ",", ("longitude", "latitude")).first()
    assert (row.path, row.longitude, row.latitude) == ("00", 2.021280024, 49.05091897)


def test_decimal_commas_of_whole_numbers(spark, tmp_path):
    """Rows of thirteen, twelve and eleven fields; those that fit in two ways are told apart by ranges, or kept as text."""
    head = f"{MARK}Depart,Arrivée,P,a,b,c,d,e,f,g,h\n"
    begin = '1,2,"00",11,0,326000,"L, x",V1,308586'
    path = tmp_path / "commas.csv"
    rows = ["2,021280024,49,05091897", "2,49,05091897", "2,5,49", "2,49", "2,021,x", "2,1,49,5,6", "1,49,48", ",49"]
    path.write_text(head + "".join(f"{begin},{row}\n" for row in rows))
    ranges = {"longitude": (-5.0, 10.0), "latitude": (41.0, 52.0)}

    def read(**options):
        found = tables.read_locale_csv(spark, str(path), TRACK_POINT, ",", ("longitude", "latitude"), **options)
        return [(r.path, r.libelle_ligne, r.longitude, r.latitude, r.bad_value and r.bad_value.split("308586,")[1]) for r in found.collect()]

    good = [("00", "L, x", 2.021280024, 49.05091897, None), ("00", "L, x", 2.0, 49.05091897, None), ("00", "L, x", 2.5, 49.0, None),
            ("00", "L, x", 2.0, 49.0, None)]
    bad = [(None, None, None, None, text) for text in ("2,021,x", "2,1,49,5,6", "1,49,48", ",49")]
    got = read(ranges=ranges, bad="quarantine")
    assert got[:4] == good and got[4:] == bad
    without = read(bad="quarantine")
    assert without[0] == good[0] and without[1] == (None, None, None, None, "2,49,05091897") and without[3] == good[3]
    with pytest.raises(Exception, match="fit in just one way"):
        tables.read_locale_csv(spark, str(path), TRACK_POINT, ",", ("longitude", "latitude")).collect()


def test_keyed_json(spark, tmp_path):
    whole = tmp_path / "stations.json"
    whole.write_text(json.dumps({"1": {"label": "A", "latitude": 1.0, "longitude": 2.0}, "2": {"label": "B"}}, indent=1))
    got = {r.key: r.label for r in tables.read_keyed_json(spark, str(whole), KEYED_STATION, lines=False).collect()}
    assert got == {"1": "A", "2": "B"}
    paths = tmp_path / "paths.json"
    points = [{"latitude": "48.5", "longitude": "2.5"}, {"latitude": "49", "longitude": "3"}]
    paths.write_text(json.dumps({"1-2": {"departure": "1", "arrival": "2", "geoPoints": points, "number_step": 2}}))
    row = tables.read_keyed_paths(spark, str(paths)).first()
    assert (row.from_st, row.to_st, row.number_step, tuple(row.points[1])) == (1, 2, 2, (49.0, 3.0))
    assert KEYED_PATH["number_step"].dataType == T.IntegerType()


def test_reference_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 48.0, 2.0), (2, "B, É", 49.0, 3.0)], STATION)
    for fmt, read in (
        ("csv", lambda p: tables.read_stations(spark, p)),
        ("json", lambda p: spark.read.schema(STATION).json(p)),
        ("parquet", lambda p: spark.read.parquet(p)),
    ):
        path = str(tmp_path / fmt)
        tables.write_reference(df, path, fmt)
        assert sorted(map(tuple, read(path).collect())) == sorted(map(tuple, df.collect()))
    path = str(tmp_path / "keyed")
    tables.write_reference(df, path, "keyed_json", key="station")
    got = tables.read_keyed_json(spark, path, KEYED_STATION, lines=True).collect()
    assert sorted(map(tuple, got)) == [("1", "A", 48.0, 2.0), ("2", "B, É", 49.0, 3.0)]


def test_open_data_to_stations(spark, tmp_path):
    path = tmp_path / "open.json"

    def entry(code, label, line=None, place=None):
        fields = {"code_uic": code, "libelle_point_arret": label, **({"l": line} if line else {})}
        return {"fields": fields, **({"geometry": {"coordinates": place}} if place else {})}

    path.write_text(json.dumps([
        entry("1", "A", "1", [2.0, 48.0]), entry("2", "B", None, [9.0, 9.0]), entry("3", "C", "1"),
        entry("1", "A", None, [2.5, 48.5]), entry("x", "bad", None, [1.0, 1.0]), entry("1", "A"),
    ]))
    raw = tables.read_open_data(spark, str(path))
    stations = dims.line_stations(raw).dropDuplicates(["station"])
    got = dims.with_coordinates(stations, dims.open_data_places(raw))
    assert {tuple(r) for r in got.collect()} == {(1, "A", 48.5, 2.5), (3, "C", 0.0, 0.0)}


def test_upsert_and_inject(spark):
    dim = spark.createDataFrame([(1, "A", 48.0, 2.0), (2, "B", 49.0, 3.0)], STATION)
    patch = spark.createDataFrame([(2, "b", 0.0, 0.0), (87386318, "NANTERRE UNIVERSITÉ", 0.0, 0.0)], STATION)
    got = dims.upsert(dim, patch, "station")
    assert {r.station: r.label for r in got.collect()} == {1: "A", 2: "b", 87386318: "NANTERRE UNIVERSITÉ"}
    assert dims.inject(dim, patch).count() == 4


def test_bad_keyed_objects(spark, tmp_path):
    path = tmp_path / "keyed.json"
    path.write_text('{"1": {"label": "A"}}\n\n{"2": {"lab\n{}\n')
    with pytest.raises(Exception, match="unreadable keyed JSON"):
        tables.read_keyed_json(spark, str(path), KEYED_STATION).collect()
    assert [r.key for r in tables.read_keyed_json(spark, str(path), KEYED_STATION, bad="drop").collect()] == ["1"]
    got = tables.read_keyed_json(spark, str(path), KEYED_STATION, bad="quarantine").collect()
    assert sorted((r.key or "", r.bad_value) for r in got) == [("", '{"2": {"lab'), ("1", None)]
    with pytest.raises(ValueError):
        tables.read_keyed_json(spark, str(path), KEYED_STATION, bad="maybe")

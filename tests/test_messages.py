"""Decoding and encoding of messages and departure boards."""

import json

import pytest
from pyspark.sql import functions as F

from headway.functions.clock import clock_text, local_text, message_text, message_timestamp
from headway.model import DEPARTURE
from headway.sources.boards import parse_boards
from headway.sources.messages import (
    decode_departures, decode_variant, encode_departures, kafka_options, split_quarantine, with_volume_metric, write_departures,
)

GOOD = {"station": 87384008, "train": "007", "timestamp": "2019-02-28T08:06:00.000Z", "mode": "R",
        "mission": "PALS", "terminus": 87382374}
OTHER_FORMAT = {**GOOD, "timestamp": "2019-02-28 08:06:00"}
BAD_TIME = {**GOOD, "timestamp": "28/02/2019"}


def messages(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_decode_reads_both_time_formats(spark):
    rows = decode_departures(messages(spark, GOOD, OTHER_FORMAT)).collect()
    assert len(set(rows)) == 1
    assert str(rows[0].timestamp) == "2019-02-28 08:06:00"
    assert decode_departures(messages(spark, GOOD)).schema == DEPARTURE


def test_decode_binary_value(spark):
    binary = messages(spark, GOOD).withColumn("value", F.col("value").cast("binary"))
    assert decode_departures(binary).first().train == "007"


def test_bad_records(spark):
    df = messages(spark, GOOD, "{not json", BAD_TIME)
    assert decode_departures(df).filter("timestamp is null").count() == 2
    assert decode_departures(df, bad="drop").count() == 1
    good, bad = split_quarantine(decode_departures(df, bad="quarantine"))
    assert good.columns == [f.name for f in DEPARTURE]
    assert {r.bad_value for r in bad.collect()} == {"{not json", json.dumps(BAD_TIME)}


def test_a_field_of_another_type_or_a_missing_one_is_bad(spark):
    broken = [{**GOOD, "station": "abc"}, {**GOOD, "train": None}, {k: v for k, v in GOOD.items() if k != "station"}]
    df = messages(spark, GOOD, *broken)
    good, bad = split_quarantine(decode_departures(df, bad="quarantine"))
    assert good.count() == 1 and {r.bad_value for r in bad.collect()} == {json.dumps(b) for b in broken}
    assert decode_departures(df, bad="drop").count() == 1 and decode_departures(df).count() == 4
    assert decode_departures(df, bad="drop", required=("timestamp",)).count() == 3


def test_round_trip(spark, tmp_path):
    df = decode_departures(messages(spark, GOOD))
    assert json.loads(encode_departures(df).first().value) == GOOD
    path = str(tmp_path / "out")
    write_departures(df, "files", path=path)
    assert decode_departures(spark.read.text(path)).collect() == df.collect()


def test_kafka_options():
    assert kafka_options("host:1", "trains", **{"kafka.acks": "0"}) == {
        "kafka.bootstrap.servers": "host:1", "subscribe": "trains", "startingOffsets": "earliest", "kafka.acks": "0",
    }


def test_volume_metric(spark):
    from pyspark.sql import Observation

    seen = Observation("ingest")
    with_volume_metric(messages(spark, GOOD, GOOD), seen).collect()
    assert seen.get == {"rows": 2}


TRAIN = '<train><date mode="R">{}</date><num>{}</num><miss>POPI</miss><term>87384008</term></train>'


def test_boards(spark):
    two = "<passages>" + TRAIN.format("28/02/2019 23:59", "007") + TRAIN.format("01/03/2019 00:05", "8") + "</passages>"
    one = "<passages>" + TRAIN.format("28/02/2019 10:00", "9") + "</passages>"
    df = spark.createDataFrame([("1", two), ("2", one), ("3", "<passages><train>"), ("4", "no xml")], "station string, xml string")
    rows = {(r.station, r.train): r for r in parse_boards(df, bad="drop").collect()}
    assert set(rows) == {(1, "007"), (1, "8"), (2, "9")}
    first = rows[1, "007"]
    assert (str(first.timestamp), first.mode, first.mission, first.terminus) == ("2019-02-28 23:59:00", "R", "POPI", 87384008)
    kept = parse_boards(df, bad="keep").filter("train is null")
    assert {r.station for r in kept.collect()} == {3, 4}
    marked = parse_boards(df, bad="quarantine").collect()
    assert {r.station: r.bad_value for r in marked if r.bad_value} == {3: "<passages><train>", 4: "no xml"}
    assert len(marked) == 5 and parse_boards(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="unreadable board"):
        parse_boards(df).collect()
    for policy in ("fail", "drop", "keep", "quarantine"):
        plan = parse_boards(df, bad=policy)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml") == 1


def test_time_texts(spark):
    at = F.unix_seconds(F.lit("2019-02-28 08:06:09").cast("timestamp"))
    row = spark.range(1).select(
        clock_text(at), local_text(at), message_text(F.timestamp_seconds(at)),
        F.unix_seconds(message_timestamp(message_text(F.timestamp_seconds(at)))) == at,
    ).first()
    assert tuple(row) == ("08:06:09", "2019-02-28 08:06:09", "2019-02-28T08:06:09.000Z", True)


def test_fields_that_change(spark):
    rows = [
        '{"station":1,"train":"a","timestamp":"2019-02-28T09:00:00.000Z","mode":"R","mission":"M","terminus":5}',
        '{"station":"2","train":7,"timestamp":"yesterday","mode":null,"terminus":{"a":1},"delay":[1,2],"x":{"y":"z"}}',
        '[1,2]', 'no json', None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, value string")
    got = {r.n: r for r in decode_variant(df, keep=("n",)).collect()}
    assert (got[0].station, str(got[0].timestamp), got[0].terminus, got[0].drifted, got[0].more) == (1, "2019-02-28 09:00:00", 5, [], {})
    second = got[1]
    assert (second.station, second.train, second.timestamp, second.mode, second.terminus) == (2, "7", None, None, None)
    assert sorted(second.drifted) == ["terminus", "timestamp"] and second.more == {"delay": "[1,2]", "x": '{"y":"z"}'}
    assert all(got[n].station is None and got[n].train is None and got[n].drifted == [] for n in (2, 3, 4))

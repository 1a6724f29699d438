"""S1, T1, T2, T3, T5 edge cases (FIXTURES F1, F2)."""

import os

import pytest
from pyspark.sql import functions as F

from wavelake.operators.clean import (drop_all_null, drop_noise_lines, parse_fields,
                                      parse_fields_strict)
from wavelake.operators.quality import quality_counts
from wavelake.sources.csv import header_columns, read_csv_strings


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_csv_all_string_and_drop_all_null(spark, tmp_dir):
    # header, full row, all-empty row, all-"" row, whitespace row, blank line,
    # short row, long row
    text = ("timestamp,amplitude,frequency\n"
            "0.000,1.000,50.0\n"
            ",,\n"
            '"","",""\n'
            " , , \n"
            "\n"
            "0.002\n"
            "0.003,0.5,50.0,extra\n")
    _write(os.path.join(tmp_dir, "a.csv"), text)
    assert header_columns(spark, tmp_dir) == ["timestamp", "amplitude", "frequency"]
    raw = read_csv_strings(spark, tmp_dir)
    assert all(f.dataType.simpleString() == "string" for f in raw.schema.fields)
    got = sorted(tuple(r) for r in drop_all_null(raw).collect())
    assert got == sorted([("0.000", "1.000", "50.0"), (" ", " ", " "),
                          ("0.002", None, None), ("0.003", "0.5", "50.0")])
    counts = quality_counts(raw).first().asDict()
    assert counts == {"raw_rows": 6, "cleaned_rows": 4, "dropped_rows": 2, "is_empty": False}


def test_drop_noise_lines_keeps_indented_log(spark):
    df = spark.createDataFrame(
        [("[INFO] start",), ("timestamp,sensor_A,sensor_B",), ("1678886400,10.5,20.3",),
         ("  [WARN] indented",), ("",), ("timestamps are late",)], "value string")
    got = [r.value for r in drop_noise_lines(df).collect()]
    assert got == ["1678886400,10.5,20.3", "  [WARN] indented", ""]


def test_parse_fields_keeps_malformed_rows(spark):
    df = spark.createDataFrame(
        [("1678886400,10.5,20.3",), ("",), ("1,2",), ("1,2,3,4",), ("1.5,2,3",),
         ("abc,x,y",), (" 7 ,1,2",)], "value string")
    got = [tuple(r) for r in parse_fields(df).collect()]
    assert got == [(1678886400, 10.5, 20.3), (None, None, None), (1, 2.0, None),
                   (1, 2.0, 3.0), (1, 2.0, 3.0), (None, None, None), (7, 1.0, 2.0)]
    assert [f.dataType.simpleString() for f in parse_fields(df).schema.fields] == \
        ["bigint", "double", "double"]


def test_parse_fields_strict_drops_failures(spark):
    df = spark.createDataFrame(
        [("1678886400,10.5,20.3",), ("1,2",), ("1,2,3,4",), ("1.5,2,3",),
         ("1 2,3,4",), (" 7,1,2",), ("8, 1 ,2",), ("9,1e2,NaN",), ("1,2,",)],
        "value string")
    got = [tuple(r) for r in parse_fields_strict(df).collect()]
    assert got[:3] == [(1678886400, 10.5, 20.3), (1, 2.0, 3.0), (8, 1.0, 2.0)]
    assert got[3][0] == 9 and got[3][1] == 100.0 and got[3][2] != got[3][2]  # NaN
    assert len(got) == 4


def test_stateless_ops_accept_streaming_frames(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    _write(os.path.join(src, "a.log"), "[INFO] x\ntimestamp,a,b\n1,2,3\n")
    stream = spark.readStream.text(src)
    parsed = parse_fields(drop_noise_lines(stream))
    assert parsed.isStreaming
    q = parsed.writeStream.format("memory").queryName("stateless_t").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("stateless_t").collect()] == [(1, 2.0, 3.0)]
    assert drop_all_null(stream.withColumn("v", F.col("value"))).isStreaming


def test_lenient_integral_cast_edges(spark):
    df = spark.createDataFrame([(" 1.5 ,1,1",), ("+7,1,1",), ("1.,1,1",), ("1e3,1,1",),
                                ("-2.9,1,1",)], "value string")
    assert [r.timestamp for r in parse_fields(df).collect()] == [1, 7, 1, None, -2]


@pytest.mark.parametrize("sep", ["|", ".", ";", "\t", "||", "\\E", "$^"])
def test_separator_is_literal(spark, sep):
    from wavelake.operators.clean import parse_fields, parse_fields_strict
    df = spark.createDataFrame([(sep.join(("5", "15", "25", "x")),), ("5",)], "value string")
    fields = (("a", "long"), ("b", "double"), ("c", "double"))
    assert [tuple(r) for r in parse_fields(df, fields=fields, sep=sep).collect()] == [
        (5, 15.0, 25.0), (5, None, None)]
    assert [tuple(r) for r in parse_fields_strict(df, fields=fields, sep=sep).collect()] == [
        (5, 15.0, 25.0)]

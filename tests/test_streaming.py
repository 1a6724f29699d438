"""Streaming forms of P1, P3, P4 driven to completion with availableNow."""

import os

from wavelake.streaming.jobs import (stream_clean_log_stateful, stream_clean_log_stateless,
                                     stream_ingest_csv)

import pytest

from helpers import sequential_blocks


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_stream_ingest_csv(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), "a,b\n1,x\n,\n2,\n")
    target = os.path.join(tmp_dir, "lake")
    q = stream_ingest_csv(spark, src, ["a", "b"], target,
                          checkpoint=os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    _write(os.path.join(src, "b.csv"), "a,b\n3,y\n")
    q = stream_ingest_csv(spark, src, ["a", "b"], target,
                          checkpoint=os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(target)
    assert sorted(tuple(r) for r in got.select("a", "b").collect()) == \
        [("1", "x"), ("2", None), ("3", "y")]
    assert {"batch_id", "created_month", "created_time"} <= set(got.columns)


def test_stream_log_cleaning(spark, tmp_dir):
    src = os.path.join(tmp_dir, "logs")
    os.makedirs(src)
    files = [["5,5,5", "[INFO] a", "timestamp,A,B", "1,1.5,2", "bad", " [W] x", "2,2,2"],
             ["timestamp,A,B", "7,7,7", "8,8"]]
    for i, lines in enumerate(files):
        _write(os.path.join(src, f"f{i}.log"), "\n".join(lines) + "\n")
    out_a, out_b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    stream_clean_log_stateful(spark, src, out_a,
                              checkpoint=os.path.join(tmp_dir, "cka")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out_a)
                 .select("timestamp", "sensor_A", "sensor_B").collect())
    assert got == sorted(sequential_blocks(files))
    stream_clean_log_stateless(spark, src, out_b,
                               checkpoint=os.path.join(tmp_dir, "ckb")).awaitTermination(120)
    assert spark.read.parquet(out_b).count() == 7


def test_missing_state_is_an_error_and_old_state_goes(spark, tmp_dir):
    from wavelake.streaming.blocks import clean_blocks_micro_batch
    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    schema = "stream string, n long, value string"

    def run(batch_id, lines):
        batch = spark.createDataFrame([("s", n, v) for n, v in lines], schema)
        clean_blocks_micro_batch(batch, batch_id, ["stream"], "n", out, state)

    run(0, [(0, "timestamp,a,b")])
    run(1, [(1, "1,1,1")])
    run(2, [(2, "2,2,2")])
    run(2, [(2, "2,2,2")])  # a replayed batch
    assert sorted(os.listdir(state)) == ["batch_id=1", "batch_id=2"]
    assert sorted(r.timestamp for r in spark.read.parquet(out).collect()) == [1, 2]
    with pytest.raises(Exception, match="batch_id=4"):
        run(5, [(5, "5,5,5")])


def test_line_protocol_stream_to_files(spark, tmp_dir):
    from pyspark.sql import functions as F
    from wavelake.functions.lineproto import with_line_protocol
    src = os.path.join(tmp_dir, "csv")
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), "k,t\nx,1\n,2\ny,3\n")
    stream = (spark.readStream.option("header", True).schema("k string, t long").csv(src)
              .withColumn("t", F.timestamp_seconds("t")))
    out = os.path.join(tmp_dir, "points")
    q = (with_line_protocol(stream, "m", time_col="t").writeStream.format("text")
         .option("path", out).option("checkpointLocation", os.path.join(tmp_dir, "ck")).start())
    q.processAllAvailable()
    q.stop()
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(lines) == ['m k="x" 1000000000', 'm k="y" 3000000000']


def test_skew_safe_stream_blocks_match_sequential(spark, tmp_dir):
    import json
    import random
    from wavelake.streaming.blocks import stream_clean_blocks_skew_safe
    rng = random.Random(4)
    streams = {"hot": 240, "cold": 30}
    texts = {}
    for name, n in streams.items():
        texts[name] = []
        for i in range(n):
            r = rng.random()
            texts[name].append("[E] x" if r < 0.1 else "timestamp,a,b" if r < 0.2
                               else f"{i},{i}.5,{len(name)}")
    src = os.path.join(tmp_dir, "bus")
    os.makedirs(src)
    for b in range(4):
        path = os.path.join(src, f"b{b}.json")
        with open(path, "w") as fh:
            for name, lines in texts.items():
                step = len(lines) // 4
                for n in range(b * step, (b + 1) * step):
                    fh.write(json.dumps({"stream": name, "n": n, "value": lines[n]}) + "\n")
        os.utime(path, (1_700_000_000 + b, 1_700_000_000 + b))
    stream = (spark.readStream.schema("stream string, n long, value string")
              .option("maxFilesPerTrigger", 1).json(src))
    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    q = stream_clean_blocks_skew_safe(stream, ["stream"], "n", out, state,
                                      os.path.join(tmp_dir, "ck"), available_now=True)
    q.awaitTermination(300)
    got = sorted((r.stream, r.timestamp, r.sensor_A, r.sensor_B)
                 for r in spark.read.parquet(out).collect())
    exp = sorted((name, *row) for name, lines in texts.items()
                 for row in sequential_blocks([lines]))
    assert got == exp


def test_stream_ingest_into_line_protocol_sink(spark, tmp_dir):
    from wavelake.sinks.registry import sink_for
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), 'a,b\n1,x\n,\n2,"q"\n')
    out = os.path.join(tmp_dir, "points")
    sink = sink_for("influxdb", "", "db", transport="file", path=out)
    q = stream_ingest_csv(spark, src, ["a", "b"], sink=sink, table="db.t",
                          checkpoint=os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    lines = [r.value for r in spark.read.text(out).collect()]
    fields = sorted(line.rsplit(" ", 1)[0] for line in lines)
    assert fields == ['t a="1",b="x"', 't a="2",b="q"']

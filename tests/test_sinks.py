"""T13, K3–K10, A5 and the P1/P2 plans (no database or server is started:
JDBC DDL goes to a recording executor, line protocol to the file transport)."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from wavelake.functions.lineproto import line_protocol, measurement_name, with_line_protocol
from wavelake.operators.quality import run_summary
from wavelake.plans.analysis import run_analysis
from wavelake.plans.ingest import EmptyInputError, ingest_csv
from wavelake.sinks.jdbc import (JdbcSink, clickhouse_create_table, doris_create_table,
                                 spectrum_create_table)
from wavelake.sinks.lake import (SPECTRUM_SCHEMA, LakeSink, append_spectrum, find_summary,
                                 read_spectrum, read_summary, with_landing_columns)
from wavelake.sinks.lineproto import LineProtocolSink
from wavelake.sinks.registry import normalise_profile, sink_for, warehouse_url
from wavelake.sources.csv import write_csv


def test_measurement_name():
    assert measurement_name("db.task_1_data", "db") == "task_1_data"
    assert measurement_name("db.x.db.y", "db") == "x_y"
    assert measurement_name("a.b") == "a_b"


def test_compatible_line_protocol(spark):
    df = spark.createDataFrame(
        [("a\"b", " ", None, 1), ("\t", "", None, 2), ("x", "y z", "q", 3)],
        "c1 string, c2 string, c3 string, ts long")
    src = df.withColumn("t", F.timestamp_seconds("ts")).drop("ts")
    got = [r.line for r in with_line_protocol(src, "m", time_col="t").collect()]
    assert got == ['m c1="a\\"b" 1000000000', 'm c1="x",c2="y z",c3="q" 3000000000']
    col_form = [r.l for r in src.select(line_protocol(src, "m", time_col="t").alias("l")).collect()]
    assert col_form == [got[0], None, got[1]]


def test_full_line_protocol_with_tags(spark):
    df = spark.createDataFrame([("dev 1", 5, 2.5, "a\\b", 0)],
                               "device string, n long, v double, s string, ts long")
    src = df.withColumn("t", F.timestamp_seconds("ts"))
    line = with_line_protocol(src, "my m", fields=["n", "v", "s"], time_col="t",
                              tags=["device"], compat=False).first().line
    assert line == 'my\\ m,device=dev\\ 1 n=5i,v=2.5,s="a\\\\b" 0'
    with pytest.raises(ValueError):
        line_protocol(src, "m", tags=["device"])


def test_line_protocol_sink_file_transport(spark, tmp_dir):
    df = spark.range(0, 23, numPartitions=3).select(
        F.col("id").cast("string").alias("k"), F.timestamp_seconds("id").alias("t"))
    sink = LineProtocolSink(url="", database="db", transport="file", path=tmp_dir,
                            time_col="t", batch_lines=4)
    sink.create_if_absent(df, "db.tbl")
    sink.write(df, "db.tbl")
    lines = [r.value for r in spark.read.text(tmp_dir).collect()]
    assert sorted(lines) == sorted(f'tbl k="{i}" {i * 10**9}' for i in range(23))


def test_line_protocol_sink_full_mode(spark, tmp_dir):
    df = spark.createDataFrame([("dev 1", 5, 0)], "device string, n long, ts long") \
        .withColumn("t", F.timestamp_seconds("ts")).drop("ts")
    LineProtocolSink(url="", database="db", transport="file", path=tmp_dir, time_col="t",
                     tags=("device",), compat=False).write(df, "db.m")
    assert [r.value for r in spark.read.text(tmp_dir).collect()] == ["m,device=dev\\ 1 n=5i 0"]


def test_ddl_and_profiles():
    assert clickhouse_create_table("d.t", ["a", "b"]) == (
        "CREATE TABLE IF NOT EXISTS d.t (a String, b Nullable(String), created_time "
        "DateTime DEFAULT now()) ENGINE = MergeTree() ORDER BY (a, created_time) "
        "PARTITION BY toYYYYMM(created_time)")
    ddl = doris_create_table("d.t", ["a", "b"])
    assert "DUPLICATE KEY(`a`)" in ddl and "BUCKETS 1" in ddl and "`b` String" in ddl
    assert normalise_profile(" ClickHouse ") == "clickhouse"
    with pytest.raises(ValueError):
        normalise_profile("oracle")
    assert warehouse_url("doris", "h", "db") == "jdbc:mysql://h:9030/db"
    assert warehouse_url("INFLUXDB", "h", "db") == "http://h:8086"
    with pytest.raises(ValueError):
        warehouse_url("clickhouse", "h", "db")
    assert isinstance(sink_for("influxdb", "http://h:8086", "db"), LineProtocolSink)
    assert isinstance(sink_for("Lake", "/data/lake", "db"), LakeSink)


def test_jdbc_sink_runs_ddl_once_per_target(spark):
    calls = []
    sink = JdbcSink("clickhouse", "jdbc:clickhouse://h:1/db",
                    {"user": "u", "password": "p"},
                    ddl_executor=lambda s, url, props, stmt: calls.append((url, props, stmt)),
                    batch_size=5000, num_partitions=16)
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    sink.create_if_absent(df, "db.t")
    assert calls[0][1]["driver"].endswith("ClickHouseDriver")
    assert (calls[0][1]["batchsize"], calls[0][1]["numPartitions"]) == ("5000", "16")
    assert calls[0][2].startswith("CREATE TABLE IF NOT EXISTS db.t (a String")
    with pytest.raises(ValueError):
        sink.create_statement(df.withColumn("created_time", F.lit(1)), "db.t")


def test_landing_columns_and_clash(spark):
    df = spark.createDataFrame([("1",)], "a string")
    assert with_landing_columns(df).columns == ["a", "created_time", "created_month"]
    with pytest.raises(ValueError):
        with_landing_columns(df.withColumn("created_time", F.lit("x")))


def test_spectrum_table_partition_pruning(spark, tmp_dir):
    df = spark.createDataFrame(
        [(rid, i, float(i), 1.0, 0.0) for rid in ("7", "8") for i in range(5)],
        "result_id string, sample_index long, frequency_hz double, magnitude double, "
        "phase double").withColumn("created_time", F.current_timestamp())
    append_spectrum(df, tmp_dir)
    back = read_spectrum(spark, tmp_dir, "7", SPECTRUM_SCHEMA)
    assert back.count() == 5
    assert back.schema["result_id"].dataType.simpleString() == "string"
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "result_id" in plan


def test_run_summary_text(spark):
    df = spark.createDataFrame([("a\"1",), ("a\"1",), ("b",)], "result_id string")
    got = {r.id: r for r in run_summary(df).collect()}
    assert got["b"].result == '{"resultId": "b", "dataCount": 1, "status": "completed"}'
    assert json.loads(got['a"1'].result) == {"resultId": 'a"1', "dataCount": 2,
                                             "status": "completed"}
    assert got["b"].status == "COMPLETED" and got["b"].created_time is not None


def test_ingest_plan_and_empty_guard(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    df = spark.createDataFrame([("1", "x"), (None, None), ("3", None)], "a string, b string")
    write_csv(df, src)
    sink = LakeSink(os.path.join(tmp_dir, "lake"))
    report = ingest_csv(spark, src, sink, "t1")
    assert (report.raw_rows, report.written_rows) == (3, 2)
    landed = spark.read.parquet(sink.table_path("t1"))
    assert sorted(tuple(r) for r in landed.select("a", "b").collect()) == \
        [("1", "x"), ("3", None)]
    empty = os.path.join(tmp_dir, "empty")
    write_csv(spark.createDataFrame([(None, None)], "a string, b string"), empty)
    with pytest.raises(EmptyInputError):
        ingest_csv(spark, empty, sink, "t2")


def test_analysis_plan_end_to_end(spark, tmp_dir):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spec_path, sum_path = os.path.join(tmp_dir, "spec"), os.path.join(tmp_dir, "sum")
    summary = run_analysis(
        spark, "SELECT ts, event_id, CAST(value AS STRING) AS amplitude FROM ev",
        "run-1", spec_path, sum_path, order_by=["ts", "event_id"], tables={"ev": events})
    n = events.count()
    assert json.loads(summary.first().result)["dataCount"] == n
    assert read_spectrum(spark, spec_path, "run-1").count() == n
    assert read_summary(spark, sum_path, "run-1").count() == 1
    assert read_summary(spark, sum_path, "missing").count() == 0
    assert find_summary(spark, sum_path, "missing") is None
    assert find_summary(spark, sum_path, "run-1").status == "COMPLETED"


def test_epoch_of_ntz_ignores_session_zone(spark):
    from wavelake.functions.time import epoch_micros, epoch_seconds
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:01.5' AS t")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = df.select(epoch_micros(df, "t").alias("us"),
                            epoch_seconds(df, "t").alias("s")).first()
            assert (row.us, row.s) == (1704067201500000, 1704067201)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_sink_drops_rows_without_fields(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1), (" ", 2), (None, 3)], "k string, ts long") \
        .withColumn("t", F.timestamp_seconds("ts")).drop("ts")
    LineProtocolSink(url="", database="db", transport="file", path=tmp_dir,
                     time_col="t").write(df, "db.m")
    lines = [r.value for r in spark.read.text(tmp_dir).collect()]
    assert lines == ['m k="a" 1000000000']


def test_http_writer_batches_and_checks_the_status():
    import pyarrow as pa
    from wavelake.sinks.lineproto import LineProtocolWriter, create_database
    sent = []

    def post(url, body, content_type=None, status=204):
        sent.append((url, body, content_type))
        return status

    writer = LineProtocolWriter({"url": "http://h:8086/", "database": "my db", "user": "u",
                                 "password": "p&", "batch_lines": "3"}, post=post)
    lines = [f"m v={i} {i}" for i in range(7)]
    batches = [pa.record_batch({"line": [*lines[:4], None]}), pa.record_batch({"line": lines[4:]})]
    done = writer.write(iter(batches))
    assert (done.lines, done.batches) == (7, 3)
    assert {u for u, _, _ in sent} == {"http://h:8086/write?db=my+db&u=u&p=p%26"}
    assert b"".join(b for _, b, _ in sent).decode().splitlines() == lines
    assert [b.count(b"\n") for _, b, _ in sent] == [3, 1, 3]
    failing = LineProtocolWriter({"url": "http://h", "database": "d"},
                                 post=lambda *a: post(*a, status=400))
    with pytest.raises(RuntimeError, match="400"):
        failing.write(iter(batches))
    with pytest.raises(ValueError):
        LineProtocolWriter({"url": "http://h"})
    sent.clear()
    assert create_database("http://h:1", "d b", post, "u", "p") == 204
    assert sent == [("http://h:1/query?u=u&p=p", b"q=CREATE+DATABASE+d+b",
                     "application/x-www-form-urlencoded")]


def test_sink_from_profile_and_host(spark):
    from wavelake.sinks.registry import warehouse_sink
    calls = []
    sink = warehouse_sink("InfluxDB", "host", "db", properties={"user": "u", "password": "p"},
                          post=lambda *a: calls.append(a) or 204)
    assert (sink.url, sink.properties["user"]) == ("http://host:8086", "u")
    sink.create_if_absent(None, "t")
    assert calls[0][0] == "http://host:8086/query?u=u&p=p"
    assert warehouse_sink("doris", "h", "d").url == "jdbc:mysql://h:9030/d"


def test_rows_without_a_time_column_are_points_of_their_own(spark):
    df = spark.range(0, 500, numPartitions=4).select(F.col("id").cast("string").alias("k"))
    lines = [r.line for r in with_line_protocol(df, "m").collect()]
    assert len({x.rsplit(" ", 1)[1] for x in lines}) == 500


def test_failed_attempts_leave_no_lines(spark, tmp_dir):
    """A file is committed by its task; what a failed attempt wrote is gone."""
    @F.udf("string")
    def breaks(i):
        if i == 900:
            raise ValueError("stop")
        return str(i)

    df = spark.range(0, 1000, numPartitions=2)
    sink = LineProtocolSink(url="", database="db", transport="file", path=f"{tmp_dir}/lp")
    with pytest.raises(Exception, match="stop"):
        sink.write(df.select(breaks("id").alias("k")), "m")
    sink.write(df.select(F.col("id").cast("string").alias("k")), "m")
    assert spark.read.text(f"{tmp_dir}/lp").count() == 1000


def test_analysis_into_a_jdbc_sink(spark, tmp_dir):
    class Recorded(JdbcSink):
        def write(self, df, table):
            written[table] = df.collect()

    ddl, written = [], {}
    sink = Recorded("clickhouse", "jdbc:clickhouse://h:1/d",
                    ddl_executor=lambda s, url, props, stmt: ddl.append(stmt))
    events = spark.createDataFrame([(i, float(i)) for i in range(5)], "n long, amplitude double")
    run_analysis(spark, "SELECT * FROM ev", "r", "d.spectrum", "d.summary", ["n"],
                 tables={"ev": events}, sink=sink)
    assert ddl == [spectrum_create_table("d.spectrum")]
    assert len(written["d.spectrum"]) == 5 and written["d.summary"][0].id == "r"
    with pytest.raises(ValueError):
        JdbcSink("doris", "jdbc:mysql://h/d").write_spectrum(events, "t")


def test_rerun_replaces_the_result_and_leaves_no_scratch(spark, tmp_dir):
    from wavelake.session import scratch_root
    events = spark.createDataFrame([(i, float(i)) for i in range(9)], "n long, amplitude double")

    def tables():
        return set(os.listdir(scratch_root(spark).removeprefix("file:"))) \
            if os.path.isdir(scratch_root(spark).removeprefix("file:")) else set()

    before = tables()
    for rid in ("a", "b", "a"):
        run_analysis(spark, "SELECT * FROM ev", rid, f"{tmp_dir}/s", f"{tmp_dir}/m", ["n"],
                     tables={"ev": events})
    assert tables() == before
    assert read_spectrum(spark, f"{tmp_dir}/s", "a").count() == 9
    assert spark.read.parquet(f"{tmp_dir}/s").count() == 18
    assert read_summary(spark, f"{tmp_dir}/m", "a").count() == 1


def test_clickhouse_names_are_quoted_where_needed():
    ddl = clickhouse_create_table("d.t", ["a b", "order", "c`d"])
    assert "(`a b` String, `order` Nullable(String), `c\\`d` Nullable(String)," in ddl
    assert "ORDER BY (`a b`, created_time)" in ddl


def test_bucketed_files_do_not_grow_with_tasks(spark, tmp_dir):
    from wavelake.sinks.lake import append_bucketed
    df = spark.range(0, 4000, numPartitions=16).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), F.col("id").cast("string").alias("v"))
    try:
        append_bucketed(df, "wl_bucket_test", f"{tmp_dir}/b", buckets=4, files_per_bucket=3)
        files = glob.glob(f"{tmp_dir}/b/part-*.parquet")
        assert len(files) <= 12 and spark.table("wl_bucket_test").count() == 4000
        sizes = [r["count"] for r in spark.read.parquet(*files).withColumn(
            "f", F.input_file_name()).groupBy("f").count().collect()]
        assert max(sizes) < 1500
    finally:
        spark.sql("DROP TABLE IF EXISTS wl_bucket_test")

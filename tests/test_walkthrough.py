"""The documented flow end to end: a signal CSV lands in a task folder,
is ingested into the lake, analysed by a SQL query over the landed table,
and its spectrum and summary are looked up by result id.  The signal is a
synthesised 1 kHz-sampled tone (FIXTURES F1 layout, all cells text)."""

import json
import math
import os

from pyspark.sql import functions as F

from wavelake.plans.analysis import run_analysis
from wavelake.plans.ingest import ingest_csv
from wavelake.sinks.lake import LakeSink, read_spectrum, read_summary
from wavelake.sources.lake import task_object_uri


def _signal_csv(path, n=51):
    lines = ["timestamp,amplitude,frequency,phase,signal_type"]
    for i in range(n):
        t = i / 1000.0
        lines.append(f"{t:.3f},{math.cos(2 * math.pi * 7.0 * t):.3f},50.0,0.0,sine")
    lines.append(",,,,")             # an all-empty row
    lines.append("0.051,n/a,50.0,0.0,sine")  # amplitude that does not parse
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("\n".join(lines))    # no final newline, like the sample


def test_upload_ingest_analyse_lookup(spark, tmp_dir):
    raw = task_object_uri(os.path.join(tmp_dir, "bucket"), 1, "signal.csv")
    _signal_csv(raw)
    sink = LakeSink(os.path.join(tmp_dir, "lake"))
    report = ingest_csv(spark, raw, sink, "task_1_data")
    assert (report.raw_rows, report.written_rows) == (53, 52)

    landed = spark.read.parquet(sink.table_path("task_1_data"))
    data_cols = landed.drop("created_time", "created_month").schema
    assert {f.dataType.simpleString() for f in data_cols} == {"string"}
    spec_path, sum_path = os.path.join(tmp_dir, "spec"), os.path.join(tmp_dir, "sum")
    summary = run_analysis(
        spark, "SELECT * FROM task_1_data", "res-1", spec_path, sum_path,
        order_by=[F.col("timestamp").cast("double")], tables={"task_1_data": landed})
    assert json.loads(summary.first().result) == {
        "resultId": "res-1", "dataCount": 51, "status": "completed"}

    spec = read_spectrum(spark, spec_path, "res-1").orderBy("sample_index").collect()
    assert [r.sample_index for r in spec] == list(range(51))
    assert spec[0].magnitude == 1.0 and spec[0].frequency_hz == 0.0
    assert spec[1].frequency_hz == 1000.0 / 51
    assert all(r.phase == 0.0 and r.created_time is not None for r in spec)
    assert read_summary(spark, sum_path, "res-1").first().status == "COMPLETED"

"""P2 — spectrum analysis: SQL query -> coerce -> index -> spectrum table ->
append -> run summary.

The spectrum is written once; its row count is observed during that write
and becomes the summary, so no extra job runs over the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.operators.quality import (SUMMARY_FORMAT, SUMMARY_STATUS_ROW,
                                        observe_rows)
from wavelake.operators.spectrum import spectrum
from wavelake.sinks.lake import SUMMARY_SCHEMA, append_spectrum, append_summary
from wavelake.session import scratch_scope
from wavelake.sources.sql import run_sql


def summary_frame(spark: SparkSession, result_id: str, count: int) -> DataFrame:
    """A5 for one finished run (one row built from the observed count)."""
    rid = result_id.replace("\\", "\\\\").replace('"', '\\"')
    row = [(result_id, SUMMARY_FORMAT % (rid, count), SUMMARY_STATUS_ROW, None)]
    return (spark.createDataFrame(row, SUMMARY_SCHEMA)
            .withColumn("created_time", F.current_timestamp()))


def run_analysis(spark: SparkSession, query: str, result_id: str, spectrum_path: str,
                 summary_path: str, order_by: Sequence[str | Column] | None,
                 tables: Mapping[str, DataFrame] | None = None,
                 amplitude_col: str = "amplitude",
                 sample_rate: float = 1000.0,
                 source: Callable[[SparkSession, str], DataFrame] | None = None,
                 sink=None) -> DataFrame:
    """Run the analysis of ``query`` and return its summary row.

    The query runs on Spark over ``tables`` / registered views (S4) unless
    ``source`` reads it elsewhere, e.g. in a warehouse over JDBC (S3):
    ``source=lambda s, q: read_query(s, url, q, props, ...)``.  The spectrum
    and the summary go to lake folders, or with ``sink`` (K7) to that
    warehouse's tables of these names.  On a lake a re-run replaces the result
    of the same id.  Intermediate tables are deleted at the end."""
    put_spectrum = sink.write_spectrum if sink is not None else append_spectrum
    put_summary = sink.write_summary if sink is not None else append_summary
    with scratch_scope(spark):
        data = source(spark, query) if source else run_sql(spark, query, tables)
        spec = spectrum(data, result_id, order_by, amplitude_col=amplitude_col,
                        sample_rate=sample_rate)
        observed, obs = observe_rows(spec, "spectrum")
        put_spectrum(observed, spectrum_path)
        summary = summary_frame(spark, result_id, obs.get["rows"])
        put_summary(summary, summary_path)
    return summary

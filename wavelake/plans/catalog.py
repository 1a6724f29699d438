"""Registered queries: one per operator of the inventory, each reading the
driver's tables (or data Spark derives from them) in full, plus the DuckDB
SQL that must give the same rows.

Stand-ins (see FIXTURES.md): ``events.value`` is the amplitude, ``ts`` then
``event_id`` the sample order and ``event_type`` the series.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions.lineproto import measurement_name, with_line_protocol
from wavelake.functions.numeric import as_double
from wavelake.ml.minmax import ColumnMinMaxScaler, ColumnMinMaxScalerModel
from wavelake.operators.blocks import clean_blocks, file_blocks, file_folder, ordered_blocks
from wavelake.operators.clean import drop_all_null, drop_noise_lines, parse_fields
from wavelake.operators.dft import framed_dft
from wavelake.operators.quality import preview, quality_counts, run_summary
from wavelake.operators.scaling import minmax_bounds, minmax_scale, minmax_scale_narrow
from wavelake.operators.spectrum import spectrum
from wavelake.plans import derived
from wavelake.plans.analysis import run_analysis
from wavelake.plans.ingest import ingest_csv
from wavelake.plans.logs import clean_log_stateful, clean_log_stateless
from wavelake.plans.tables import register_views, table, tables_named_in
from wavelake.session import scratch_path
from wavelake.sinks.lake import (SPECTRUM_SCHEMA, LakeSink, append_bucketed, append_spectrum,
                                 read_spectrum, read_summary)
from wavelake.sinks.registry import sink_for
from wavelake.sources.csv import read_csv_strings, write_csv
from wavelake.sources.lake import read_task_csv, task_folder
from wavelake.sources.sql import run_sql
from wavelake.sources.text import read_lines

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

RESULT_ID = "r1"


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle.strip()
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    from wavelake.plans import series_catalog  # noqa: F401 - registers its queries here
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)


def _events_as_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumnRenamed("value", "amplitude")


# --------------------------------------------------------------- spectrum
@query("spectrum", oracle="""
WITH s AS (
  SELECT ts, event_id, TRY_CAST(value AS DOUBLE) AS amp
  FROM events WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL)
SELECT 'r1' AS result_id,
       CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS sample_index,
       CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS DOUBLE) * CAST(1000.0 AS DOUBLE)
         / CAST(count(*) OVER () AS DOUBLE) AS frequency_hz,
       abs(amp) AS magnitude,
       CAST(0.0 AS DOUBLE) AS phase
FROM s
""")
def q_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6–T12 with the T7 index over the whole table, ordered by (ts, event_id)."""
    return spectrum(_events_as_signal(spark, sf_dir), RESULT_ID,
                    order_by=["ts", "event_id"], with_created_time=False)


_SPECTRUM_BY_SERIES_SQL = """
WITH s AS (
  SELECT event_type, ts, event_id, TRY_CAST(value AS DOUBLE) AS amp
  FROM events WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL)
SELECT event_type,
       'r1-' || event_type AS result_id,
       CAST(row_number() OVER w - 1 AS BIGINT) AS sample_index,
       CAST(row_number() OVER w - 1 AS DOUBLE) * CAST(1000.0 AS DOUBLE)
         / CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE) AS frequency_hz,
       abs(amp) AS magnitude,
       CAST(0.0 AS DOUBLE) AS phase
FROM s
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
"""


@query("spectrum_by_series", oracle=_SPECTRUM_BY_SERIES_SQL)
def q_spectrum_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk form: index and N restart per series; hot series stay balanced."""
    return spectrum(_events_as_signal(spark, sf_dir),
                    F.concat(F.lit(RESULT_ID + "-"), F.col("event_type")),
                    order_by=["ts", "event_id"], series=["event_type"],
                    with_created_time=False)


# --------------------------------------------------------------- cleaning

_SPARSE = f"sparse AS ({derived.SPARSE_EVENTS_SQL})"
_LINES = f"lines AS ({derived.EVENT_LINES_SQL})"


@query("drop_all_null", oracle=f"""
WITH {_SPARSE}
SELECT * FROM sparse WHERE NOT ({derived.SPARSE_ALL_NULL_SQL})
""")
def q_drop_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 on a landed table with null cells and all-null rows."""
    return drop_all_null(derived.sparse_events(table(spark, sf_dir, "events")))


@query("quality_counts", oracle=f"""
WITH {_SPARSE}
SELECT count(*) AS raw_rows,
       count(*) FILTER (WHERE NOT ({derived.SPARSE_ALL_NULL_SQL})) AS cleaned_rows,
       count(*) FILTER (WHERE {derived.SPARSE_ALL_NULL_SQL}) AS dropped_rows,
       count(*) FILTER (WHERE NOT ({derived.SPARSE_ALL_NULL_SQL})) = 0 AS is_empty
FROM sparse
""")
def q_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2: raw / cleaned / dropped counters in one aggregation."""
    return quality_counts(derived.sparse_events(table(spark, sf_dir, "events")))


@query("text_filter_lines", oracle=f"""
WITH {_LINES}
SELECT value FROM lines
WHERE NOT (regexp_matches(value, '^\\[.*') OR regexp_matches(value, '^timestamp.*'))
""")
def q_text_filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: drop log and header lines by pattern (indented log lines stay)."""
    lines = derived.event_lines(table(spark, sf_dir, "events"))
    return drop_noise_lines(lines).select("value")


@query("text_parse_fields", oracle=f"""
WITH {_LINES}
SELECT TRY_CAST(split_part(value, ',', 1) AS BIGINT) AS timestamp,
       TRY_CAST(split_part(value, ',', 2) AS DOUBLE) AS sensor_A,
       TRY_CAST(split_part(value, ',', 3) AS DOUBLE) AS sensor_B
FROM lines
WHERE NOT (regexp_matches(value, '^\\[.*') OR regexp_matches(value, '^timestamp.*'))
""")
def q_text_parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + T3 (the stateless cleaning): malformed cells become nulls."""
    lines = derived.event_lines(table(spark, sf_dir, "events"))
    return parse_fields(drop_noise_lines(lines))


@query("log_blocks", oracle=f"""
WITH {_LINES},
m AS (
  SELECT event_id, value,
         CASE WHEN starts_with(trim(value), '[') THEN 0
              WHEN starts_with(trim(value), 'timestamp') THEN 1 END AS marker
  FROM lines),
s AS (
  SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (
              ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state
  FROM m),
p AS (
  SELECT TRY_CAST(split_part(trim(value), ',', 1) AS BIGINT) AS timestamp,
         TRY_CAST(split_part(trim(value), ',', 2) AS DOUBLE) AS sensor_A,
         TRY_CAST(split_part(trim(value), ',', 3) AS DOUBLE) AS sensor_B
  FROM s WHERE marker IS NULL AND state = 1)
SELECT * FROM p
WHERE timestamp IS NOT NULL AND sensor_A IS NOT NULL AND sensor_B IS NOT NULL
""")
def q_log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + T5 (the stateful cleaning) over all lines in event_id order."""
    lines = derived.event_lines(table(spark, sf_dir, "events"))
    return clean_blocks(ordered_blocks(lines, order_by=["event_id"], keep=[]))


# --------------------------------------------------------------- scaling


def _scaled_sql(x: str, src: str, fit_src: str | None = None) -> str:
    fit_src = fit_src or src
    lo = f"(SELECT min({x}) FROM {fit_src})"
    hi = f"(SELECT max({x}) FROM {fit_src})"
    return (f"CASE WHEN {hi} - {lo} = 0 THEN CAST(0.5 AS DOUBLE) "
            f"ELSE (CAST({x} AS DOUBLE) - {lo}) / ({hi} - {lo}) END")


@query("minmax_scale", oracle=f"""
SELECT event_id, value, {_scaled_sql('value', 'events')} AS scaled FROM events
""")
def q_minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + A3 over events.value (bounds as one scalar subquery)."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return minmax_scale(events, "value", "scaled")


@query("minmax_scale_lineitem", oracle=f"""
SELECT l_orderkey, l_linenumber, l_quantity,
       {_scaled_sql('l_quantity', 'lineitem')} AS scaled
FROM lineitem
""")
def q_minmax_scale_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 over the largest table."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return minmax_scale(li, "l_quantity", "scaled")


_CONSTANT_SQL = """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(50.0 AS DOUBLE) END AS frequency
FROM events
"""


@query("minmax_constant", oracle=f"""
WITH c AS ({_CONSTANT_SQL})
SELECT event_id, frequency, {_scaled_sql('frequency', 'c')} AS scaled FROM c
""")
def q_minmax_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 on a constant column with nulls: 0.5 on every row."""
    events = table(spark, sf_dir, "events")
    const = events.select("event_id", F.when(F.col("event_type") != "error",
                                             F.lit(50.0)).alias("frequency"))
    return minmax_scale(const, "frequency", "scaled")


_UNSEEN_SQL = f"""
SELECT event_id, value,
       {_scaled_sql('value', 'events', "events WHERE event_type = 'view'")} AS scaled
FROM events
"""


@query("scaler_transform_unseen", oracle=_UNSEEN_SQL)
def q_scaler_transform_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M3: fit the estimator on view events, transform every event."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    model = ColumnMinMaxScaler(inputCol="value", outputCol="scaled").fit(
        events.filter(F.col("event_type") == "view"))
    return model.transform(events).select("event_id", "value", "scaled")


@query("scale_narrow", oracle=f"""
SELECT value, {_scaled_sql('value', 'events')} AS scaled FROM events
""")
def q_scale_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: two non-null columns [value, scaled]."""
    return minmax_scale_narrow(table(spark, sf_dir, "events"), "value")


# --------------------------------------------------------------- rendering / summary

_LP_TABLE, _LP_DATABASE = "warehouse.task_1_data", "warehouse"


def _lp_field_sql(name: str, expr: str) -> str:
    text = f"CAST({expr} AS VARCHAR)"
    return (f"CASE WHEN regexp_matches({text}, '[^\\x00-\\x20]') THEN "
            f"'{name}=\"' || replace({text}, '\"', '\\\"') || '\"' END")


_LP_SOURCE_SQL = """
SELECT ts, event_id, event_type, value, props,
       CASE WHEN event_type = 'error' THEN NULL
            WHEN event_type = 'view' THEN '  '
            ELSE 'ok ' || event_type END AS note
FROM events
"""


_LINE_PROTOCOL_SQL = f"""
WITH src AS ({_LP_SOURCE_SQL}),
f AS (
  SELECT ts, concat_ws(',', {_lp_field_sql('event_id', 'event_id')},
                            {_lp_field_sql('event_type', 'event_type')},
                            {_lp_field_sql('value', 'value')},
                            {_lp_field_sql('props', 'props')},
                            {_lp_field_sql('note', 'note')}) AS fields
  FROM src)
SELECT 'task_1_data' || ' ' || fields || ' ' || CAST(epoch_us(ts) * 1000 AS VARCHAR) AS line
FROM f WHERE fields <> ''
"""


@query("line_protocol", oracle=_LINE_PROTOCOL_SQL)
def q_line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13: compatible line protocol; null and blank fields skipped, quotes
    escaped, timestamp (ns) from ``ts``."""
    src = _lp_source(spark, sf_dir)
    return with_line_protocol(src, measurement_name(_LP_TABLE, _LP_DATABASE), time_col="ts")


def _lp_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "ts", "event_id", "event_type", "value", "props",
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .when(F.col("event_type") == "view", F.lit("  "))
        .otherwise(F.concat(F.lit("ok "), F.col("event_type"))).alias("note"))


@query("run_summary", oracle="""
SELECT 'r1-' || event_type AS id,
       printf('{"resultId": "%s", "dataCount": %d, "status": "completed"}',
              'r1-' || event_type, count(*)) AS result,
       'COMPLETED' AS status
FROM events WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL
GROUP BY event_type
""")
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: one summary per result.  A spectrum has one row per coerced sample,
    so the samples are counted and no spectrum is made."""
    samples = table(spark, sf_dir, "events").filter(as_double("value").isNotNull())
    ids = samples.select(F.concat(F.lit(RESULT_ID + "-"), F.col("event_type")).alias("result_id"))
    return run_summary(ids, with_created_time=False)


@query("preview_cleaned", oracle=f"""
WITH {_SPARSE}
SELECT * FROM sparse WHERE NOT ({derived.SPARSE_ALL_NULL_SQL})
ORDER BY event_id LIMIT 5
""")
def q_preview_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14: the first rows of the cleaned table (top-n, no full sort)."""
    cleaned = drop_all_null(derived.sparse_events(table(spark, sf_dir, "events")))
    return preview(cleaned, 5, order_by=["event_id"])


# --------------------------------------------------------------- written tables


@query("result_lookup", oracle=f"""
SELECT result_id, sample_index, frequency_hz, magnitude, phase
FROM ({_SPECTRUM_BY_SERIES_SQL}) WHERE result_id = 'r1-view'
""")
def q_result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 + K10: write the bulk spectrum partitioned by result id, read one
    result back (partition-pruned)."""
    spec = q_spectrum_by_series(spark, sf_dir).drop("event_type")
    path = scratch_path(spark, "spectrum")
    append_spectrum(spec.withColumn("created_time", F.current_timestamp()), path)
    return read_spectrum(spark, path, "r1-view", SPECTRUM_SCHEMA).drop("created_time")


_STRING_SPARSE_SQL = f"""
WITH {_SPARSE}
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
       event_type, CAST(value AS VARCHAR) AS value, props
FROM sparse WHERE NOT ({derived.SPARSE_ALL_NULL_SQL})
"""


@query("csv_roundtrip", oracle=_STRING_SPARSE_SQL)
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + T1: landed table written as header CSV, scanned back all-string,
    all-null rows dropped."""
    path = scratch_path(spark, "csv")
    write_csv(derived.sparse_events(table(spark, sf_dir, "events")), path)
    return drop_all_null(read_csv_strings(spark, path))


@query("ingest_lake", oracle=_STRING_SPARSE_SQL)
def q_ingest_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 end to end: CSV -> clean -> guard -> lake table (created_time,
    month partitions) -> read back without the landing columns."""
    src = scratch_path(spark, "landing")
    write_csv(derived.sparse_events(table(spark, sf_dir, "events")), src)
    sink = LakeSink(scratch_path(spark, "lake"))
    ingest_csv(spark, src, sink, "task_1_data")
    landed = spark.read.parquet(sink.table_path("task_1_data"))
    return landed.select("event_id", "user_id", "event_type", "value", "props")


# --------------------------------------------------------------- ad-hoc SQL (S4)

_SQL_JOIN_AGG = """
SELECT n.n_name AS nation, c.c_mktsegment AS segment, count(*) AS orders,
       round(sum(o.o_totalprice), 2) AS revenue
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, c.c_mktsegment
"""
_SQL_ROLLUP = """
SELECT l_returnflag, l_linestatus, count(*) AS lines,
       round(sum(l_quantity), 2) AS qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem
GROUP BY ROLLUP (l_returnflag, l_linestatus)
"""
_SQL_WINDOW_RANK = """
SELECT o_custkey, o_orderkey, o_totalprice, rnk FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
              AS BIGINT) AS rnk
  FROM orders) t
WHERE rnk <= 3
"""
_SQL_SET_OPS = """
SELECT 'customer_only' AS side, nk FROM (
  SELECT c_nationkey AS nk FROM customer EXCEPT SELECT s_nationkey FROM supplier) a
UNION ALL
SELECT 'both' AS side, nk FROM (
  SELECT c_nationkey AS nk FROM customer INTERSECT SELECT s_nationkey FROM supplier) b
UNION ALL
SELECT 'any' AS side, nk FROM (
  SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier) c
"""
_SQL_SEMI_ANTI = """
SELECT c_custkey, 'with_orders' AS kind FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
              AND o.o_orderstatus = 'F')
UNION ALL
SELECT c_custkey, 'without_orders' AS kind FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                  AND o.o_orderstatus = 'F')
"""
_SQL_JSON_DATE_SPARK = """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events,
       CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       CAST(max(hour(ts)) AS BIGINT) AS last_hour
FROM events
GROUP BY CAST(ts AS DATE), event_type
"""
_SQL_JSON_DATE_DUCK = """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       CAST(max(hour(ts)) AS BIGINT) AS last_hour
FROM events
GROUP BY CAST(ts AS DATE), event_type
"""


def _sql_query(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, tables_named_in(spark_sql))
        return run_sql(spark, spark_sql)
    fn.__name__ = f"q_{name}"
    fn.__doc__ = "S4: ad-hoc SQL over the registered tables."
    query(name, oracle=duck_sql or spark_sql)(fn)


_sql_query("sql_join_agg", _SQL_JOIN_AGG)
_sql_query("sql_rollup", _SQL_ROLLUP)
_sql_query("sql_window_rank", _SQL_WINDOW_RANK)
_sql_query("sql_set_ops", _SQL_SET_OPS)
_sql_query("sql_semi_anti", _SQL_SEMI_ANTI)
_sql_query("sql_json_date", _SQL_JSON_DATE_SPARK, _SQL_JSON_DATE_DUCK)

_SQL_RUNNING_WINDOW = """
SELECT o_custkey, o_orderkey, o_orderdate,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)
         AS running_total,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
         AS prev_order
FROM orders
"""
_SQL_DISTINCT_HAVING = """
SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(*) AS lines
FROM lineitem
GROUP BY l_suppkey
HAVING count(DISTINCT l_partkey) > 5
"""
_SQL_TOPK = """
SELECT o_orderkey, o_custkey, o_totalprice
FROM orders
ORDER BY o_totalprice DESC, o_orderkey
LIMIT 10
"""
_SQL_CORRELATED = """
SELECT c.c_custkey, c.c_name,
       (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders,
       (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS max_price
FROM customer c
"""
_SQL_CASE_STRINGS = """
SELECT p_brand, upper(substr(p_type, 1, 5)) AS type_prefix, count(*) AS parts,
       CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large,
       CAST(max(length(p_name)) AS BIGINT) AS longest_name
FROM part
GROUP BY p_brand, upper(substr(p_type, 1, 5))
"""

_sql_query("sql_running_window", _SQL_RUNNING_WINDOW)
_sql_query("sql_distinct_having", _SQL_DISTINCT_HAVING)
_sql_query("sql_topk", _SQL_TOPK)
_sql_query("sql_correlated", _SQL_CORRELATED)
_sql_query("sql_case_strings", _SQL_CASE_STRINGS)

_SQL_CUBE = """
SELECT o_orderstatus, o_orderpriority, count(*) AS orders,
       round(sum(o_totalprice), 2) AS total
FROM orders
GROUP BY CUBE (o_orderstatus, o_orderpriority)
"""
_SQL_IN_SUBQUERY = """
SELECT s_suppkey, s_name, s_nationkey
FROM supplier
WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN
                      (SELECT r_regionkey FROM region WHERE r_regionkey < 3))
  AND NOT EXISTS (SELECT 1 FROM lineitem
                  WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)
"""
_SQL_RANKING = """
SELECT c_custkey, c_mktsegment, c_acctbal,
       CAST(ntile(4) OVER fine AS BIGINT) AS quartile,
       percent_rank() OVER fine AS pct_rank,
       CAST({nation_rank} AS BIGINT) AS nation_rank,
       lead(c_custkey, 2) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS lead2
FROM customer
WINDOW fine AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey)
"""
# The rank among distinct keys is a place in their sorted set, an aggregate; a
# window without a partition key would put every row in one task.
_NATION_RANK = ("array_position((SELECT array_sort(collect_set(c_nationkey)) FROM customer), "
                "c_nationkey)")
_sql_query("sql_cube", _SQL_CUBE)
_sql_query("sql_in_subquery", _SQL_IN_SUBQUERY)
_sql_query("sql_ranking", _SQL_RANKING.format(nation_rank=_NATION_RANK),
           _SQL_RANKING.format(nation_rank="dense_rank() OVER (ORDER BY c_nationkey)"))


# --------------------------------------------------------------- real spectrum (X1)

def _dft_sql(n: int) -> str:
    """Direct transform of frames of ``n`` samples per event type.  Values are
    rounded (sums differ in their last digits); a phase is compared where the
    magnitude is not about zero."""
    return f"""
WITH s AS (
  SELECT event_type, TRY_CAST(value AS DOUBLE) AS x,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n
  FROM events WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL),
f AS (SELECT event_type, n // {n} AS frame, n % {n} AS pos, x,
             unnest(range({n // 2 + 1})) AS bin FROM s),
d AS (
  SELECT event_type, frame, bin,
         sum(x * cos(2 * pi() * ((bin * pos) % {n}) / {n})) AS re,
         CASE WHEN bin = 0 OR bin = {n // 2} THEN 0.0
              ELSE -sum(x * sin(2 * pi() * ((bin * pos) % {n}) / {n})) END AS im
  FROM f
  GROUP BY event_type, frame, bin)
SELECT event_type, CAST(frame AS BIGINT) AS frame, CAST(bin AS BIGINT) AS bin,
       CAST(bin AS DOUBLE) * CAST(1000.0 AS DOUBLE) / CAST({n} AS DOUBLE) AS frequency_hz,
       round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im,
       round(sqrt(re * re + im * im), 4) + 0.0 AS magnitude,
       CASE WHEN sqrt(re * re + im * im) > 0.01 THEN round(atan2(im, re), 4) + 0.0 END AS phase
FROM d
"""


def _dft_query(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    events = table(spark, sf_dir, "events")
    dft = framed_dft(events, "value", ["ts", "event_id"], series=["event_type"], frame_size=n)
    return dft.select(
        "event_type", "frame", "bin", "frequency_hz",
        *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("re", "im", "magnitude")],
        F.when(F.col("magnitude") > 0.01, F.round("phase", 4) + F.lit(0.0)).alias("phase"))


@query("dft_frames", oracle=_dft_sql(64))
def q_dft_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1: real DFT per series over frames of 64 samples, its own magnitude
    and phase."""
    return _dft_query(spark, sf_dir, 64)


@query("dft_frames_1024", oracle=_dft_sql(1024))
def q_dft_frames_1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with frames of 1024 samples."""
    return _dft_query(spark, sf_dir, 1024)


# --------------------------------------------------------------- more end-to-end jobs


@query("minmax_bounds", oracle="SELECT min(value) AS min, max(value) AS max FROM events")
def q_minmax_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: fused global min and max, one pass, one row."""
    return minmax_bounds(table(spark, sf_dir, "events"), "value")


@query("scaler_persisted", oracle=_UNSEEN_SQL)
def q_scaler_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M5: fit, save to the shared folder, load, transform every event."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    model = ColumnMinMaxScaler(inputCol="value", outputCol="scaled").fit(
        events.filter(F.col("event_type") == "view"))
    path = scratch_path(spark, "scaler")
    model.save(path)
    loaded = ColumnMinMaxScalerModel.load(path)
    return loaded.transform(events).select("event_id", "value", "scaled")


@query("analysis_summary", oracle="""
SELECT 'r1' AS id,
       printf('{"resultId": "%s", "dataCount": %d, "status": "completed"}', 'r1', count(*))
         AS result,
       'COMPLETED' AS status
FROM events WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL
""")
def q_analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 end to end (S4 query -> spectrum table K8 -> summary K9), then the
    summary looked up by id (K10)."""
    register_views(spark, sf_dir, ("events",))
    spec_path, sum_path = scratch_path(spark, "spectrum"), scratch_path(spark, "summary")
    run_analysis(spark, "SELECT ts, event_id, value AS amplitude FROM events", RESULT_ID,
                 spec_path, sum_path, order_by=["ts", "event_id"])
    return read_summary(spark, sum_path, RESULT_ID).drop("created_time")


@query("line_protocol_sink", oracle=_LINE_PROTOCOL_SQL)
def q_line_protocol_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + K7: the profile's sink writes points from the executors (file
    transport into the shared folder), read back as text."""
    path = scratch_path(spark, "points")
    sink = sink_for("influxdb", "", _LP_DATABASE, transport="file", path=path, time_col="ts")
    sink.write(_lp_source(spark, sf_dir), _LP_TABLE)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("line_protocol_full", oracle="""
SELECT 'm\\ 1,event_type=' || event_type || ' event_id=' || CAST(event_id AS VARCHAR) || 'i'
       || coalesce(',value=' || CAST(value AS VARCHAR), '')
       || ' ' || CAST(epoch_us(ts) * 1000 AS VARCHAR) AS line
FROM events
""".replace("\\\\", "\\"))
def q_line_protocol_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13, full form: escaped measurement, a tag, typed integer and float fields."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value", "ts")
    return with_line_protocol(events, "m 1", time_col="ts", tags=["event_type"], compat=False)


@query("ingest_bucketed", oracle=_STRING_SPARSE_SQL)
def q_ingest_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + T1 + K5 (lake form): landed rows in a table bucketed on the first
    column, read back through the catalog."""
    src = scratch_path(spark, "landing")
    write_csv(derived.sparse_events(table(spark, sf_dir, "events")), src)
    cleaned = drop_all_null(read_csv_strings(spark, src))
    name = f"landed_{uuid.uuid4().hex[:12]}"
    append_bucketed(cleaned, name, scratch_path(spark, name), buckets=8)
    landed = spark.table(name).select("event_id", "user_id", "event_type", "value", "props")
    spark.sql(f"DROP TABLE {name}")  # external: the rows stay for the planned read
    return landed


_TASK_SPLIT = "event_type IN ('view', 'click')"


@query("lake_scan", oracle=f"""
WITH tagged AS (
  SELECT *, CASE WHEN {_TASK_SPLIT} THEN '1' ELSE '2' END AS task_id FROM events),
sparse AS ({derived.sparse_sql('tagged', 'task_id, ')})
SELECT task_id, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
       event_type, CAST(value AS VARCHAR) AS value,
       CASE WHEN task_id = '1' THEN props END AS props,
       CASE WHEN task_id = '2' THEN upper(event_type) END AS kind
FROM sparse WHERE NOT ({derived.SPARSE_ALL_NULL_SQL})
""")
def q_lake_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S1 + T1: raw objects laid out as ``root/task_<id>/``, scanned in
    one job with the task id recovered from each file's path.  The two tasks
    differ in column order and width."""
    events = table(spark, sf_dir, "events")
    root = scratch_path(spark, "lake")
    in_first = F.col("event_type").isin("view", "click")
    write_csv(derived.sparse_events(events.filter(in_first)), task_folder(root, 1))
    other = derived.sparse_events(events.filter(~in_first)).select(
        "value", F.upper("event_type").alias("kind"), "event_type", "event_id", "user_id")
    write_csv(other, task_folder(root, 2))
    scanned = read_task_csv(spark, root)
    return drop_all_null(scanned, subset=[c for c in scanned.columns if c != "task_id"])


# --------------------------------------------------------------- log files (S2)

_LOG_BLOCKS_SQL = _ORACLES["log_blocks"]
_TEXT_PARSE_SQL = _ORACLES["text_parse_fields"]


def _rotated_log(spark: SparkSession, sf_dir: str) -> str:
    """The rendered lines written as a rotated log: range-partitioned on the
    line order, so ``part-00000``, ``part-00001``, ... hold consecutive
    lines (one file per task, no task holds the whole log)."""
    lines = derived.event_lines(table(spark, sf_dir, "events"))
    path = scratch_path(spark, "log")
    (lines.repartitionByRange("event_id").sortWithinPartitions("event_id")
     .select("value").write.text(path))
    return path


@query("log_blocks_files", oracle=_LOG_BLOCKS_SQL)
def q_log_blocks_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + T4 + T5 over text files: state carried across the splits and
    the rotated files of one folder."""
    lines = read_lines(spark, _rotated_log(spark, sf_dir))
    return clean_blocks(file_blocks(lines, stream_of=file_folder()))


@query("text_parse_files", oracle=_TEXT_PARSE_SQL)
def q_text_parse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 over text files (S2 + T2 + T3)."""
    return clean_log_stateless(spark, _rotated_log(spark, sf_dir))


_PIPE_LINES = f"pipes AS (SELECT event_id, replace(value, ',', '|') AS value FROM ({derived.EVENT_LINES_SQL}))"


@query("text_parse_pipe", oracle=f"""
WITH {_PIPE_LINES}
SELECT TRY_CAST(split_part(value, '|', 1) AS BIGINT) AS timestamp,
       TRY_CAST(split_part(value, '|', 2) AS DOUBLE) AS sensor_A,
       TRY_CAST(split_part(value, '|', 3) AS DOUBLE) AS sensor_B
FROM pipes
WHERE NOT (regexp_matches(value, '^\\[.*') OR regexp_matches(value, '^timestamp.*'))
""")
def q_text_parse_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + T3 with a separator that is a regular-expression character."""
    lines = derived.event_lines(table(spark, sf_dir, "events")).select(
        F.replace("value", F.lit(","), F.lit("|")).alias("value"))
    return parse_fields(drop_noise_lines(lines), sep="|")


def _block_rows_sql(source: str, stream: str, keep: str = "") -> str:
    """T4 + T5 over ``source`` (``event_id``, ``value``), restarting per ``stream``."""
    return f"""
m AS (
  SELECT *, CASE WHEN starts_with(trim(value), '[') THEN 0
                 WHEN starts_with(trim(value), 'timestamp') THEN 1 END AS marker
  FROM {source}),
s AS (
  SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (
              PARTITION BY {stream} ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state
  FROM m),
p AS (
  SELECT {keep}TRY_CAST(split_part(trim(value), ',', 1) AS BIGINT) AS timestamp,
         TRY_CAST(split_part(trim(value), ',', 2) AS DOUBLE) AS sensor_A,
         TRY_CAST(split_part(trim(value), ',', 3) AS DOUBLE) AS sensor_B
  FROM s WHERE marker IS NULL AND state = 1)
SELECT * FROM p
WHERE timestamp IS NOT NULL AND sensor_A IS NOT NULL AND sensor_B IS NOT NULL
"""


_STREAM_OF_USER = "user_id % 7"


@query("log_blocks_streams", oracle=f"""
WITH {_LINES},
k AS (SELECT l.event_id, l.value, CAST(e.{_STREAM_OF_USER} AS BIGINT) AS stream
      FROM lines l JOIN events e USING (event_id)),
{_block_rows_sql('k', 'stream', 'stream, ')}
""")
def q_log_blocks_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + T5 with a stream key: the state restarts in each of its streams."""
    events = table(spark, sf_dir, "events")
    lines = derived.event_lines(events, F.expr(_STREAM_OF_USER).cast("long").alias("stream"))
    blocks = ordered_blocks(lines, ["event_id"], stream_cols=["stream"], keep=[])
    return clean_blocks(blocks, keep=["stream"])


_LINES_PER_FILE = 2000


@query("clean_log_stateful", oracle=f"""
WITH {_LINES},
k AS (SELECT event_id, value, event_id // {_LINES_PER_FILE} AS file FROM lines),
{_block_rows_sql('k', 'file')}
""")
def q_clean_log_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 with its default per-file state, over files of several splits each:
    a file holds a run of lines in order, and splits are set smaller than a
    file while they are read."""
    lines = derived.event_lines(table(spark, sf_dir, "events"))
    path = scratch_path(spark, "logs")
    (lines.withColumn("file", F.floor(F.col("event_id") / _LINES_PER_FILE))
     .repartition("file").sortWithinPartitions("file", "event_id")
     .select("file", "value").write.partitionBy("file").text(path))
    return clean_log_stateful(spark, path, split_bytes=16 * 1024)


@query("spectrum_from_landed", oracle="""
WITH s AS (SELECT event_id, TRY_CAST(value AS DOUBLE) AS amp FROM events
           WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL)
SELECT 'r1' AS result_id,
       CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS sample_index,
       CAST(row_number() OVER (ORDER BY event_id) - 1 AS DOUBLE) * CAST(1000.0 AS DOUBLE)
         / CAST(count(*) OVER () AS DOUBLE) AS frequency_hz,
       abs(amp) AS magnitude,
       CAST(0.0 AS DOUBLE) AS phase
FROM s
""")
def q_spectrum_from_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's analysis path: cells landed as text (S1), coerced to
    double (T6), indexed by the landed order key cast to a number (T7)."""
    path = scratch_path(spark, "landed_signal")
    events = table(spark, sf_dir, "events")
    write_csv(events.select("event_id", F.col("value").alias("amplitude")), path)
    landed = read_csv_strings(spark, path)
    return spectrum(landed, RESULT_ID, order_by=[F.col("event_id").cast("long")],
                    with_created_time=False)

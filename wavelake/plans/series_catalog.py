"""Registered queries over ordered series: running aggregates, moving frames,
as-of and interval joins, transforms of whole series.  Same rules as
:mod:`wavelake.plans.catalog`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions.time import epoch_micros
from wavelake.operators.asof import asof_join
from wavelake.operators.automaton import run_automaton
from wavelake.operators.intervals import interval_join
from wavelake.operators.ordering import materialized
from wavelake.operators.profile import (append_profiles, column_profiles, merge_profiles, profile_report,
                                        read_profiles)
from wavelake.operators.scan import FIRST, LAST, MAX, MIN, SUM, neighbours, over_rows, running
from wavelake.operators.spectra import averaged_spectrum, periodogram, resample, series_dft
from wavelake.plans import derived
from wavelake.plans.catalog import query
from wavelake.plans.tables import table
from wavelake.session import scratch_path
from wavelake.sinks.interleaved import append_interleaved, read_ranges
from wavelake.sources.gzip_lines import read_gzip_lines, write_gzip_members


def _cents() -> Column:
    return F.round(F.col("value") * 100).cast("long")


_CENTS = "CAST(round(value * 100) AS BIGINT)"


# ------------------------------------------------------- running aggregates
@query("running_totals", oracle=f"""
SELECT event_id,
       CAST(sum({_CENTS}) OVER w AS BIGINT) AS total_cents,
       count(*) FILTER (WHERE event_type = 'purchase') OVER w AS purchases,
       max(value) OVER w AS highest,
       last_value(CASE WHEN event_type = 'error' THEN user_id END IGNORE NULLS) OVER w AS last_error_user,
       first_value(CASE WHEN value > 20 THEN event_type END IGNORE NULLS) OVER w AS first_large
FROM events
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def q_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: running values along the whole table, with no partition key."""
    kind = F.col("event_type")
    out = running(table(spark, sf_dir, "events"), ["ts", "event_id"], {
        "total_cents": (SUM, _cents()),
        "purchases": (SUM, (kind == "purchase").cast("long")),
        "highest": (MAX, F.col("value")),
        "last_error_user": (LAST, F.when(kind == "error", F.col("user_id"))),
        "first_large": (FIRST, F.when(F.col("value") > 20, kind))})
    return out.select("event_id", "total_cents", "purchases", "highest", "last_error_user", "first_large")


@query("running_by_series", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity,
       min(l_extendedprice) OVER w AS lowest
FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
             l_extendedprice, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def q_running_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: running values per series, of which there are few and large ones."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        "l_extendedprice")
    out = running(lines, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                          "l_quantity"],
                  {"quantity": (SUM, F.col("l_quantity").cast("long")),
                   "lowest": (MIN, F.col("l_extendedprice"))}, series=["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "quantity", "lowest")


# ------------------------------------------------------------ moving frames
_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("moving_frames", oracle=f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity_100,
       max(l_extendedprice) OVER v AS highest_near, count(*) OVER v AS rows_near
FROM lineitem
WINDOW w AS (ORDER BY {", ".join(_LINE_ORDER)} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
       v AS (ORDER BY {", ".join(_LINE_ORDER)} ROWS BETWEEN 99 PRECEDING AND 20 FOLLOWING)
""")
def q_moving_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: moving frames along the whole table."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_ORDER, "l_quantity")
    out = over_rows(lines, _LINE_ORDER, {
        "quantity_100": lambda w: F.sum(F.col("l_quantity").cast("long")).over(w.rowsBetween(-99, 0)),
        "highest_near": lambda w: F.max("l_extendedprice").over(w),
        "rows_near": lambda w: F.count(F.lit(1)).over(w)}, preceding=99, following=20, block_rows=4096)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "quantity_100", "highest_near", "rows_near")


@query("lag_lead", oracle="""
SELECT event_id, lag(value, 1) OVER w AS previous, lag(event_type, 40) OVER w AS type_before,
       lead(user_id, 3) OVER w AS user_ahead
FROM events WINDOW w AS (ORDER BY ts, event_id)
""")
def q_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: values of rows before and after, along the whole table."""
    out = neighbours(table(spark, sf_dir, "events"), ["ts", "event_id"], {
        "previous": ("value", -1), "type_before": ("event_type", -40), "user_ahead": ("user_id", 3)})
    return out.select("event_id", "previous", "type_before", "user_ahead")


# --------------------------------------------------------------- as-of joins
@query("asof_last_purchase", oracle="""
SELECT l.event_id, r.event_id AS right_event_id, r.value AS right_value
FROM (SELECT * FROM events WHERE event_type <> 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.ts >= r.ts
""")
def q_asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: the last earlier row of another series, over one series as long as
    the table."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    out = asof_join(events.filter("event_type <> 'purchase'"), events.filter("event_type = 'purchase'"),
                    "ts", order_ties=["event_id"])
    return out.select("event_id", "right_event_id", "right_value")


@query("asof_next_error_by_user", oracle="""
SELECT l.event_id, CASE WHEN r.ts - l.ts < INTERVAL 2 DAY THEN r.event_id END AS right_event_id
FROM (SELECT * FROM events WHERE event_type <> 'error') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r
  ON l.user_id = r.user_id AND l.ts < r.ts
""")
def q_asof_next_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: the next later row of the same user, within two days."""
    events = table(spark, sf_dir, "events")
    events = events.select("event_id", "user_id", "event_type", epoch_micros(events, "ts").alias("us"))
    out = asof_join(events.filter("event_type <> 'error'"), events.filter("event_type = 'error'"),
                    "us", by=["user_id"], direction="forward", allow_equal=False, order_ties=["event_id"],
                    tolerance=F.col("right_us") - F.col("us") < 2 * 86_400_000_000)
    return out.select("event_id", "right_event_id")


# ------------------------------------------------------------ interval joins
@query("interval_overlaps", oracle="""
WITH e AS (SELECT event_id, epoch_us(ts) AS lo,
                  epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 100000 AS hi
           FROM events WHERE event_type = 'error'),
s AS (SELECT event_id, epoch_us(ts) AS lo, epoch_us(ts) + (user_id % 7) * 3600000000 AS hi
      FROM events WHERE event_type = 'signup')
SELECT e.event_id, s.event_id AS right_event_id FROM e JOIN s ON e.lo <= s.hi AND s.lo <= e.hi
""")
def q_interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: all pairs of overlapping intervals of very different lengths."""
    events = table(spark, sf_dir, "events")
    lo = epoch_micros(events, "ts")
    errors = events.filter("event_type = 'error'").select(
        "event_id", lo.alias("lo"), (lo + _cents() * 100_000).alias("hi"))
    signups = events.filter("event_type = 'signup'").select(
        "event_id", lo.alias("lo"), (lo + F.expr("user_id % 7") * 3_600_000_000).alias("hi"))
    return interval_join(errors, signups, ("lo", "hi"), ("lo", "hi"), keep=["event_id", "right_event_id"])


@query("interval_points_by_user", oracle="""
SELECT p.event_id, e.event_id AS right_event_id
FROM events p JOIN events e ON p.user_id = e.user_id AND e.event_type = 'error'
  AND epoch_us(p.ts) BETWEEN epoch_us(e.ts) AND epoch_us(e.ts) + 86400000000
WHERE p.event_type = 'purchase'
""")
def q_interval_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: points within intervals of the same key."""
    events = table(spark, sf_dir, "events")
    at = epoch_micros(events, "ts")
    points = events.filter("event_type = 'purchase'").select("event_id", "user_id", at.alias("at"))
    days = events.filter("event_type = 'error'").select(
        "event_id", "user_id", at.alias("lo"), (at + 86_400_000_000).alias("hi"))
    return interval_join(points, days, ("at", "at"), ("lo", "hi"), by=["user_id"],
                         keep=["event_id", "right_event_id"])


# ------------------------------------------------------------------ spectra
@query("series_dft", oracle="""
WITH s AS (SELECT event_type, value AS x, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY event_type) AS m
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
p AS (SELECT event_type, CAST(2 ** ceil(log2(max(m))) AS BIGINT) AS n_points FROM s GROUP BY event_type),
k AS (SELECT event_type, n_points, unnest(range(0, n_points // 2 + 1)) AS bin FROM p),
t AS (SELECT k.event_type, k.n_points, k.bin,
             sum(x * cos(2 * pi() * ((bin * n) % n_points) / n_points)) AS re,
             -sum(x * sin(2 * pi() * ((bin * n) % n_points) / n_points)) AS im
      FROM k JOIN s USING (event_type) GROUP BY ALL)
SELECT event_type, n_points, bin, CAST(bin AS DOUBLE) * 1000.0::DOUBLE / CAST(n_points AS DOUBLE) AS frequency_hz,
       round(re, 2) + 0.0 AS re, round(im, 2) + 0.0 AS im
FROM t
""")
def q_series_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over whole series: the transform of each event type's samples, in
    blocks far smaller than a series."""
    out = series_dft(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], series=["event_type"],
                     block_points=1 << 10)
    return out.select("event_type", "n_points", "bin", "frequency_hz",
                      (F.round("re", 2) + 0.0).alias("re"), (F.round("im", 2) + 0.0).alias("im"))


@query("averaged_spectrum", oracle="""
WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events),
f AS (SELECT frame, unnest(range(0, 256)) AS i FROM range((SELECT count(*) FROM events)) r(frame)
      WHERE frame * 96 + 256 <= (SELECT count(*) FROM events)),
d AS (SELECT f.frame, f.i, s.x * (0.5 - 0.5 * cos(2 * pi() * f.i / 256)) AS x
      FROM f JOIN s ON s.n = f.frame * 96 + f.i),
t AS (SELECT frame, bin, sum(x * cos(2 * pi() * ((bin * i) % 256) / 256)) AS re,
             sum(x * sin(2 * pi() * ((bin * i) % 256) / 256)) AS im
      FROM d, range(0, 129) b(bin) GROUP BY frame, bin)
SELECT bin, CAST(bin AS DOUBLE) * 1000.0::DOUBLE / 256.0::DOUBLE AS frequency_hz, count(*) AS frames,
       round(avg((re * re + im * im) * CASE WHEN bin IN (0, 128) THEN 1 ELSE 2 END / (1000.0 * 96.0)), 6) AS power
FROM t GROUP BY bin
""")
def q_averaged_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with overlapping Hann frames of the whole table, averaged."""
    out = averaged_spectrum(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], frame_size=256,
                            hop=96, block_points=1 << 12)
    return out.select("bin", "frequency_hz", "frames", F.round("power", 6).alias("power"))


_MINUTE = 60_000_000


@query("resampled_minutes", oracle=f"""
WITH s AS (SELECT event_type, epoch_us(ts) AS t, value AS x, lead(epoch_us(ts)) OVER w AS t1, lead(value) OVER w AS x1
           FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT *, unnest(range((t + {_MINUTE} - 1) // {_MINUTE},
                             CASE WHEN t1 IS NULL THEN t // {_MINUTE} + 1
                                  ELSE (t1 + {_MINUTE} - 1) // {_MINUTE} END)) AS tick FROM s)
SELECT event_type, tick, tick * {_MINUTE} AS time,
       round(CASE WHEN tick * {_MINUTE} = t THEN x WHEN t1 - t > 30 * {_MINUTE} THEN NULL
                  ELSE x + (x1 - x) * (CAST(tick * {_MINUTE} - t AS DOUBLE) / CAST(t1 - t AS DOUBLE)) END, 6) AS value,
       tick * {_MINUTE} > t AND coalesce(t1 - t > 30 * {_MINUTE}, false) AS in_gap
FROM g
""")
def q_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 on the real clock: each event type's values at every full minute,
    with gaps of over half an hour marked."""
    events = table(spark, sf_dir, "events")
    events = events.withColumn("us", epoch_micros(events, "ts"))
    out = resample(events, "us", "value", _MINUTE, max_gap=30 * _MINUTE, series=["event_type"],
                   order_ties=["event_id"], piece_points=20)
    return out.withColumn("value", F.round("value", 6))


_PER_DAY = [0.1 * k for k in range(1, 61)]


@query("periodogram", oracle="""
WITH s AS (SELECT event_type, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 86400000000.0::DOUBLE AS t, value AS y
           FROM events),
f AS (SELECT k, 0.1::DOUBLE * k AS frequency FROM range(1, 61) r(k)),
a AS (SELECT event_type, frequency, count(*) AS n, avg(y) AS y, avg(y * y) AS yy,
             avg(cos(2 * pi() * frequency * t)) AS c, avg(sin(2 * pi() * frequency * t)) AS s,
             avg(y * cos(2 * pi() * frequency * t)) AS yc, avg(y * sin(2 * pi() * frequency * t)) AS ys,
             avg(cos(2 * pi() * frequency * t) ** 2) AS cc,
             avg(cos(2 * pi() * frequency * t) * sin(2 * pi() * frequency * t)) AS cs
      FROM s, f GROUP BY event_type, frequency),
b AS (SELECT event_type, frequency, n, yy - y * y AS yy, yc - y * c AS yc, ys - y * s AS ys,
             cc - c * c AS cc, cs - c * s AS cs, 1 - cc - s * s AS ss FROM a)
SELECT event_type, frequency, n AS samples,
       round((ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)), 7) AS power
FROM b
""")
def q_periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 on irregular times: least-squares spectrum of each event type at 60
    frequencies per day."""
    events = table(spark, sf_dir, "events")
    days = (epoch_micros(events, "ts") - F.lit(1_704_067_200_000_000)).cast("double") / F.lit(86_400_000_000.0)
    out = periodogram(events, days, "value", _PER_DAY, series=["event_type"])
    return out.withColumn("power", F.round("power", 7))


# ----------------------------------------------------------- line automaton
_TURNS = """
SELECT event_id, value,
       CASE WHEN value LIKE '[%' THEN 0 WHEN value LIKE 'timestamp%' THEN 1
            WHEN value LIKE '  [WARN%' THEN 2 END AS symbol
FROM lines"""


@query("line_automaton", oracle=f"""
WITH lines AS ({derived.EVENT_LINES_SQL}),
s AS ({_TURNS}),
g AS (SELECT *, count(*) FILTER (WHERE symbol IN (0, 2)) OVER (ORDER BY event_id) AS setters FROM s),
h AS (SELECT *, first_value(CASE WHEN symbol = 2 THEN 2 ELSE 0 END) OVER p AS base,
             count(*) FILTER (WHERE symbol = 1) OVER p AS steps
      FROM g WINDOW p AS (PARTITION BY setters ORDER BY event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT event_id, CAST((base + steps) % 3 AS INTEGER) AS state_after FROM h)
SELECT event_id, coalesce(lag(state_after) OVER (ORDER BY event_id), 0) AS state_before, state_after FROM a
""")
def q_line_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 with three states: log lines reset it, headers step through it, an
    indented warning sets it."""
    lines = derived.event_lines(table(spark, sf_dir, "events"))
    symbol = (F.when(F.col("value").startswith("["), 0).when(F.col("value").startswith("timestamp"), 1)
              .when(F.col("value").startswith("  [WARN"), 2))
    out = run_automaton(lines, ["event_id"], symbol, [[0, 0, 0], [1, 2, 0], [2, 2, 2]])
    return out.select("event_id", "state_before", "state_after")


# ----------------------------------------------------------- column profile
_PROFILED = ("event_id", "user_id", "event_type", "value", "props")


def _exact_sql(c: str) -> str:
    number = f"TRY_CAST({c} AS DOUBLE)"
    return f"""
SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count({number}) AS numbers,
       min({number}) AS lowest, max({number}) AS highest, true AS distinct_within, true AS quantiles_within,
       coalesce((SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (
          SELECT {c}::VARCHAR AS v, count(*) AS n FROM sparse WHERE {c} IS NOT NULL GROUP BY 1
          HAVING n >= 0.05 * (SELECT count(*) FROM sparse))), '') AS frequent
FROM sparse"""


@query("column_profile", oracle=f"""
WITH sparse AS ({derived.SPARSE_EVENTS_SQL})
{" UNION ALL ".join(map(_exact_sql, _PROFILED))}
""")
def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: profiles per task, stored per task folder and merged from there;
    the estimates are compared with exact figures (2 % in rank, 5 % in number),
    and values in at least a twentieth of the rows are listed."""
    rows = derived.sparse_events(table(spark, sf_dir, "events"))
    path = scratch_path(spark, "profiles")
    task = F.coalesce(F.expr("event_id % 7"), F.lit(-1)).cast("string")
    append_profiles(column_profiles(rows.withColumn("task_id", task), by=["task_id"]), path, "task_id")
    quantiles = (0.1, 0.5, 0.9)
    report = profile_report(merge_profiles(read_profiles(spark, path, "task_id")), quantiles)
    report = materialized(report, "profile")
    marks = {r["column"]: r["quantiles"] for r in report.select("column", "quantiles").collect()}  # a row a column

    def exact(c: str) -> Column:
        number = F.expr(f"try_cast({c} AS double)")
        close = F.lit(True)
        for q, mark in zip(quantiles, marks[c] or ()):
            below = F.count_if(number < mark) / F.count(number)
            upto = F.count_if(number <= mark) / F.count(number)
            close = close & (below <= q + 0.02) & (upto >= q - 0.02)
        return F.struct(F.lit(c).alias("of"), F.count_distinct(c).alias("number"), close.alias("quantiles_within"))

    truth = rows.agg(F.array(*[exact(c) for c in _PROFILED]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    often = F.filter("frequent", lambda f: f["item"].isNotNull() & (f["count"] >= F.col("rows") * 0.05))
    listed = F.array_join(F.array_sort(F.transform(
        often, lambda f: F.concat(f["item"], F.lit("="), f["count"].cast("string")))), ",")
    return report.join(truth, F.col("column") == F.col("of")).select(
        "column", "rows", "nulls", "numbers", "lowest", "highest",
        (F.abs(F.col("distinct") - F.col("number")) <= F.col("number") * 0.05 + 1).alias("distinct_within"),
        "quantiles_within", listed.alias("frequent"))


# ------------------------------------------------------ lookup by ranges
@query("range_lookup", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'
  AND l_quantity BETWEEN 10 AND 20
""")
def q_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 + K10: a table landed by two columns at once, looked up by ranges of
    both."""
    path = scratch_path(spark, "interleaved")
    lines = table(spark, sf_dir, "lineitem")
    append_interleaved(lines, path, ["l_shipdate", "l_quantity"], files=32)
    found = read_ranges(spark, path, {"l_shipdate": (dt.datetime(1997, 1, 1), dt.datetime(1997, 6, 30)),
                                      "l_quantity": (10.0, 20.0)})
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


# ------------------------------------------------- compressed logs in splits
@query("gzip_members", oracle=f"""
WITH lines AS ({derived.EVENT_LINES_SQL})
SELECT value, count(*) AS times FROM lines GROUP BY value
""")
def q_gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2: compressed logs of several members each, read in splits far smaller
    than a file."""
    lines = derived.event_lines(table(spark, sf_dir, "events"))
    path = scratch_path(spark, "gzip")
    write_gzip_members(lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), path, 300)
    return read_gzip_lines(spark, path, split_bytes=8 << 10).groupBy("value").agg(
        F.count(F.lit(1)).alias("times"))

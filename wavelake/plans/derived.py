"""Inputs derived from the driver's ``events`` table for the registered
queries, each given twice: as Spark code and as the DuckDB SQL the oracle
uses.  Both forms must produce identical rows.

* sparse rows — a landed table with null cells; rows of small ``error``
  events are entirely null (T1, A1);
* log lines — one line per event in ``event_id`` order: ``error`` is a log
  line, ``signup`` a header, a slow ``view`` an indented log line, a large
  ``purchase`` a malformed data line, everything else a data line
  ``<epoch>,<value>,<user>`` (T2–T5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.functions.time import epoch_seconds


def sparse_events(events: DataFrame) -> DataFrame:
    blank = (F.col("event_type") == "error") & (F.col("value") < 25)
    keep = ~blank
    return events.select(
        F.when(keep, F.col("event_id")).alias("event_id"),
        F.when(keep & (F.col("event_type") != "view"), F.col("user_id")).alias("user_id"),
        F.when(keep, F.col("event_type")).alias("event_type"),
        F.when(keep & (F.col("event_type") != "click"), F.col("value")).alias("value"),
        F.when(keep, F.col("props")).alias("props"))


def sparse_sql(source: str = "events", extra: str = "") -> str:
    """SQL of :func:`sparse_events` over ``source``; ``extra`` adds leading
    columns of the source (e.g. ``"task_id, "``)."""
    return f"""
SELECT {extra}CASE WHEN NOT blank THEN event_id END AS event_id,
       CASE WHEN NOT blank AND event_type <> 'view' THEN user_id END AS user_id,
       CASE WHEN NOT blank THEN event_type END AS event_type,
       CASE WHEN NOT blank AND event_type <> 'click' THEN value END AS value,
       CASE WHEN NOT blank THEN props END AS props
FROM (SELECT *, (event_type = 'error' AND value < 25) AS blank FROM {source})
"""


SPARSE_EVENTS_SQL = sparse_sql()

SPARSE_ALL_NULL_SQL = ("event_id IS NULL AND user_id IS NULL AND event_type IS NULL "
                       "AND value IS NULL AND props IS NULL")


def event_lines(events: DataFrame, *keep: Column) -> DataFrame:
    epoch = epoch_seconds(events, "ts").cast("string")
    user = F.col("user_id").cast("string")
    line = (F.when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] user "), user))
            .when(F.col("event_type") == "signup", F.lit("timestamp,sensor_A,sensor_B"))
            .when((F.col("event_type") == "view") & (F.col("value") < 5),
                  F.lit("  [WARN] slow view"))
            .when((F.col("event_type") == "purchase") & (F.col("value") >= 400),
                  F.concat(epoch, F.lit(",n/a,"), user))
            .otherwise(F.concat(epoch, F.lit(","), F.col("value").cast("string"),
                                 F.lit(","), user)))
    return events.select("event_id", *keep, line.alias("value"))


EVENT_LINES_SQL = """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN '[ERROR] user ' || CAST(user_id AS VARCHAR)
            WHEN event_type = 'signup' THEN 'timestamp,sensor_A,sensor_B'
            WHEN event_type = 'view' AND value < 5 THEN '  [WARN] slow view'
            WHEN event_type = 'purchase' AND value >= 400
              THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) || ',n/a,' || CAST(user_id AS VARCHAR)
            ELSE CAST(epoch_us(ts) // 1000000 AS VARCHAR) || ',' || CAST(value AS VARCHAR)
                 || ',' || CAST(user_id AS VARCHAR)
       END AS value
FROM events
"""

"""Epoch conversions that do not depend on the session time zone.

A ``timestamp_ntz`` value is a wall-clock time without zone; it is read as
UTC (as DuckDB and most stores do).  Casting it to ``timestamp`` instead
would apply the session zone and shift every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp / timestamp_ntz column."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(_NTZ_EPOCH), c)
    return F.unix_micros(c.cast("timestamp"))


def epoch_seconds(df: DataFrame, col: str) -> Column:
    """Whole seconds since the epoch (floor)."""
    return F.floor(epoch_micros(df, col) / F.lit(1_000_000))

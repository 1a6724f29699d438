"""S1 — header CSV scan, every column a string (no inference pass).

Behaviour of Spark's reader that the landing step relies on: short rows pad
with null, extra cells are dropped, blank lines vanish, empty and ``""``
cells are null, a space-only cell stays a value.  Cells are read by position,
so every file's header is checked against the columns (``enforceSchema`` off):
a file whose header differs fails the read instead of shifting its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def header_columns(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Column names from the header line (reads one line, not the data)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    head = spark.read.option("header", True).option("inferSchema", False).csv(paths)
    return head.columns


def read_csv_strings(spark: SparkSession, paths: str | Sequence[str],
                     columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """All-string DataFrame of header CSV files under ``paths``.

    Pass ``columns`` to skip the header probe (and for streaming frames,
    which need a schema)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    columns = list(columns) if columns is not None else header_columns(spark, paths)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return (spark.read.option("header", True).option("sep", sep)
            .option("enforceSchema", False)
            .option("mode", "PERMISSIVE").schema(schema).csv(paths))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV files, one per task."""
    df.write.mode(mode).option("header", True).csv(path)

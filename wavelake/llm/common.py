"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wavelake.operators.ordering import materialized, materialized_counted  # noqa: F401
from wavelake.session import ship_package

# ASCII white space as the word rules of this package define it.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(pdf: pd.DataFrame, column: str, limit_bytes: int) -> Iterator[pd.DataFrame]:
    """Slices of an Arrow batch whose texts hold about ``limit_bytes`` (one
    row at least), so that the arrays built from a slice stay bounded however
    long the rows of a batch are."""
    start, held = 0, 0
    for i, text in enumerate(pdf[column]):
        n = len(text) if text is not None else 0
        if held and held + n > limit_bytes:
            yield pdf.iloc[start:i]
            start, held = i, 0
        held += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInPandas`` with this package made importable on every executor."""
    ship_package(df.sparkSession)
    return df.mapInPandas(fn, schema)


def parts_for(rows: int, rows_per_part: int) -> int:
    """Number of partitions that hold about ``rows_per_part`` rows each."""
    return max(1, math.ceil(rows / rows_per_part))

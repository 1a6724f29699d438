"""Column profiles of landed tables, from sketches that merge (A1 beyond row
counts).

``column_profiles`` reads the rows once and leaves one small row per (group,
column): exact counts and extremes, and Spark's mergeable sketches of the
distinct values, the quantiles of the cells that are numbers, and the frequent
values.  Stored per task folder, profiles of any set of tasks are merged by
``merge_profiles`` without reading a row again; ``profile_report`` turns them
into figures.  Partial sketches are built before the shuffle, so a group with
most rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions.numeric import as_double

HLL_BITS = 12            # distinct values: standard error about 1.04 / sqrt(2**bits)
KLL_SIZE = 200           # quantiles: rank error about 1.3 %
FREQUENT_TRACKED = 1000  # frequent values: count error at most rows / tracked * 3.5


def _parts(c: str) -> Column:
    """What is kept of one column, as one struct."""
    cell, text, number = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string"), as_double(f"`{c}`")
    return F.struct(
        F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(cell.isNull()).alias("nulls"),
        F.count(number).alias("numbers"), F.min(number).alias("lowest"), F.max(number).alias("highest"),
        F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias("distinct"),
        F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias("quantiles"),
        F.call_function("approx_top_k_accumulate", text, F.lit(FREQUENT_TRACKED)).alias("frequent"))


def column_profiles(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``by..., column, rows, nulls, numbers, lowest, highest, distinct,
    quantiles, frequent`` per group and column (default: all others)."""
    by = list(by)
    columns = [c for c in df.columns if c not in by] if columns is None else list(columns)
    if not columns:
        raise ValueError("no column to profile")
    # all columns in one aggregation, then a row for each
    one = df.groupBy(*by).agg(F.array(*[_parts(c) for c in columns]).alias("_wl_profiles"))
    return one.select(*by, F.explode("_wl_profiles").alias("p")).select(*by, "p.*")


def append_profiles(profiles: DataFrame, path: str, task_col: str) -> None:
    """Store profiles per task folder; a task profiled again replaces its own."""
    (profiles.repartition(task_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(task_col).parquet(path))


def read_profiles(spark: SparkSession, path: str, task_col: str,
                  tasks: Sequence[str | int] | None = None) -> DataFrame:
    """Stored profiles of the given tasks (all when None); others are pruned."""
    found = spark.read.parquet(path)
    return found if tasks is None else found.filter(F.col(task_col).isin(list(tasks)))


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One profile per column (and ``by``) from those of parts of the rows."""
    return profiles.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("numbers").alias("numbers"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(FREQUENT_TRACKED)).alias("frequent"))


def profile_report(profiles: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75),
                   top: int = 10) -> DataFrame:
    """``rows, nulls, numbers, lowest, highest`` as they are, the estimated
    number of distinct values, the estimated quantiles of the numbers (null if
    there are none) and the ``top`` frequent values with their counts."""
    keys = [c for c in profiles.columns if c not in ("distinct", "quantiles", "frequent")]
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    return profiles.select(
        *keys, F.hll_sketch_estimate("distinct").alias("distinct"),
        F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", at)).alias("quantiles"),
        F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top)).alias("frequent"))

"""T7 — contiguous, ordered sample index without a one-partition window.

``row_number()`` over a window with no ``partitionBy`` moves every row into a
single task, and ``partitionBy(series)`` moves a whole series into one task,
which fails when one series holds a third of the data.  Instead:

1. ``orderBy(series..., order...)`` — Spark range-partitions on the *full*
   key (sampled bounds), so a hot series is spread over many balanced tasks;
2. in the same stage each row is tagged with its task (partition) and its
   position there, and the frame is written once as Parquet under the shared
   ``spark.checkpoint.dir`` — lineage cut, survives lost executors, and the
   tags no longer depend on how the table is split when read back;
3. a summary with one row per (partition, series) — bounded by partitions +
   series — gives each partition's offset by a prefix sum;
4. the summary, itself a written table of known size, joins back: Spark
   broadcasts it below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wavelake.session import scratch_path, shuffles_dropped

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position
PART_COL = "_wl_part"
POS_COL = "_wl_pos"


def materialized(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read
    it back: the lineage is cut and later uses see the same rows.  What the
    write shuffled is deleted with its end."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("maxRecordsPerFile", 0).parquet(path)
    return df.sparkSession.read.parquet(path)


def materialized_counted(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """:func:`materialized`, also returning the row count observed during the
    write (no separate counting job)."""
    obs = Observation(f"wl_rows_{name}")
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        (df.observe(obs, F.count(F.lit(1)).alias("rows"))
         .write.option("maxRecordsPerFile", 0).parquet(path))
    return df.sparkSession.read.parquet(path), obs.get["rows"]


def tag_positions(df: DataFrame) -> DataFrame:
    """Add ``_wl_part`` (task partition) and ``_wl_pos`` (row position in it),
    computed in the stage that produces ``df``'s rows."""
    mid = F.monotonically_increasing_id()
    return (df.withColumn(PART_COL, F.spark_partition_id().cast("long"))
            .withColumn(POS_COL, mid.bitwiseAND((1 << _POS_BITS) - 1)))


def sorted_table(df: DataFrame, keys: Sequence[str | Column], name: str = "sorted",
                 keep: Sequence[str] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """``df`` range-sorted on ``keys`` (balanced tasks, even for hot key
    prefixes), tagged with partition and position, written once.  Only the
    ``keep`` columns (default: all) are written — sort keys needed for nothing
    else are not stored.  ``num_partitions`` overrides the shuffle partition
    count of the sort (size it to the input: a range partition cannot be
    split later)."""
    cols = _as_cols(keys)
    if num_partitions:
        ordered = df.repartitionByRange(num_partitions, *cols).sortWithinPartitions(*cols)
    else:
        ordered = df.orderBy(*cols)
    if keep is not None:
        ordered = ordered.select(*keep)
    return materialized(tag_positions(ordered), name)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (series keys may be null)."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                       for c in right.columns])
    cond = reduce(lambda a, b: a & b,
                  [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    joined = left.join(r, cond, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def contiguous_index(df: DataFrame, order_by: Sequence[str | Column] | None,
                     partition_by: Sequence[str] = (),
                     index_col: str = "sample_index",
                     count_col: str | None = None,
                     keep: Sequence[str] | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``index_col`` = 0..n-1 within each ``partition_by`` group.

    ``order_by`` gives the order; ``None`` keeps arrival order (what the
    reference's one-partition read gave).  ``count_col`` optionally adds the
    group size n.  ``keep`` limits the carried columns (the ``partition_by``
    keys are always kept).  Order keys should be unique within a group for a
    stable result (add a row id as tie-breaker).
    """
    partition_by = list(partition_by)
    if keep is not None:
        keep = list(dict.fromkeys([*partition_by, *keep]))
    if order_by is None:
        if partition_by:
            raise ValueError("arrival order is only defined without partition_by")
        tagged = materialized(tag_positions(df.select(*keep) if keep else df), "arrival")
    else:
        tagged = sorted_table(df, [*_as_cols(partition_by), *_as_cols(order_by)],
                              keep=keep, num_partitions=num_partitions)

    summary = (tagged.groupBy("_wl_part", *partition_by)
               .agg(F.count(F.lit(1)).alias("_wl_n"),
                    F.min("_wl_pos").alias("_wl_first")))
    spec = Window.partitionBy(*partition_by) if partition_by else Window
    before = spec.orderBy("_wl_part").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn(
        "_wl_before", F.coalesce(F.sum("_wl_n").over(before), F.lit(0)))
    if count_col:
        summary = summary.withColumn(
            "_wl_total", F.sum("_wl_n").over(Window.partitionBy(*partition_by)))
    summary = materialized(summary.drop("_wl_n"), "offsets")

    joined = null_safe_join(tagged, summary, ["_wl_part", *partition_by])
    out = joined.withColumn(
        index_col, F.col("_wl_before") + F.col("_wl_pos") - F.col("_wl_first"))
    if count_col:
        out = out.withColumnRenamed("_wl_total", count_col)
    return out.drop("_wl_part", "_wl_pos", "_wl_first", "_wl_before")

"""S2 — raw text lines with their file position.

``spark.read.text`` gives one ``value`` per line.  The hidden ``_metadata``
column adds the file path and the start of the split a line belongs to;
``monotonically_increasing_id`` is ordered within a split, so
(file, split start, line id) is file order without any sort.
"""

from __future__ import annotations

import contextlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_COL = "_file"
SPLIT_COL = "_split"
LINE_COL = "_line"


@contextlib.contextmanager
def file_splits(spark: SparkSession, split_bytes: int | None):
    """Files scanned inside are read in splits of ``split_bytes`` (None: as the
    session is set).  However small the splits, there are about as many tasks
    as a shuffle has, each reading many splits."""
    if split_bytes is None:
        yield
        return
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    settings = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "0",
                "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_lines(spark: SparkSession, paths: str | Sequence[str],
               with_position: bool = True) -> DataFrame:
    """Lines of every file under ``paths`` (globs and folders allowed)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(paths)
    if not with_position:
        return df
    return df.select(
        "value",
        F.col("_metadata.file_path").alias(FILE_COL),
        F.col("_metadata.file_block_start").alias(SPLIT_COL),
        F.monotonically_increasing_id().alias(LINE_COL))

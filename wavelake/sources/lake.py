"""S5 — lake addressing: raw files live at ``<root>/task_<id>/<name>``.

``root`` is any Hadoop URI (``s3a://bucket``, ``hdfs://nn/base/bucket``,
``file:/...``).  The bulk form scans every task folder in one job and recovers
the task id from each row's file path.  Tasks have columns of their own: their
folders are grouped by header (one line is read of each), each group is
scanned by its own columns and the result is the union of all columns.
Object-store credentials come from the caller (session conf), never from
literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.sources.csv import header_columns, read_csv_strings

# Fixed value: object name used when an upload has no file name.
DEFAULT_OBJECT_NAME = "raw.dat"
TASK_COL = "task_id"


def task_folder(root: str, task_id: str | int) -> str:
    return f"{root.rstrip('/')}/task_{task_id}"


def task_object_uri(root: str, task_id: str | int, name: str | None = None) -> str:
    """URI of one raw object of a task."""
    return f"{task_folder(root, task_id)}/{name or DEFAULT_OBJECT_NAME}"


def s3a_conf(endpoint: str, access_key: str, secret_key: str,
             path_style: bool = True) -> dict[str, str]:
    """Session settings for an S3-compatible store (needs ``hadoop-aws``)."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }


def task_id_from_path(path_col: str = "_metadata.file_path") -> F.Column:
    return F.regexp_extract(F.col(path_col), r"/task_([^/]+)/[^/]*$", 1)


def task_folders(spark: SparkSession, root: str) -> list[str]:
    """The ``task_*`` folders under ``root`` (a listing on its file system)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/task_*")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.globStatus(path) or [] if s.isDirectory())


def read_task_csv(spark: SparkSession, root: str, task_ids: Sequence[str | int] | None = None,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """All-string rows of the CSV objects of the given tasks (all tasks when
    ``task_ids`` is None), with a ``task_id`` column.  ``columns`` states one
    header for all of them (checked); without it each task keeps its own and
    cells of columns that a task lacks are null."""
    folders = (task_folders(spark, root) if task_ids is None
               else [task_folder(root, t) for t in task_ids])
    if not folders:
        raise FileNotFoundError(f"no task folder under {root}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for folder in folders:
        header = tuple(columns) if columns is not None else tuple(header_columns(spark, f"{folder}/*"))
        groups.setdefault(header, []).append(f"{folder}/*")
    frames = []
    for header, paths in groups.items():
        df = read_csv_strings(spark, paths, header)
        frames.append(df.select(task_id_from_path().alias(TASK_COL), *df.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

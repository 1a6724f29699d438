"""Lake-table sinks: K4/K5 layouts on Parquet, K8 spectrum table, K9 run
summaries, K10 read-back with partition pruning.

Writes are single Spark jobs, parallel per task; no row passes through the
driver.  Partition layouts keep each task writing few files: rows are sorted
within tasks by the partition key rather than shuffled by it (a hot key
would otherwise land in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.operators.ordering import materialized

CREATED_TIME = "created_time"
MONTH_COL = "created_month"

SPECTRUM_SCHEMA = T.StructType([
    T.StructField("result_id", T.StringType(), False),
    T.StructField("sample_index", T.LongType(), False),
    T.StructField("frequency_hz", T.DoubleType(), True),
    T.StructField("magnitude", T.DoubleType(), True),
    T.StructField("phase", T.DoubleType(), True),
    T.StructField(CREATED_TIME, T.TimestampType(), True),
])

SUMMARY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("result", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField(CREATED_TIME, T.TimestampType(), True),
])


def with_landing_columns(df: DataFrame) -> DataFrame:
    """K4 (lake form): add ``created_time`` and its ``yyyyMM`` month.

    A source column already named ``created_time`` would clash: fail early.
    Rows whose first column (the sort key) is null are kept; the lake has no
    not-null key constraint.
    """
    if CREATED_TIME in df.columns or MONTH_COL in df.columns:
        raise ValueError(f"input already has a {CREATED_TIME!r} or {MONTH_COL!r} column")
    return (df.withColumn(CREATED_TIME, F.current_timestamp())
            .withColumn(MONTH_COL, F.date_format(CREATED_TIME, "yyyyMM")))


def append_landed(df: DataFrame, path: str, mode: str = "append") -> None:
    """K4 + K1 (lake form): append all-string rows, partitioned by month and
    sorted by (first column, created_time) within each file."""
    landed = with_landing_columns(df)
    first = df.columns[0]
    (landed.sortWithinPartitions(MONTH_COL, first, CREATED_TIME)
     .write.mode(mode).partitionBy(MONTH_COL).parquet(path))


def append_bucketed(df: DataFrame, table_name: str, path: str, buckets: int,
                    files_per_bucket: int = 4) -> None:
    """K5 (lake form): duplicate-key table hash-distributed on the first
    column into ``buckets`` buckets, registered in the session catalog.

    Rows are dealt to (bucket, salt) before the write, so a write leaves at
    most ``buckets * files_per_bucket`` files whatever the number of input
    tasks, and a hot or null key spreads over its bucket's files."""
    first = df.columns[0]
    bucket = F.pmod(F.hash(F.col(f"`{first}`")), F.lit(buckets))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_bucket))
    landed = (df.repartition(buckets * files_per_bucket, bucket, salt)
              .withColumn(CREATED_TIME, F.current_timestamp()))
    (landed.write.mode("append").bucketBy(buckets, first)
     .sortBy(first).option("path", path).saveAsTable(table_name))


def append_spectrum(df: DataFrame, path: str, extra_partitions: Sequence[str] = ()) -> None:
    """K8: spectrum rows partitioned by ``result_id`` (files ordered by
    ``sample_index``).  A result written before is replaced, others stay."""
    (df.sortWithinPartitions("result_id", "sample_index")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("result_id", *extra_partitions).parquet(path))


SUMMARY_BUCKETS = 64
_BUCKET_COL = "id_bucket"


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn(_BUCKET_COL, F.pmod(F.xxhash64("id"), F.lit(SUMMARY_BUCKETS)).cast("int"))


def append_summary(df: DataFrame, path: str) -> None:
    """K9: append run-summary rows to one table, in a bounded number of folders
    (by a hash of the id) however many results there are.  Of the rows of one
    id the latest counts, so a re-run replaces its result for readers."""
    (_bucketed(df).sortWithinPartitions(_BUCKET_COL, "id").write.mode("append")
     .partitionBy(_BUCKET_COL).parquet(path))


def _latest(rows: DataFrame) -> DataFrame:
    """The last written row per id (ties: the greatest text)."""
    newest = F.max(F.struct(CREATED_TIME, "result", "status")).alias("r")
    return rows.groupBy("id").agg(newest).select("id", "r.result", "r.status", f"r.{CREATED_TIME}")


def compact_summaries(spark: SparkSession, path: str) -> None:
    """Rewrite the summary table with the latest row of each id, one file a
    folder: for tables that many small appends have made."""
    kept = materialized(_latest(_read_summaries(spark, path)), "summaries")
    (_bucketed(kept).repartition(SUMMARY_BUCKETS, _BUCKET_COL).sortWithinPartitions(_BUCKET_COL, "id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(_BUCKET_COL).parquet(path))


def _read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*SUMMARY_SCHEMA, T.StructField(_BUCKET_COL, T.IntegerType())])).parquet(path)


def read_spectrum(spark: SparkSession, path: str, result_id: str | None = None,
                  schema: T.StructType | None = None) -> DataFrame:
    """K10: spectrum rows of one result; the filter prunes partitions.

    With an explicit schema ``result_id`` stays a string (partition type
    inference would turn numeric ids into numbers)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    return df if result_id is None else df.filter(F.col("result_id") == result_id)


def read_summary(spark: SparkSession, path: str, result_id: str) -> DataFrame:
    """K10: the summary of one result (empty frame = not found): one folder of
    the table is read, and there the id filter reaches the scan."""
    bucket = F.pmod(F.xxhash64(F.lit(result_id)), F.lit(SUMMARY_BUCKETS)).cast("int")
    rows = _read_summaries(spark, path)
    return _latest(rows.filter((F.col(_BUCKET_COL) == bucket) & (F.col("id") == result_id)))


def find_summary(spark: SparkSession, path: str, result_id: str):
    """K10 as a lookup: the summary row of ``result_id`` or ``None`` (the id
    filter is pushed into the Parquet scan; at most one row comes back)."""
    return read_summary(spark, path, result_id).first()


class LakeSink:
    """K4 lake form as a warehouse target: ``<root>/<table>`` Parquet."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def table_path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create_if_absent(self, df: DataFrame, table: str) -> None:
        if CREATED_TIME in df.columns or MONTH_COL in df.columns:
            raise ValueError(f"input already has a {CREATED_TIME!r} or {MONTH_COL!r} column")

    def write(self, df: DataFrame, table: str) -> None:
        append_landed(df, self.table_path(table))

    def write_spectrum(self, df: DataFrame, table: str) -> None:
        append_spectrum(df, self.table_path(table))

    def write_summary(self, df: DataFrame, table: str) -> None:
        append_summary(df, self.table_path(table))

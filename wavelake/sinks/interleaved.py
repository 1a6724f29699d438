"""Landed tables that are looked up by ranges of several columns (K4, K10).

Rows are laid out along an interleaved key: each column's value becomes its
place among the column's quantiles, and the bits of all places are interleaved,
so that a file covers a small box of all columns at once, whatever their
distributions.  A small table beside the data holds every file's least and
greatest values; a lookup reads the files whose box meets the ranges, and there
the usual filters reach the row groups.

Files are cut by a range sort over the key and, behind it, the values and a
hash of the row, so one frequent value or key does not end in one file.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.functions.time import epoch_micros

PLACE_BITS = 8
_RANGES = "_ranges"   # beside the data; hidden from plain readers


def _measure(df: DataFrame, column: str) -> Column:
    """A column's value as a number of the same order."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(df, column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    raise ValueError(f"column {column!r} is no number or time: {kind.simpleString()}")


def _spread(place: int, offset: int, stride: int) -> int:
    """The bits of ``place``, ``stride`` apart from bit ``offset`` on."""
    return sum(1 << (i * stride + offset) for i in range(place.bit_length()) if place >> i & 1)


def _splits(bounds: Sequence[float]) -> tuple[list[float], list[int]]:
    """Splits of a ``Bucketizer`` at the ``bounds`` (sorted), and every bucket's
    place: the number of bounds not above its values.  The last bucket is that
    of NaN, above all numbers."""
    marks = sorted({b for b in bounds if math.isfinite(b)}) or [0.0]
    first = bisect.bisect_right(bounds, -math.inf)
    numbers = [b for b in bounds if not math.isnan(b)]
    places = [first, *[bisect.bisect_right(numbers, m) for m in marks], len(bounds)]
    return [-math.inf, *marks, math.inf], places


def with_interleaved_key(df: DataFrame, columns: Sequence[str], name: str, bits: int = PLACE_BITS) -> DataFrame:
    """``df`` with its rows' key as ``name``: one aggregation finds the columns'
    quantiles (``2**bits - 1`` numbers each, all that reaches the driver), one
    binary search per cell its place, and a table the place's spread bits."""
    if not columns or bits * len(columns) > 62:
        raise ValueError("the places of all columns must fit a long")
    shares = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    found = df.agg(*[F.percentile_approx(_measure(df, c), shares, 10_000).alias(f"q{i}")
                     for i, c in enumerate(columns)]).first()
    splits, places = zip(*[_splits(found[f"q{j}"] or []) for j in range(len(columns))])
    measures, buckets = ([f"{name}_{kind}{j}" for j in range(len(columns))] for kind in ("measure", "bucket"))
    measured = df.select("*", *[_measure(df, c).alias(m) for c, m in zip(columns, measures)])
    rows = Bucketizer(splitsArray=[list(s) for s in splits], inputCols=measures, outputCols=buckets,
                      handleInvalid="keep").transform(measured)
    key: Column = F.lit(0).cast("long")
    for j, bucket in enumerate(buckets):
        spread = F.array(*[F.lit(_spread(p, j, len(columns))).cast("long") for p in places[j]])
        key = key.bitwiseOR(F.coalesce(F.get(spread, F.col(bucket).cast("int")), F.lit(0).cast("long")))
    return rows.withColumn(name, key).drop(*measures, *buckets)


def append_interleaved(df: DataFrame, path: str, columns: Sequence[str], files: int,
                       bits: int = PLACE_BITS) -> None:
    """Append ``df`` as about ``files`` files laid out by ``columns``, and note
    the files' ranges.  A batch becomes visible when its ranges are written."""
    spark, columns = df.sparkSession, list(columns)
    keyed = with_interleaved_key(df, columns, "_wl_key", bits)
    order = ["_wl_key", *columns, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    batch = f"{path}/batch-{uuid.uuid4().hex}"
    (keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_wl_key")
     .write.parquet(batch))
    written = spark.read.parquet(batch)
    ends = [agg(c).alias(f"{name}_{c}") for c in columns for name, agg in (("least", F.min), ("greatest", F.max))]
    (written.groupBy(F.col("_metadata.file_path").alias("file")).agg(*ends, F.count(F.lit(1)).alias("rows"))
     .coalesce(1).write.mode("append").parquet(f"{path}/{_RANGES}"))


def read_ranges(spark: SparkSession, path: str, ranges: Mapping[str, tuple]) -> DataFrame:
    """Rows whose columns lie within the given (least, greatest) values, both
    included (None: open), from the files that can hold any."""
    index = spark.read.parquet(f"{path}/{_RANGES}")
    meets, inside = F.lit(True), F.lit(True)
    for c, (low, high) in ranges.items():
        inside = inside & F.col(c).isNotNull()
        if low is not None:
            meets, inside = meets & (F.col(f"greatest_{c}") >= F.lit(low)), inside & (F.col(c) >= F.lit(low))
        if high is not None:
            meets, inside = meets & (F.col(f"least_{c}") <= F.lit(high)), inside & (F.col(c) <= F.lit(high))
    files = [r["file"] for r in index.filter(meets).select("file").collect()]
    if not files:
        any_file = index.select("file").first()
        return spark.read.parquet(any_file["file"]).limit(0)
    return spark.read.parquet(*files).filter(inside)

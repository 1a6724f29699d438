"""S3 — warehouse query scan over JDBC.

The SELECT runs in the warehouse (it is the ``dbtable`` subquery); filters
Spark adds on top are pushed into it where the dialect allows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_query(spark: SparkSession, url: str, query: str, properties: Mapping[str, str],
               partition_column: str | None = None, lower_bound: int | None = None,
               upper_bound: int | None = None, num_partitions: int | None = None
               ) -> DataFrame:
    """S3 — the caller's SELECT wrapped as a subquery and read over JDBC.

    Give ``partition_column`` with bounds and ``num_partitions`` for a
    parallel read (the reference read one partition)."""
    reader = spark.read.format("jdbc").option("url", url).option(
        "dbtable", f"({query}) subquery")
    for k, v in properties.items():
        reader = reader.option(k, v)
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("a partitioned read needs bounds and num_partitions")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions))
    return reader.load()

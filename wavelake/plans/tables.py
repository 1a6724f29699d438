"""Loading the driver's parquet tables (column pruning and filter pushdown
happen at the scan because every use is a lazy projection of these)."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str,
                   names: tuple[str, ...] = TABLES) -> None:
    """S4 helper: expose the tables to ``spark.sql`` under their own names,
    whatever stood there before."""
    for name in names:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path) or "://" in sf_dir:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def tables_named_in(query: str) -> tuple[str, ...]:
    """The driver tables whose names occur as words in ``query``."""
    return tuple(t for t in TABLES if re.search(rf"\b{t}\b", query))

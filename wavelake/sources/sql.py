"""S4 — ad-hoc SQL over registered tables.

The user's SELECT text runs through ``spark.sql``: the full relational surface
(joins, aggregates, windows, set operations, subqueries) is Catalyst's.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, query: str,
            tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Plan ``query`` lazily.  ``tables`` are visible to this query only: names
    are resolved when it is planned, and the temporary views that stood under
    them before are put back."""
    tables = dict(tables or {})
    catalog = spark._jsparkSession.sessionState().catalog()
    before = {name: catalog.getRawTempView(name) for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)
    finally:
        for name, old in before.items():
            spark.catalog.dropTempView(name)
            if old.isDefined():
                catalog.createTempView(name, old.get(), True)

"""K1, K2, K4, K5 — JDBC warehouse targets (append, create-if-absent DDL).

Rows are appended by Spark's JDBC writer from the executors, in parallel
batches.  The target DDL follows the reference's layouts (fixed below); it is
run once from the driver through the JVM's ``java.sql.DriverManager`` — the
only statement Spark's writer cannot issue itself (engine clauses such as
``MergeTree`` are not Spark types).  Credentials come from the caller, never
from literals.  No warehouse driver ships with Spark; add the vendor jar.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

DdlExecutor = Callable[[SparkSession, str, Mapping[str, str], str], None]

# JDBC drivers and target-table layouts of the warehouses.
CLICKHOUSE_DRIVER = "com.clickhouse.jdbc.ClickHouseDriver"
MYSQL_PROTOCOL_DRIVER = "com.mysql.cj.jdbc.Driver"
CLICKHOUSE_LANDING_DDL = (
    "CREATE TABLE IF NOT EXISTS {table} ({columns}, created_time DateTime DEFAULT now()) "
    "ENGINE = MergeTree() ORDER BY ({key}, created_time) PARTITION BY toYYYYMM(created_time)")
DORIS_LANDING_DDL = (
    "CREATE TABLE IF NOT EXISTS {table} ({columns}, "
    "`created_time` DATETIME DEFAULT CURRENT_TIMESTAMP) ENGINE=OLAP "
    "DUPLICATE KEY(`{key}`) DISTRIBUTED BY HASH(`{key}`) BUCKETS 1 "
    'PROPERTIES ("replication_num" = "1")')
CLICKHOUSE_SPECTRUM_DDL = (
    "CREATE TABLE IF NOT EXISTS {table} (result_id String, sample_index UInt64, "
    "frequency_hz Float64, magnitude Float64, phase Float64, created_time DateTime) "
    "ENGINE = MergeTree() ORDER BY (result_id, sample_index) PARTITION BY result_id")


# Words that ClickHouse reads as keywords where a column name may stand.
_KEYWORDS = frozenset("all and array as asc between by case cast constraint default desc distinct "
                      "else end engine exists final format from group having in index interval "
                      "into is join key like limit not null offset on or order primary projection "
                      "sample select set settings table then to ttl union using values view when "
                      "where with".split())


def quoted_if_needed(name: str) -> str:
    """A plain identifier as it is, anything else in backquotes."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name.lower() not in _KEYWORDS:
        return name
    return "`" + name.replace("\\", "\\\\").replace("`", "\\`") + "`"


def clickhouse_create_table(table: str, columns: Sequence[str]) -> str:
    """K4: first column ``String`` (a sort key cannot be Nullable), the rest
    ``Nullable(String)``, plus ``created_time``; MergeTree ordered by (first,
    created_time), partitioned by month."""
    if not columns:
        raise ValueError("no columns")
    names = [quoted_if_needed(c) for c in columns]
    cols = [f"{names[0]} String", *[f"{c} Nullable(String)" for c in names[1:]]]
    return CLICKHOUSE_LANDING_DDL.format(table=table, columns=", ".join(cols), key=names[0])


def doris_create_table(table: str, columns: Sequence[str]) -> str:
    """K5: every column ``String`` plus ``created_time``; duplicate key and
    hash distribution on the first column, one bucket, one replica."""
    if not columns:
        raise ValueError("no columns")
    cols = ", ".join(f"`{c}` String" for c in columns)
    return DORIS_LANDING_DDL.format(table=table, columns=cols, key=columns[0])


def spectrum_create_table(table: str) -> str:
    """K8 (JDBC form): typed spectrum table keyed by (result_id, sample_index)."""
    return CLICKHOUSE_SPECTRUM_DDL.format(table=table)


def jvm_ddl_executor(spark: SparkSession, url: str, properties: Mapping[str, str],
                     statement: str) -> None:
    """Run one DDL statement over JDBC from the driver JVM."""
    jvm = spark.sparkContext._jvm
    props = jvm.java.util.Properties()
    for k, v in properties.items():
        props.setProperty(k, str(v))
    if "driver" in properties:
        # Spark's registry loads the class from --jars too and makes it known
        # to DriverManager
        getattr(jvm.org.apache.spark.sql.execution.datasources.jdbc,
                "DriverRegistry").register(properties["driver"])
    conn = jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        stmt = conn.createStatement()
        try:
            stmt.execute(statement)
        finally:
            stmt.close()
    finally:
        conn.close()


@dataclass
class JdbcSink:
    """A JDBC warehouse target.  ``properties`` holds ``user``/``password``
    (from the caller's secrets) and optional ``batchsize``/``numPartitions``."""

    dialect: str
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    ddl_executor: DdlExecutor = jvm_ddl_executor
    batch_size: int | None = None       # rows per INSERT batch
    num_partitions: int | None = None   # cap on concurrent connections

    def _props(self) -> dict[str, str]:
        props = dict(self.properties)
        props.setdefault("driver", CLICKHOUSE_DRIVER if self.dialect == "clickhouse"
                         else MYSQL_PROTOCOL_DRIVER)
        if self.batch_size:
            props["batchsize"] = str(self.batch_size)
        if self.num_partitions:
            props["numPartitions"] = str(self.num_partitions)
        return props

    def create_statement(self, df: DataFrame, table: str) -> str:
        if "created_time" in df.columns:
            raise ValueError("input already has a 'created_time' column")
        if self.dialect == "clickhouse":
            return clickhouse_create_table(table, df.columns)
        if self.dialect == "doris":
            return doris_create_table(table, df.columns)
        raise ValueError(f"unknown JDBC dialect {self.dialect!r}")

    def create_if_absent(self, df: DataFrame, table: str) -> None:
        self.ddl_executor(df.sparkSession, self.url, self._props(),
                          self.create_statement(df, table))

    def write(self, df: DataFrame, table: str) -> None:
        """K1/K2: append from the executors."""
        df.write.mode("append").jdbc(self.url, table, properties=self._props())

    def write_spectrum(self, df: DataFrame, table: str) -> None:
        """K8: create the typed spectrum table, then append."""
        if self.dialect != "clickhouse":
            raise ValueError(f"no spectrum table layout for {self.dialect!r}")
        self.ddl_executor(df.sparkSession, self.url, self._props(), spectrum_create_table(table))
        self.write(df, table)

    def write_summary(self, df: DataFrame, table: str) -> None:
        """K9: append to the (existing) summary table."""
        self.write(df, table)

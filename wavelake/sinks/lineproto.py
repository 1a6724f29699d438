"""K3, K6 — line-protocol sink, written partition-parallel from executors.

Lines are rendered JVM-side (:func:`wavelake.functions.lineproto.line_protocol`)
and leave in one of two ways:

* ``http`` — a Python data source batches each task's lines (``batch_lines``
  per request) and POSTs them to ``<url>/write?db=<database>``; anything but
  204 fails the task (Spark retries it: delivery is at-least-once, and a
  retried batch has the same timestamps, so it overwrites the same points);
* ``file`` — Spark's text writer puts them into the folder ``path`` (any
  Hadoop file system); only committed attempts leave files.

Nothing is collected to the driver.  Usage::

    register(spark)
    lines_df.write.format("lineprotocol").mode("append") \
        .option("url", url).option("database", db).save()
"""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter,
                                    DataSourceStreamArrowWriter, DataSourceStreamWriter,
                                    DataSourceWriter, WriterCommitMessage)

from wavelake.functions.lineproto import line_protocol, measurement_name, with_line_protocol
from wavelake.session import ship_package

FORMAT_NAME = "lineprotocol"
DEFAULT_BATCH_LINES = 5000


Post = Callable[..., int]


def _http_post(url: str, body: bytes, content_type: str | None = None,
               timeout: float = 60.0) -> int:
    req = urllib.request.Request(url, data=body, method="POST")
    if content_type:
        req.add_header("Content-Type", content_type)
    with urllib.request.urlopen(req, timeout=timeout) as resp:  # noqa: S310
        return resp.status


def create_database(url: str, database: str, post: Post = _http_post,
                    user: str = "", password: str = "") -> int:
    """K6 — ``CREATE DATABASE`` through the query endpoint (driver, once)."""
    body = urllib.parse.urlencode({"q": f"CREATE DATABASE {database}"}).encode()
    login = urllib.parse.urlencode({"u": user, "p": password}) if user else ""
    return post(f"{url.rstrip('/')}/query{'?' if login else ''}{login}", body,
                "application/x-www-form-urlencoded")


@dataclass
class LineBatchCommit(WriterCommitMessage):
    partition_id: int
    lines: int
    batches: int


class LineProtocolWriter(DataSourceArrowWriter):
    """Receives each task's rows as Arrow record batches and sends them in
    chunks of at most ``batch_lines`` lines, straight from the Arrow buffers
    (no per-line Python objects)."""

    def __init__(self, options: dict[str, str], post: Post = _http_post):
        self.url = options.get("url", "")
        self.database = options.get("database", "")
        self.login = {"u": options["user"], "p": options.get("password", "")} \
            if options.get("user") else {}
        self.column = options.get("column", "line")
        self.batch_lines = int(options.get("batch_lines", DEFAULT_BATCH_LINES))
        self.post = post
        if not (self.url and self.database):
            raise ValueError("http transport needs 'url' and 'database' options")

    def _send(self, payload: bytes) -> None:
        query = urllib.parse.urlencode({"db": self.database, **self.login})
        status = self.post(f"{self.url.rstrip('/')}/write?{query}", payload)
        if status != 204:
            raise RuntimeError(f"line-protocol write failed with HTTP {status}")

    def write(self, iterator):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        lines = batches = 0
        for record_batch in iterator:
            col = record_batch.column(self.column)
            col = col.filter(col.is_valid())
            if len(col) == 0:
                continue
            # every line + "\n", laid out back to back in one Arrow buffer
            terminated = pc.binary_join_element_wise(col, pa.scalar(""), "\n")
            for start in range(0, len(terminated), self.batch_lines):
                chunk = terminated.slice(start, self.batch_lines)
                self._send(_buffer_bytes(chunk))
                lines, batches = lines + len(chunk), batches + 1
        return LineBatchCommit(part, lines, batches)


def _buffer_bytes(strings: pa.Array) -> bytes:
    """The concatenated bytes of a (sliced) string array, without building
    one Python object per element."""
    _, offsets_buf, data_buf = strings.buffers()
    width = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    offsets = np.frombuffer(offsets_buf, dtype=width)
    first = int(offsets[strings.offset])
    last = int(offsets[strings.offset + len(strings)])
    return data_buf.slice(first, last - first).to_pybytes()


class LineProtocolStreamWriter(DataSourceStreamArrowWriter):
    """Streaming form: each micro-batch's tasks send their lines the same
    way; a replayed micro-batch resends (at-least-once)."""

    def __init__(self, options: dict[str, str]):
        self._batch_writer = LineProtocolWriter(options)

    def write(self, iterator):
        return self._batch_writer.write(iterator)

    def commit(self, messages, batchId: int) -> None:
        pass

    def abort(self, messages, batchId: int) -> None:
        pass


class LineProtocolDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT_NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LineProtocolWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return LineProtocolStreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(LineProtocolDataSource)


@dataclass
class LineProtocolSink:
    """K3 as a warehouse target: render, then write from the executors.

    ``properties`` may hold ``user`` and ``password``.  Without ``time_col``
    every row gets a nanosecond of its own (see
    :func:`wavelake.functions.lineproto.row_clock_nanos`)."""

    url: str
    database: str
    transport: str = "http"
    path: str = ""
    time_col: str | None = None
    batch_lines: int = DEFAULT_BATCH_LINES
    tags: tuple[str, ...] = ()
    compat: bool = True   # False: escaped keys, tags, typed numeric fields
    properties: Mapping[str, str] = field(default_factory=dict)
    post: Post = _http_post   # used on the driver, for K6

    def __post_init__(self) -> None:
        if self.transport not in ("http", "file"):
            raise ValueError(f"unknown transport {self.transport!r}")
        if self.transport == "file" and not self.path:
            raise ValueError("file transport needs a path")

    def create_if_absent(self, df: DataFrame, table: str) -> None:
        if self.transport == "http":
            create_database(self.url, self.database, self.post, self.properties.get("user", ""),
                            self.properties.get("password", ""))

    def render(self, df: DataFrame, table: str) -> DataFrame:
        """One ``line`` per row, null when the row has no field left.  One
        projection lets subexpression elimination build the field set once."""
        name = measurement_name(table, self.database)
        return df.select(line_protocol(df, name, time_col=self.time_col, tags=self.tags,
                                       compat=self.compat).alias("line"))

    def write(self, df: DataFrame, table: str) -> None:
        if self.transport == "file":
            name = measurement_name(table, self.database)
            lines = with_line_protocol(df, name, time_col=self.time_col, tags=self.tags,
                                       compat=self.compat)
            lines.write.mode("append").text(self.path)
            return
        register(df.sparkSession)
        (self.render(df, table).write.format(FORMAT_NAME).mode("append")
         .option("url", self.url).option("database", self.database)
         .option("user", self.properties.get("user", ""))
         .option("password", self.properties.get("password", ""))
         .option("batch_lines", str(self.batch_lines)).save())

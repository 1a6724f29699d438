"""S2 for compressed logs: gzip files of several members, split at members.

Spark reads a gzip file in one task.  Log rotation and parallel compression
leave files that are many gzip members in a row; any of them can be read on its
own.  This Python data source plans splits of ``splitBytes`` compressed bytes.
A task looks for the first member that begins in its split (a header's bytes
can occur inside a member, so a candidate counts only if it decompresses to its
end, checksum included) and reads the members from there on.

Lines may run across members.  As for plain text, a split leaves out the line
that it begins in, and reads on to the end of the line that its last member
begins or ends in.  Lines end with ``\\n`` or ``\\r\\n``.  Files are read through
``pyarrow.fs``: ``file:``, ``hdfs:``, ``s3:`` and ``gs:`` paths.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavelake.session import ship_package
from wavelake.sources.text import FILE_COL, LINE_COL, SPLIT_COL

SPLIT_BYTES = 64 << 20
_READ = 256 << 10
_LINES = 8192          # of a batch that is passed on
_MAGIC = b"\x1f\x8b\x08"
_SCHEMA = f"value string, {FILE_COL} string, {SPLIT_COL} long, {LINE_COL} long"


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _inflated(file, at: int) -> Iterator[tuple[bytes, int | None]]:
    """Chunks of the member at ``at``; with the last one, where it ends."""
    codec = zlib.decompressobj(31)
    file.seek(at)
    while raw := file.read(_READ):
        at += len(raw)
        while raw and not codec.eof:
            out = codec.decompress(raw, _READ)
            raw = codec.unconsumed_tail
            if codec.eof:
                yield out, at - len(codec.unused_data)
                return
            if out:
                yield out, None
    raise zlib.error("the member is cut off")


def _is_member(file, at: int) -> bool:
    try:
        for _ in _inflated(file, at):
            pass
    except zlib.error:
        return False
    return True


def first_member(file, start: int, end: int) -> int | None:
    """Where the first member of ``file`` in ``start``..``end`` begins."""
    held, base = b"", start
    while base + len(held) < end + len(_MAGIC) - 1:
        file.seek(base + len(held))
        raw = file.read(_READ)
        held += raw
        at = held.find(_MAGIC)
        while at >= 0:
            if base + at >= end:
                return None
            if _is_member(file, base + at):
                return base + at
            at = held.find(_MAGIC, at + 1)
        if not raw:
            return None
        base, held = base + len(held) - 2, held[-2:]
    return None


def split_lines(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines of a split."""
    at = 0 if start == 0 else first_member(file, start, end)
    if at is None or at >= size:
        return
    skip, held, line_at, read, boundary = start > 0, b"", 0, 0, None
    while at is not None and at < size:
        if at >= end and boundary is None:
            boundary = read     # a line that begins up to here is still this split's
        file.seek(at)
        if file.read(len(_MAGIC)) != _MAGIC:
            break               # padding behind the last member
        for out, ended in _inflated(file, at):
            at = ended
            read += len(out)
            *lines, held = (held + out).split(b"\n")
            for line in lines:
                if skip:
                    skip = False
                elif boundary is None or line_at <= boundary:
                    yield line.removesuffix(b"\r")
                line_at += len(line) + 1
                if boundary is not None and line_at > boundary:
                    return
    if held and not skip and (boundary is None or line_at <= boundary):
        yield held.removesuffix(b"\r")


class GzipLinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["paths"].split("\n")
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        out = []
        for given in self.paths:
            files, path = _opened(given)
            info = files.get_file_info(path)
            if info.type == pafs.FileType.Directory:
                found = files.get_file_info(pafs.FileSelector(path, recursive=True))
                found = sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))),
                               key=lambda f: f.path)
                named = [(f"{given.rstrip('/')}/{f.path[len(path.rstrip('/')) + 1:]}", f.size) for f in found]
            elif info.is_file:
                named = [(given, info.size)]
            else:
                raise FileNotFoundError(given)
            for name, size in named:
                out += [Split(name, s, min(size, s + self.split_bytes)) for s in range(0, size, self.split_bytes)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        files, path = _opened(partition.path)
        size = files.get_file_info(path).size
        held: list[str] = []
        number = 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), pa.array([partition.path] * n, pa.string()),
                 pa.array([partition.start] * n, pa.int64()), pa.array(range(number, number + n), pa.int64())],
                names=["value", FILE_COL, SPLIT_COL, LINE_COL])

        with files.open_input_file(path) as file:
            for line in split_lines(file, partition.start, partition.end, size):
                held.append(line.decode("utf-8", "replace"))
                if len(held) == _LINES:
                    yield batch()
                    number, held = number + len(held), []
        if held:
            yield batch()


class GzipLinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> GzipLinesReader:
        return GzipLinesReader(self.options)


def read_gzip_lines(spark: SparkSession, paths: str | Sequence[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of gzip files (folders allowed) with their file position, as
    ``read_lines`` gives them, many splits to a file of several members."""
    ship_package(spark)
    spark.dataSource.register(GzipLinesSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.format("gzip_lines").option("paths", "\n".join(paths))
            .option("splitBytes", str(split_bytes)).load())


def write_gzip_members(lines: DataFrame, path: str, member_lines: int) -> int:
    """Write the column ``value`` of each task's rows, in order, as one gzip
    file of members of ``member_lines`` lines; returns the number of files.  A
    task that is run again replaces its file."""
    ship_package(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.gz"
        files, folder = _opened(path)
        files.create_dir(folder, recursive=True)
        made, held, n = f"{folder}/_{name}.{uuid.uuid4().hex}", [], 0

        def member() -> bytes:
            codec = zlib.compressobj(6, zlib.DEFLATED, 31)
            return codec.compress("".join(f"{x}\n" for x in held).encode()) + codec.flush()

        with files.open_output_stream(made, compression=None) as out:
            for batch in batches:
                for line in batch.column("value").to_pylist():
                    held.append(line or "")
                    if len(held) == member_lines:
                        out.write(member())
                        held, n = [], n + 1
            if held:
                out.write(member())
                n += 1
        if n:
            files.move(made, f"{folder}/{name}")
        else:
            files.delete_file(made)
        yield pa.RecordBatch.from_arrays([pa.array([int(n > 0)], pa.int64())], names=["files"])

    return sum(r["files"] for r in lines.select("value").mapInArrow(run, "files long").collect())

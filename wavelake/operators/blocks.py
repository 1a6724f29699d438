"""T4 — data-block segmentation of interleaved log / measurement text.

State machine per stream: a (trimmed) line starting ``[`` closes the data
block, a line starting ``timestamp`` opens it (and is not emitted), any other
line is emitted only while the block is open; each stream starts closed.

Deliberate divergence: the reference restarted the state in every partition,
losing the rows of a block that crosses a split; here the state runs over the
whole stream (file) and resets only at the next one.

Distributed segmented scan in one pass over the text, no global sort and no
whole stream in one task:

1. each split (a file split, or a task of a range sort) computes its local
   state with a vectorised forward fill over Arrow batches (``mapInArrow``;
   the text itself is never converted), in the order the split is read.  It
   emits the data lines that are open or still undecided, numbered by split,
   and one marker row with the split's keys and last marker.  All that is
   written once; nothing later depends on how the text is split;
2. a window over the marker rows (one per split) gives each split the state
   carried in from earlier splits of the same stream;
3. open lines are in; undecided ones join their split's carried state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavelake.functions.text import CLOSE_BLOCK, OPEN_BLOCK, block_marker, java_trim
from wavelake.operators.clean import parse_fields_strict
from wavelake.operators.ordering import materialized
from wavelake.session import ship_package
from wavelake.sources.text import FILE_COL, LINE_COL, SPLIT_COL, file_splits

_KEY = "_wl_key"
_MARK = "_wl_marker"
_STATE = "_wl_state"
_SPLIT = "_wl_split"
_END = "_wl_end"
_SPLIT_BITS = 33


def _segment_key(cols: Sequence[str]) -> Column:
    """One long per (stream, split); null-safe: null flags are hashed too."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    flags = [F.col(c).isNull() for c in cols]
    return F.xxhash64(*parts, *flags)


def _resolve_splits(keys: Sequence[str], schema: pa.Schema):
    """Forward fill per split, in read order, on Arrow batches: only the
    marker and split-key columns are touched (numpy).  State carries across
    batches of the same split.  ``keys`` are filled in on marker rows only."""

    def rows(rb: pa.RecordBatch, split: np.ndarray, state: pa.Array, end: bool) -> pa.RecordBatch:
        n = rb.num_rows
        extra = {_SPLIT: pa.array(split, pa.int64()), _STATE: state,
                 _END: pa.array(np.full(n, end))}
        columns = []
        for field in schema:
            if field.name in extra:
                columns.append(extra[field.name])
            elif (field.name in keys) == end:
                columns.append(rb.column(field.name))
            else:
                columns.append(pa.nulls(n, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _SPLIT_BITS
        number = -1
        last_key, last_state, last_row = None, None, None

        def end_row() -> pa.RecordBatch:
            return rows(last_row, np.array([base + number]),
                        pa.array([last_state], pa.int32()), True)

        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            key = rb.column(_KEY).to_numpy()
            marks = rb.column(_MARK)
            valid = marks.is_valid().to_numpy(zero_copy_only=False)
            mark = marks.fill_null(0).to_numpy(zero_copy_only=False)
            pos = np.arange(n)
            starts = np.empty(n, dtype=bool)
            starts[0] = last_row is None or key[0] != last_key
            starts[1:] = key[1:] != key[:-1]
            split = number + np.cumsum(starts)
            seg_start = np.maximum.accumulate(np.where(starts, pos, 0))
            seen = np.maximum.accumulate(np.where(valid, pos, -1))
            known = seen >= seg_start          # a marker seen earlier in this split
            state = np.where(known, mark[np.maximum(seen, 0)], 0)
            if last_state is not None:         # a continued split: state of the last batch
                fill = ~known & (split == number)
                state = np.where(fill, last_state, state)
                known = known | fill
            if starts[0] and last_row is not None:   # the split before has ended
                yield end_row()
            ends = np.flatnonzero(starts[1:])        # last rows of splits that end inside
            if len(ends):
                yield rows(rb.take(pa.array(ends)), base + split[ends],
                           pa.array(state[ends].astype(np.int32), mask=~known[ends]), True)
            number, last_key, last_row = int(split[-1]), key[-1], rb.slice(n - 1, 1)
            last_state = int(state[-1]) if known[-1] else None
            keep = pa.array(~valid & (~known | (state == OPEN_BLOCK)))
            kept = rb.filter(keep)
            if kept.num_rows:
                at = keep.to_numpy(zero_copy_only=False)
                yield rows(kept, base + split[at],
                           pa.array(state[at].astype(np.int32), mask=~known[at]), False)
        if last_row is not None:
            yield end_row()

    return run


def segment_blocks(df: DataFrame, stream_cols: Sequence[str], split_cols: Sequence[str],
                   keep: Sequence[str], value_col: str = "value", split_bytes: int | None = None) -> DataFrame:
    """``keep`` columns of the rows of ``df`` that are data lines inside an
    open block.

    ``df`` must be laid out so that each partition holds whole splits in line
    order (a file scan, a range sort).  ``(stream_cols..., split_cols...)``
    identifies a split; splits of a stream are ordered by ``split_cols``.
    ``split_bytes`` sets the size of file splits for the one scan of ``df``.
    """
    ship_package(df.sparkSession)
    split_keys = [*stream_cols, *split_cols]
    names = [f"_wl_k{i}" for i in range(len(split_keys))]
    marked = df.select(*keep, *[F.col(c).alias(n) for c, n in zip(split_keys, names)],
                       _segment_key(split_keys).alias(_KEY),
                       block_marker(value_col).cast("int").alias(_MARK))
    fields = [f for f in marked.schema.fields if f.name not in (_KEY, _MARK)]
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in fields],
                        T.StructField(_SPLIT, T.LongType()), T.StructField(_STATE, T.IntegerType()),
                        T.StructField(_END, T.BooleanType())])
    with file_splits(df.sparkSession, split_bytes):
        table = materialized(marked.mapInArrow(_resolve_splits(names, to_arrow_schema(out)), out),
                             "blocks")

    streams, order = names[:len(stream_cols)], names[len(stream_cols):]
    spec = Window.partitionBy(*streams) if streams else Window
    earlier = spec.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = table.filter(_END).select(
        F.col(_SPLIT).alias("_wl_open"),
        F.coalesce(F.last(_STATE, ignorenulls=True).over(earlier), F.lit(CLOSE_BLOCK)).alias("_wl_in"))
    carried = materialized(carried.filter(F.col("_wl_in") == OPEN_BLOCK).select("_wl_open"), "carry")

    lines = table.filter(~F.col(_END))
    undecided = lines.filter(F.col(_STATE).isNull()).join(
        carried, F.col(_SPLIT) == F.col("_wl_open"), "left_semi")
    return lines.filter(F.col(_STATE).isNotNull()).select(*keep).unionByName(undecided.select(*keep))


def file_blocks(lines: DataFrame, value_col: str = "value",
                stream_of: Column | None = None, split_bytes: int | None = None) -> DataFrame:
    """T4 over a :func:`wavelake.sources.text.read_lines` frame; its columns
    but the file position come back.

    By default the state resets at every file.  ``stream_of`` (a column
    expression over the file path, e.g. its folder) groups files into one
    stream — rotated logs — whose files follow each other in path order, so a
    block may continue into the next file.  A file read as one split (e.g.
    gzip) is handled by one task: the format cannot be split."""
    keep = [c for c in lines.columns if c not in (FILE_COL, SPLIT_COL, LINE_COL)]
    if stream_of is None:
        return segment_blocks(lines, [FILE_COL], [SPLIT_COL], keep, value_col, split_bytes)
    streamed = lines.withColumn("_wl_stream", stream_of)
    return segment_blocks(streamed, ["_wl_stream"], [FILE_COL, SPLIT_COL], keep, value_col, split_bytes)


def file_folder(path_col: str = FILE_COL) -> Column:
    """The folder of a file path: all files of one folder form one stream."""
    return F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1)


def ordered_blocks(df: DataFrame, order_by: Sequence[str | Column],
                   stream_cols: Sequence[str] = (), value_col: str = "value",
                   keep: Sequence[str] | None = None) -> DataFrame:
    """T4 over a table whose line order is given by ``order_by`` (state
    resets per ``stream_cols`` group).  The table is range-sorted on the full
    key — balanced even when one stream holds most lines — and each sort task
    resolves its own lines, so a task is a split.  ``keep`` limits the carried
    columns (value and stream keys are always kept)."""
    keep = list(dict.fromkeys([*stream_cols, value_col, *(df.columns if keep is None else keep)]))
    ordered = df.orderBy(*stream_cols, *order_by).withColumn(
        "_wl_task", F.spark_partition_id().cast("long"))
    return segment_blocks(ordered, stream_cols, ["_wl_task"], keep, value_col)


def clean_blocks(blocks: DataFrame, value_col: str = "value",
                 keep: Sequence[str] = ()) -> DataFrame:
    """T5 on the block rows: parse the trimmed line strictly, drop failures."""
    return parse_fields_strict(blocks.withColumn(value_col, java_trim(value_col)),
                               col=value_col, keep=keep)

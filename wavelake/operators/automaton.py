"""Any line automaton over ordered rows (T4 beyond "the last marker wins").

A finite automaton's effect on its state is a function of the state, and such
functions compose associatively.  So the states along a table, or along each
series, are a prefix scan whose values are functions (one byte per state):

1. one range sort on (series..., order...); in the same stage each task
   composes its rows' functions, by doubling on arrays, and writes for every
   row the function from the state at the task's start to the state before it;
2. one row per task, the whole task's function, is run through in order to get
   the state in which each task begins;
3. the state before a row is a look-up in its function.

A series' first row makes its function a constant, the start state, so a series
that spans many tasks and many series in one task need no further treatment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.operators.ordering import PART_COL, POS_COL, _as_cols, materialized, tag_positions
from wavelake.operators.scan import series_key
from wavelake.session import ship_package

MAX_STATES = 256


def _composed(functions: np.ndarray) -> np.ndarray:
    """Row i of the result: what rows 0..i of ``functions`` do one after the
    other (each row maps state to state)."""
    out, step = functions.copy(), 1
    while step < len(out):
        earlier = out[:-step].copy()
        out[step:] = np.take_along_axis(out[step:], earlier.astype(np.intp), axis=1)
        step *= 2
    return out


def _prefix_functions(table: np.ndarray, start: int, names: list[str]):
    """``mapInArrow`` body: add the function before each row (``_wl_before``)
    and after it."""
    n_states = table.shape[1]
    identity = np.arange(n_states, dtype=np.uint8)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = identity, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column("_wl_key").to_numpy()
            symbols = batch.column("_wl_symbol").fill_null(len(table) - 1).to_numpy()
            own = table[symbols]
            # the first row of a series starts anew whatever came before
            new = np.concatenate(([key is not None and keys[0] != key], keys[1:] != keys[:-1]))
            own[new] = table[symbols[new], start][:, None]
            after = _composed(np.concatenate((held[None], own)))
            before = after[:-1].copy()
            before[new] = start
            held, key = after[-1], keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], _binary(before), _binary(after[1:])],
                names=[*names, "_wl_before", "_wl_after"])

    return fn


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets),
                                                  pa.py_buffer(np.ascontiguousarray(rows))])


def _entries(start: int):
    """State in which each task begins, from one row per task in order."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = start, None
        for batch in batches:
            entries = []
            for first, last, after in zip(*(batch.column(c).to_pylist()
                                            for c in ("first_key", "last_key", "after"))):
                state = state if key == first else start
                entries.append(state)
                state, key = after[state], last
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(entries, pa.int32())],
                                             names=["part", "entry"])

    return fn


def run_automaton(df: DataFrame, order_by: Sequence[str | Column], symbol: Column,
                  transitions: Sequence[Sequence[int]], start: int = 0, series: Sequence[str] = (),
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``state_before`` and ``state_after`` of an automaton that reads the
    rows in order, beginning each series in ``start``.

    ``transitions[symbol][state]`` is the next state; ``symbol`` is an integer
    column below ``len(transitions)``.  A null or unknown symbol leaves the state as it
    is.  Order keys should be unique within a series."""
    n_states = len(transitions[0]) if transitions else 0
    if not 0 < n_states <= MAX_STATES or any(len(t) != n_states for t in transitions):
        raise ValueError(f"every symbol needs a next state for each of 1 to {MAX_STATES} states")
    if not all(0 <= s < n_states for t in transitions for s in t) or not 0 <= start < n_states:
        raise ValueError("states are numbered from 0")
    ship_package(df.sparkSession)
    series, n = list(series), len(transitions)
    table = np.array([*transitions, range(n_states)], dtype=np.uint8)   # the last: no change
    known = F.when((symbol >= 0) & (symbol < n), symbol).otherwise(F.lit(n))
    rows = df.withColumn("_wl_key", series_key(series)).withColumn(
        "_wl_symbol", F.coalesce(known, F.lit(n)).cast("int"))
    keys = [*_as_cols(series), *_as_cols(order_by)]
    if num_partitions:
        ordered = rows.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)
    else:
        ordered = rows.orderBy(*keys)
    names = rows.columns
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in names],
                           T.StructField("_wl_before", T.BinaryType()), T.StructField("_wl_after", T.BinaryType())])
    scanned = tag_positions(ordered.mapInArrow(_prefix_functions(table, start, names), schema))
    stored = materialized(scanned, "automaton")
    ends = stored.groupBy(F.col(PART_COL).alias("part")).agg(
        F.min_by("_wl_key", POS_COL).alias("first_key"), F.max_by("_wl_key", POS_COL).alias("last_key"),
        F.max_by("_wl_after", POS_COL).alias("after"))
    # one row per sort task, in their order
    in_order = materialized(ends, "automaton_ends").repartitionByRange(1, "part").sortWithinPartitions("part")
    entries = materialized(in_order.mapInArrow(_entries(start), "part long, entry int"), "automaton_entries")
    joined = stored.join(entries, F.col(PART_COL) == F.col("part"))

    def looked_up(function: str) -> Column:
        byte = F.substring(F.col(function), F.col("entry") + 1, F.lit(1))
        return F.conv(F.hex(byte), 16, 10).cast("int")

    return joined.select(*[F.col(f"`{c}`") for c in df.columns], looked_up("_wl_before").alias("state_before"),
                         looked_up("_wl_after").alias("state_after"))

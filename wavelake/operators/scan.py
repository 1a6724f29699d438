"""Ordered analytics over a whole table, without a window that one task runs.

``running`` gives prefix aggregates (sum, count, min, max, first, last known)
and ``over_rows`` moving frames, ``lag`` and ``lead``, along an order that
covers the whole table or restarts per series, however long a series is.

Running aggregates are a segmented prefix scan:

1. one range sort on (series..., order...) spreads a hot series over balanced
   tasks (:mod:`wavelake.operators.ordering`);
2. in the same stage each task scans its rows, Arrow batch by Arrow batch, the
   scan restarting where the series changes; values and tags are written once;
3. one row per (task, series), the scan's last value there, is scanned again
   over the tasks, and what comes before a task is combined with its rows.

Any aggregate with an associative combination fits: see :class:`Scan`.

Moving frames need neighbours only.  The indexed rows are cut into blocks of
equal length; each block also gets copies of the rows within the frame's reach
on either side (halo rows, a small share of the block), frames are evaluated by
Spark's own window functions inside a block, and the copies are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.operators.ordering import (PART_COL, POS_COL, _as_cols, contiguous_index, materialized,
                                         null_safe_join, tag_positions)
from wavelake.session import ship_package

BLOCK_ROWS = 1 << 16


@dataclass(frozen=True)
class Scan:
    """An associative aggregate: how a task scans segments of a column, how
    the tasks' totals are scanned, and how both combine.

    ``local`` gets the values (numpy; ``valid`` marks the non-null ones) and
    the start of each row's segment, and returns values and validity after
    every row.  A carried total is put in front of a segment as one more
    value, so the aggregate's state must be of the kind of its values."""

    local: Callable[[pa.Array, np.ndarray], pa.Array]
    total: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


def _last_known(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """Position of the last non-null value at or before each row of a segment
    (-1: none) gives the value, of whatever type."""
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    at = np.maximum.accumulate(np.where(valid, np.arange(len(values)), -1))
    return values.take(pa.array(at, mask=at < starts))


def _first_known(values: pa.Array, starts: np.ndarray) -> pa.Array:
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    at = np.append(np.where(valid, np.arange(len(values)), len(values)), len(values))
    ahead = np.minimum.accumulate(at[::-1])[::-1][starts]   # first known of the segment
    return values.take(pa.array(ahead, mask=ahead > np.arange(len(values))))


def _accumulated(fold: np.ufunc, neutral: Callable[[np.dtype], object]):
    def local(values: pa.Array, starts: np.ndarray) -> pa.Array:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        plain = values.fill_null(0).to_numpy(zero_copy_only=False)
        plain = np.where(valid, plain, np.array(neutral(plain.dtype), plain.dtype))
        out = np.empty_like(plain)
        cuts = np.flatnonzero(starts == np.arange(len(starts))).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(plain)]):
            fold.accumulate(plain[lo:hi], out=out[lo:hi])
        known = np.cumsum(valid)
        before = np.concatenate(([0], known))[starts]
        return pa.array(out, mask=known == before)
    return local


def _lowest(kind: np.dtype):
    return -np.inf if kind.kind == "f" else np.iinfo(kind).min


def _highest(kind: np.dtype):
    return np.inf if kind.kind == "f" else np.iinfo(kind).max


SUM = Scan(_accumulated(np.add, lambda kind: 0), F.sum, lambda a, b: a + b)
MIN = Scan(_accumulated(np.minimum, _highest), F.min, F.least)
MAX = Scan(_accumulated(np.maximum, _lowest), F.max, F.greatest)
LAST = Scan(_last_known, lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))
FIRST = Scan(_first_known, lambda c: F.first(c, ignorenulls=True), F.coalesce)


def _segmented(scans: list[tuple[str, Scan]], names: list[str]):
    """``mapInArrow`` body: the scanned columns of consecutive rows, restarting
    where ``_wl_key`` changes; a segment goes on across batches."""

    def fn(batches):
        key, carried = None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column("_wl_key").to_numpy()
            goes_on = key is not None and keys[0] == key
            if goes_on:  # the totals so far stand in front
                keys = np.concatenate(([key], keys))
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            out = {}
            for name, scan in scans:
                values = batch.column(name)
                if goes_on:
                    values = pa.concat_arrays([carried[name], values])
                scanned = scan.local(values, starts)
                out[name] = scanned.slice(1) if goes_on else scanned
                carried[name] = scanned.slice(len(scanned) - 1)
            key = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [out[c] if c in out else batch.column(c) for c in names], names=names)

    return fn


def series_key(series: Sequence[str]) -> Column:
    """A hash that tells neighbouring series apart (null is one of its own)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in series]
    return F.xxhash64(F.lit(0), *cells, *[F.col(c).isNull() for c in series])


def running(df: DataFrame, order_by: Sequence[str | Column],
            columns: Mapping[str, tuple[Scan, Column]], series: Sequence[str] = (),
            num_partitions: int | None = None) -> DataFrame:
    """Add, per entry of ``columns``, the scan of its column over all rows up
    to and including the own one in the given order.

    As in SQL, null values leave the aggregate as it was (null before the
    first value); sums and extremes are over longs or doubles.  Order keys
    should be unique within a series for a stable result."""
    ship_package(df.sparkSession)
    series = list(series)
    values = {name: f"_wl_v{i}" for i, name in enumerate(columns)}
    rows = df.withColumn("_wl_key", series_key(series))
    for name, (_, value) in columns.items():
        rows = rows.withColumn(values[name], value)
    keys = [*_as_cols(series), *_as_cols(order_by)]
    if num_partitions:
        ordered = rows.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)
    else:
        ordered = rows.orderBy(*keys)
    kept = [c for c in rows.columns if c != "_wl_key"]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in kept])
    scans = [(values[name], scan) for name, (scan, _) in columns.items()]
    stored = materialized(tag_positions(ordered.mapInArrow(_segmented(scans, kept), schema)), "scan")

    ends = stored.groupBy(PART_COL, *series).agg(F.max_by(
        F.struct(*values.values()), POS_COL).alias("_wl_end"))
    spec = Window.partitionBy(*series) if series else Window
    before = spec.orderBy(PART_COL).rowsBetween(Window.unboundedPreceding, -1)
    summary = materialized(ends.select(PART_COL, *series, *[
        scan.total(F.col(f"_wl_end.{v}")).over(before).alias(f"{v}_before") for v, scan in scans]),
        "scan_totals")
    joined = null_safe_join(stored, summary, [PART_COL, *series])

    def combined(name: str) -> Column:
        here, prior = F.col(values[name]), F.col(f"{values[name]}_before")
        both = columns[name][0].combine(prior, here)
        return F.when(prior.isNull(), here).when(here.isNull(), prior).otherwise(both).alias(name)

    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *map(combined, columns))


def over_rows(df: DataFrame, order_by: Sequence[str | Column],
              columns: Mapping[str, Callable[[WindowSpec], Column]], preceding: int, following: int,
              series: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add, per entry of ``columns``, a column computed over the frame of
    ``preceding`` rows before to ``following`` rows after each row.

    An entry gets the window and returns a column over it, such as
    ``lambda w: F.avg("value").over(w)``; ``F.lag`` and ``F.lead`` by up to
    the frame's reach take the window's order alone: see :func:`neighbours`."""
    if preceding < 0 or following < 0:
        raise ValueError("a frame reaches from rows before to rows after its own row")
    block = max(block_rows, preceding + following, 1)
    series = list(series)
    indexed = contiguous_index(df, list(order_by), partition_by=series, index_col="_wl_i")
    indexed = indexed.select(*[F.col(f"`{c}`") for c in df.columns], "_wl_i")
    own = F.expr(f"_wl_i div {block}")
    at = F.expr(f"_wl_i % {block}")
    homes = F.array_compact(F.array(
        F.struct(own.alias("block"), F.lit(True).alias("own")),
        F.when((at < following) & (own > 0), F.struct((own - 1).alias("block"), F.lit(False).alias("own"))),
        F.when(at >= block - preceding, F.struct((own + 1).alias("block"), F.lit(False).alias("own")))))
    dealt = indexed.withColumn("_wl_b", F.explode(homes)).select(
        *indexed.columns, F.col("_wl_b.block").alias("_wl_block"), F.col("_wl_b.own").alias("_wl_own"))
    window = Window.partitionBy(*series, "_wl_block").orderBy("_wl_i").rowsBetween(-preceding, following)
    framed = dealt.select("*", *[make(window).alias(name) for name, make in columns.items()])
    return framed.filter("_wl_own").select(*[F.col(f"`{c}`") for c in df.columns], *columns)


def neighbours(df: DataFrame, order_by: Sequence[str | Column],
               columns: Mapping[str, tuple[str, int]], series: Sequence[str] = ()) -> DataFrame:
    """Add, per entry ``name: (column, offset)``, the column's value that many
    rows before (``offset`` < 0, as ``lag``) or after (as ``lead``) each row;
    null beyond the ends of its series."""
    preceding = max([0, *[-k for _, k in columns.values()]])
    following = max([0, *[k for _, k in columns.values()]])

    def shifted(column: str, k: int) -> Callable[[WindowSpec], Column]:
        # one row of the frame; outside the frame's reach there is none
        return lambda w: F.first(F.col(column)).over(w.rowsBetween(k, k))

    return over_rows(df, order_by, {name: shifted(c, k) for name, (c, k) in columns.items()},
                     preceding, following, series)

"""X1 — framed real discrete Fourier transform (the spectrum the compatible
T6–T11 table only simulates).

Per series the samples are indexed in order (T7, skew-safe), cut into frames
of ``frame_size`` consecutive samples, and each frame is transformed:

    re_k = sum_n x_n cos(2 pi k n / N),  im_k = -sum_n x_n sin(2 pi k n / N)

for bins k = 0..N/2, with ``frequency_hz = k * rate / N``,
``magnitude = sqrt(re^2 + im^2)`` and ``phase = atan2(im, re)``.  A trailing
partial frame is zero-padded.

Plan: the JVM groups each frame into one sorted array (a group is bounded by
the frame length, never by the data); ``mapInArrow`` scatters all frames of
an Arrow batch into one matrix through the list offsets, runs
``numpy.fft.rfft`` on it and emits one row per bin — no Python loop per
frame or per sample.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavelake.functions.numeric import as_double
from wavelake.operators.ordering import contiguous_index, materialized
from wavelake.session import ship_package

DEFAULT_FRAME_SIZE = 64
DEFAULT_SAMPLE_RATE_HZ = 1000.0

_SLICE_BYTES = 8 << 20   # of a matrix of frames that is transformed at once


def _runs_of_frames(frame_size: int, schema: pa.Schema):
    """``mapInArrow`` body: consecutive samples of one frame become one row
    with the samples as a list.  A run goes on across batches."""

    def rows(rb: pa.RecordBatch) -> pa.RecordBatch:
        key = rb.column("_wl_key").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        offsets = pa.array(np.concatenate((starts, ends[-1:])).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, rb.column("_wl_x"))
        take = pa.array(starts)
        return pa.RecordBatch.from_arrays(
            [lists if f.name == "_wl_xs" else rb.column(f.name).take(take) for f in schema],
            schema=schema)

    def fn(batches):
        held = None
        for rb in batches:
            if held is not None:
                rb = pa.Table.from_batches([held, rb]).combine_chunks().to_batches()[0]
            key = rb.column("_wl_key").to_numpy()
            other = np.flatnonzero(key != key[-1]) if len(key) else []
            cut = int(other[-1]) + 1 if len(other) else 0   # the last run may go on
            if cut:
                yield rows(rb.slice(0, cut))
            held = rb.slice(cut) if rb.num_rows else held
        if held is not None and held.num_rows:
            yield rows(held)

    return fn


def _rfft_frames(frame_size: int, carried: list[str]):
    """``mapInArrow`` body: the frames of an Arrow batch are scattered into
    (frames x N) matrices through the list offsets, a bounded slice at a time,
    transformed at once, and returned as one row per (frame, bin) — no Python
    loop per frame."""
    nbins = frame_size // 2 + 1
    per_slice = max(1, _SLICE_BYTES // (8 * frame_size))

    def fn(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, per_slice):
                rb = whole.slice(start, per_slice)
                m = rb.num_rows
                xs = rb.column("_wl_xs")
                offsets = xs.offsets.to_numpy().astype(np.int64)
                values = xs.flatten().to_numpy(zero_copy_only=False)
                lengths = np.diff(offsets)
                mat = np.zeros((m, frame_size), dtype=np.float64)
                rows = np.repeat(np.arange(m), lengths)
                cols = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
                mat[rows, cols] = values
                spec = np.fft.rfft(mat, axis=1)
                im = spec.imag.copy()
                # DC (and Nyquist for even N) are real by definition: drop the
                # rounding noise so their phase is exactly 0 or pi.
                im[:, 0] = 0.0
                if frame_size % 2 == 0:
                    im[:, -1] = 0.0
                take = pa.array(np.repeat(np.arange(m), nbins))
                out = {c: rb.column(c).take(take) for c in carried}
                out["bin"] = pa.array(np.tile(np.arange(nbins, dtype=np.int64), m))
                out["re"] = pa.array(spec.real.ravel())
                out["im"] = pa.array(im.ravel())
                yield pa.RecordBatch.from_pydict(out)
    return fn


def framed_dft(df: DataFrame, value_col: str, order_by: Sequence[str | Column],
               series: Sequence[str] = (), frame_size: int = DEFAULT_FRAME_SIZE,
               sample_rate: float = DEFAULT_SAMPLE_RATE_HZ) -> DataFrame:
    """One row per (series..., frame, bin) with frequency, re, im, magnitude
    and phase.  Rows whose value does not parse as a double are skipped."""
    if frame_size < 2:
        raise ValueError("frame_size must be at least 2")
    ship_package(df.sparkSession)
    series = list(series)
    samples = (df.withColumn("_wl_x", as_double(value_col))
               .filter(F.col("_wl_x").isNotNull()))
    if all(isinstance(c, str) for c in order_by):
        samples = samples.select(*dict.fromkeys([*series, *order_by]), "_wl_x")
    indexed = contiguous_index(samples, list(order_by), partition_by=series,
                               index_col="_wl_n", keep=["_wl_x"])
    # The samples come in order, so a task holds nearly all its frames whole;
    # only the pieces of frames that two tasks share, and the short last frame
    # of a series, are shuffled.
    pos = F.expr(f"_wl_n % {frame_size}")
    frame = F.expr(f"_wl_n div {frame_size}")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in series]
    samples = indexed.select(
        *series, frame.alias("frame"), pos.alias("_wl_pos"), F.col("_wl_x"),
        F.xxhash64(*keys, *[F.col(c).isNull() for c in series], frame).alias("_wl_key"))
    run_schema = T.StructType([*[f for f in samples.schema if f.name not in ("_wl_x", "_wl_key")],
                               T.StructField("_wl_xs", T.ArrayType(T.DoubleType(), False))])
    runs = materialized(samples.mapInArrow(
        _runs_of_frames(frame_size, to_arrow_schema(run_schema)), run_schema), "frames")
    whole = runs.filter(F.size("_wl_xs") == frame_size).select(*series, "frame", "_wl_xs")
    pieces = runs.filter(F.size("_wl_xs") < frame_size)
    joined = (pieces.groupBy(*series, "frame")
              .agg(F.sort_array(F.collect_list(F.struct("_wl_pos", "_wl_xs"))).alias("_wl_s"))
              .select(*series, "frame",
                      F.flatten(F.transform("_wl_s", lambda s: s["_wl_xs"])).alias("_wl_xs")))
    frames = whole.unionByName(joined)
    carried = [*series, "frame"]
    out_schema = T.StructType([*[frames.schema[c] for c in carried],
                               T.StructField("bin", T.LongType()),
                               T.StructField("re", T.DoubleType()),
                               T.StructField("im", T.DoubleType())])
    bins = frames.mapInArrow(_rfft_frames(frame_size, carried), out_schema)
    re, im = F.col("re"), F.col("im")
    return bins.select(
        *series, "frame", "bin",
        (F.col("bin").cast("double") * F.lit(float(sample_rate))
         / F.lit(float(frame_size))).alias("frequency_hz"),
        re.alias("re"), im.alias("im"),
        F.sqrt(re * re + im * im).alias("magnitude"),
        F.atan2(im, re).alias("phase"))

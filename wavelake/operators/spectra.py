"""Spectra of series of any length and spacing (X1 beyond one frame).

* :func:`series_dft` — the transform of a whole series, however long, by the
  four-step scheme: the samples as a matrix of about sqrt(N) rows and columns,
  transforms along the columns, twiddle factors, transforms along the rows.
  Each step is one shuffle into groups of ``block_points`` numbers at most.
* :func:`frame_spectra`, :func:`averaged_spectrum` — overlapping windowed
  frames and their averaged power.  The series is cut into blocks that also
  hold the samples which their last frames need, so a sample is moved once,
  not once per frame; averages are sums per bin that merge.
* :func:`resample` — unevenly spaced samples on a uniform clock, with gaps
  found and marked.
* :func:`periodogram` — least-squares spectrum of unevenly spaced samples, from
  sums per frequency that tasks accumulate and merge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.functions.numeric import as_double
from wavelake.operators.dft import DEFAULT_SAMPLE_RATE_HZ
from wavelake.operators.ordering import contiguous_index
from wavelake.operators.scan import neighbours
from wavelake.session import ship_package

BLOCK_POINTS = 1 << 18
PIECE_POINTS = 1 << 16
WINDOWS = ("boxcar", "hann")


def _samples(df: DataFrame, value_col: str, order_by: Sequence[str | Column], series: list[str],
             count_col: str | None = None) -> DataFrame:
    """``series..., _wl_n, _wl_x`` (and the series' length) of the rows whose
    value parses as a double."""
    rows = df.withColumn("_wl_x", as_double(value_col)).filter(F.col("_wl_x").isNotNull())
    if all(isinstance(c, str) for c in order_by):
        rows = rows.select(*dict.fromkeys([*series, *order_by]), "_wl_x")
    return contiguous_index(rows, list(order_by), partition_by=series, index_col="_wl_n",
                            count_col=count_col, keep=["_wl_x"])


def _fields(df: DataFrame, names: Sequence[str], **added: T.DataType) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in names], *[T.StructField(c, t) for c, t in added.items()]])


def _repeated(table: pa.Table, names: Sequence[str], n: int) -> dict[str, pa.Array]:
    """Cells that are equal in all rows of a group, ``n`` times."""
    return {c: table.column(c).combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64))) for c in names}


# ------------------------------------------------------------- whole series

def _column_transforms(carried: list[str], block_bits: int):
    """Columns of the sample matrix transformed and turned by the twiddle
    factors, cut into tiles for the second step."""

    def fn(group: pa.Table) -> pa.Table:
        bits, cblock = group.column("_wl_bits")[0].as_py(), group.column("_wl_block")[0].as_py()
        b2 = bits // 2
        b1 = bits - b2
        cbits = min(b2, max(0, block_bits - b1))
        matrix = np.zeros((1 << b1, 1 << cbits))
        matrix[group.column("_wl_row").to_numpy(), group.column("_wl_col").to_numpy()] = group.column("_wl_x").to_numpy()
        out = np.fft.fft(matrix, axis=0)
        k1 = np.arange(1 << b1, dtype=np.int64)
        n2 = (cblock << cbits) + np.arange(1 << cbits, dtype=np.int64)
        turns = (k1[:, None] * n2[None, :]) % (1 << bits)
        out *= np.exp(-2j * np.pi * turns / (1 << bits))
        kbits = min(b1, max(0, block_bits - b2))
        tiles = [out[i:i + (1 << kbits)] for i in range(0, 1 << b1, 1 << kbits)]
        return pa.table(_repeated(group, carried, len(tiles)) | {
            "_wl_block": pa.array(np.arange(len(tiles), dtype=np.int64)),
            "_wl_tile": pa.array(np.full(len(tiles), cblock, dtype=np.int64)),
            "_wl_cells": pa.array([np.ascontiguousarray(t).tobytes() for t in tiles], pa.binary())})

    return fn


def _row_transforms(carried: list[str], block_bits: int):
    """Rows of the turned matrix put together from their tiles and
    transformed: bins ``k1 + N1 * k2`` up to half of all."""

    def fn(group: pa.Table) -> pa.Table:
        bits, block = group.column("_wl_bits")[0].as_py(), group.column("_wl_block")[0].as_py()
        b2 = bits // 2
        b1 = bits - b2
        kbits = min(b1, max(0, block_bits - b2))
        cbits = min(b2, max(0, block_bits - b1))
        matrix = np.zeros((1 << kbits, 1 << b2), dtype=np.complex128)
        for tile, cells in zip(group.column("_wl_tile").to_pylist(), group.column("_wl_cells").to_pylist()):
            part = np.frombuffer(cells, dtype=np.complex128).reshape(1 << kbits, -1)
            matrix[:, tile << cbits:(tile + 1) << cbits] = part
        out = np.fft.fft(matrix, axis=1)
        k1 = (block << kbits) + np.arange(1 << kbits, dtype=np.int64)
        bins = k1[:, None] + (np.arange(1 << b2, dtype=np.int64) << b1)[None, :]
        kept = bins <= (1 << bits) // 2
        bins, out = bins[kept], out[kept]
        edge = (bins == 0) | (2 * bins == 1 << bits)   # real by definition
        im = np.where(edge, 0.0, out.imag)
        return pa.table(_repeated(group, carried, len(bins)) | {
            "bin": pa.array(bins), "re": pa.array(out.real.copy()), "im": pa.array(im)})

    return fn


def series_dft(df: DataFrame, value_col: str, order_by: Sequence[str | Column],
               series: Sequence[str] = (), sample_rate: float = DEFAULT_SAMPLE_RATE_HZ,
               block_points: int = BLOCK_POINTS) -> DataFrame:
    """``series..., n_points, bin, frequency_hz, re, im`` of every whole series,
    padded with zeros to the next power of two ``n_points``; bins
    0..n_points/2.  Rows whose value does not parse are skipped."""
    if block_points < 1:
        raise ValueError("a block holds one number at least")
    ship_package(df.sparkSession)
    series, block_bits = list(series), block_points.bit_length() - 1
    indexed = _samples(df, value_col, order_by, series, count_col="_wl_total")
    bits = F.when(F.col("_wl_total") <= 1, 0).otherwise(F.length(F.bin(F.col("_wl_total") - 1)))
    rows = indexed.withColumn("_wl_bits", bits.cast("int"))
    b2 = F.expr("_wl_bits div 2").cast("int")
    cbits = F.least(b2, F.greatest(F.lit(0), F.lit(block_bits) - (F.col("_wl_bits") - b2)))
    n2 = F.expr("_wl_n & (shiftleft(1L, cast(_wl_bits div 2 as int)) - 1)")
    rows = rows.withColumn("_wl_b2", b2).withColumn("_wl_cbits", cbits.cast("int")).withColumn("_wl_n2", n2)
    rows = rows.select(*series, "_wl_bits", F.expr("shiftright(_wl_n2, _wl_cbits)").alias("_wl_block"),
                       F.expr("shiftright(_wl_n, _wl_b2)").alias("_wl_row"),
                       F.expr("_wl_n2 & (shiftleft(1L, _wl_cbits) - 1)").alias("_wl_col"), "_wl_x")
    carried = [*series, "_wl_bits"]
    tiles = rows.groupBy(*carried, "_wl_block").applyInArrow(
        _column_transforms(carried, block_bits),
        _fields(rows, carried, _wl_block=T.LongType(), _wl_tile=T.LongType(), _wl_cells=T.BinaryType()))
    bins = tiles.groupBy(*carried, "_wl_block").applyInArrow(
        _row_transforms(carried, block_bits),
        _fields(rows, carried, bin=T.LongType(), re=T.DoubleType(), im=T.DoubleType()))
    n_points = F.expr("shiftleft(1L, _wl_bits)")
    return bins.select(*series, n_points.alias("n_points"), "bin",
                       (F.col("bin").cast("double") * F.lit(float(sample_rate))
                        / n_points.cast("double")).alias("frequency_hz"), "re", "im")


# ------------------------------------------------------- overlapping frames

def window_weights(name: str, size: int) -> np.ndarray:
    if name not in WINDOWS:
        raise ValueError(f"window is one of {WINDOWS}")
    if name == "boxcar":
        return np.ones(size)
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def _block_frames(group: pa.Table, frame_size: int, hop: int, block: int, weights: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """First sample and spectrum of the whole frames that begin in a block."""
    n = group.column("_wl_n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, x = n[order], group.column("_wl_x").to_numpy()[order]
    start = group.column("_wl_block")[0].as_py() * block
    # samples are consecutive; those from the block's start on are here
    lead = int(n[0] - start) if len(n) else 0
    firsts = np.arange(-(-start // hop) * hop, min(start + block, int(n[-1]) + 2 - frame_size), hop)
    if lead or not len(firsts):
        return np.empty(0, dtype=np.int64), np.empty((0, frame_size // 2 + 1), dtype=complex)
    frames = np.lib.stride_tricks.sliding_window_view(x, frame_size)[firsts - start]
    return firsts, np.fft.rfft(frames * weights, axis=1)


def _in_blocks(df: DataFrame, value_col: str, order_by, series: list[str], frame_size: int, hop: int,
               block_points: int) -> tuple[DataFrame, int]:
    """Indexed samples dealt into blocks, with copies of the samples that the
    previous block's frames reach."""
    if frame_size < 2 or hop < 1:
        raise ValueError("frames have two samples and a hop of one at least")
    block = hop * max(1, max(block_points, frame_size) // hop)
    block = max(block, hop * -(-frame_size // hop))
    indexed = _samples(df, value_col, order_by, series)
    own = F.expr(f"_wl_n div {block}")
    reach = F.expr(f"_wl_n % {block}") < frame_size - 1
    blocks = F.when(reach & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return indexed.select(*series, "_wl_n", "_wl_x", F.explode(blocks).alias("_wl_block")), block


def frame_spectra(df: DataFrame, value_col: str, order_by: Sequence[str | Column],
                  series: Sequence[str] = (), frame_size: int = 256, hop: int = 128,
                  window: str = "hann", sample_rate: float = DEFAULT_SAMPLE_RATE_HZ,
                  block_points: int = BLOCK_POINTS) -> DataFrame:
    """``series..., frame, bin, frequency_hz, re, im`` of every whole frame of
    ``frame_size`` samples; frame f begins at sample ``f * hop``."""
    ship_package(df.sparkSession)
    series, weights = list(series), window_weights(window, frame_size)
    rows, block = _in_blocks(df, value_col, order_by, series, frame_size, hop, block_points)

    def fn(group: pa.Table) -> pa.Table:
        firsts, spectra = _block_frames(group, frame_size, hop, block, weights)
        n_bins = spectra.shape[1]
        return pa.table(_repeated(group, series, spectra.size) | {
            "frame": pa.array(np.repeat(firsts // hop, n_bins)),
            "bin": pa.array(np.tile(np.arange(n_bins, dtype=np.int64), len(firsts))),
            "re": pa.array(spectra.real.ravel()), "im": pa.array(spectra.imag.ravel())})

    bins = rows.groupBy(*series, "_wl_block").applyInArrow(fn, _fields(
        rows, series, frame=T.LongType(), bin=T.LongType(), re=T.DoubleType(), im=T.DoubleType()))
    return bins.select(*series, "frame", "bin", (F.col("bin").cast("double") * F.lit(float(sample_rate))
                                                 / F.lit(float(frame_size))).alias("frequency_hz"), "re", "im")


def averaged_spectrum(df: DataFrame, value_col: str, order_by: Sequence[str | Column],
                      series: Sequence[str] = (), frame_size: int = 256, hop: int = 128,
                      window: str = "hann", sample_rate: float = DEFAULT_SAMPLE_RATE_HZ,
                      block_points: int = BLOCK_POINTS) -> DataFrame:
    """``series..., bin, frequency_hz, frames, power``: the mean one-sided power
    density per bin over all whole frames (Welch's method, no detrending).
    Blocks pass on one row per bin."""
    ship_package(df.sparkSession)
    series, weights = list(series), window_weights(window, frame_size)
    rows, block = _in_blocks(df, value_col, order_by, series, frame_size, hop, block_points)
    sides = np.full(frame_size // 2 + 1, 2.0)
    sides[0] = 1.0
    if frame_size % 2 == 0:
        sides[-1] = 1.0
    scale = sides / (sample_rate * float((weights ** 2).sum()))

    def fn(group: pa.Table) -> pa.Table:
        firsts, spectra = _block_frames(group, frame_size, hop, block, weights)
        power = (spectra.real ** 2 + spectra.imag ** 2).sum(axis=0) * scale
        n = len(power) if len(firsts) else 0
        return pa.table(_repeated(group, series, n) | {
            "bin": pa.array(np.arange(n, dtype=np.int64)),
            "_wl_frames": pa.array(np.full(n, len(firsts), dtype=np.int64)), "_wl_power": pa.array(power[:n])})

    sums = rows.groupBy(*series, "_wl_block").applyInArrow(fn, _fields(
        rows, series, bin=T.LongType(), _wl_frames=T.LongType(), _wl_power=T.DoubleType()))
    merged = sums.groupBy(*series, "bin").agg(F.sum("_wl_frames").alias("frames"), F.sum("_wl_power").alias("_wl_power"))
    return merged.select(*series, "bin", (F.col("bin").cast("double") * F.lit(float(sample_rate))
                                          / F.lit(float(frame_size))).alias("frequency_hz"),
                         "frames", (F.col("_wl_power") / F.col("frames")).alias("power"))


# ------------------------------------------------------------ uniform clock

def resample(df: DataFrame, time_col: str, value_col: str, step: int, max_gap: int | None = None,
             series: Sequence[str] = (), order_ties: Sequence[str] = (),
             piece_points: int = PIECE_POINTS) -> DataFrame:
    """``series..., tick, time, value, in_gap``: the samples on a clock that
    ticks every ``step`` units of the integer column ``time_col`` (time = tick *
    step), from a series' first to its last sample.

    A tick's value lies on the line between the samples before and after it.
    Where these are more than ``max_gap`` apart the tick is ``in_gap`` and has
    no value.  Of samples at one time the last in the order of ``order_ties``
    begins the line that follows, the first ends the one before.  Rows with a
    null time or a value that does not parse are skipped.

    Each sample makes the ticks up to the next one, which it gets as a
    neighbour; long stretches are dealt over tasks in pieces."""
    if step < 1:
        raise ValueError("a clock's step is one unit at least")
    series = list(series)
    rows = (df.withColumn("_wl_x", as_double(value_col)).withColumn("_wl_t", F.col(time_col).cast("long"))
            .filter("_wl_x IS NOT NULL AND _wl_t IS NOT NULL")
            .select(*series, "_wl_t", "_wl_x", *[F.col(c).alias(f"_wl_tie{i}") for i, c in enumerate(order_ties)]))
    ties = [f"_wl_tie{i}" for i in range(len(order_ties))]
    rows = neighbours(rows, ["_wl_t", *ties], {"_wl_t1": ("_wl_t", 1), "_wl_x1": ("_wl_x", 1)}, series=series)

    def tick_from(t: str) -> Column:   # the first tick at or after a time
        return F.expr(f"({t} div {step}) + CASE WHEN {t} % {step} > 0 THEN 1 ELSE 0 END")

    ended = F.expr(f"(_wl_t div {step}) - CASE WHEN _wl_t % {step} < 0 THEN 1 ELSE 0 END")
    last = F.when(F.col("_wl_t1").isNull(), ended).otherwise(tick_from("_wl_t1") - 1)
    spans = (rows.withColumn("_wl_first", tick_from("_wl_t")).withColumn("_wl_last", last).filter("_wl_first <= _wl_last")
             .withColumn("_wl_pieces", F.expr(f"(_wl_last - _wl_first) div {piece_points} + 1")))
    long = (spans.filter("_wl_pieces > 1").withColumn("_wl_piece", F.explode(F.expr("sequence(0L, _wl_pieces - 1)")))
            .repartition("_wl_t", "_wl_piece")
            .withColumn("_wl_first", F.col("_wl_first") + F.col("_wl_piece") * piece_points)
            .withColumn("_wl_last", F.least("_wl_last", F.col("_wl_first") + (piece_points - 1))).drop("_wl_piece"))
    ticks = spans.filter("_wl_pieces = 1").unionByName(long).withColumn("tick", F.explode(F.sequence("_wl_first", "_wl_last")))
    time = F.col("tick") * step
    apart = F.col("_wl_t1") - F.col("_wl_t")
    share = (time - F.col("_wl_t")).cast("double") / apart.cast("double")
    line = F.col("_wl_x") + (F.col("_wl_x1") - F.col("_wl_x")) * share
    gap = F.lit(False) if max_gap is None else F.coalesce((apart > max_gap) & (time > F.col("_wl_t")), F.lit(False))
    value = F.when(time == F.col("_wl_t"), F.col("_wl_x")).otherwise(line)
    return ticks.select(*series, "tick", time.alias("time"), F.when(~gap, value).alias("value"), gap.alias("in_gap"))


# -------------------------------------------------------- uneven spacing

_SUMS = ("n", "y", "yy", "c", "s", "yc", "ys", "cc", "cs")   # columns _wl_<name>
_TASK_SERIES = 256     # series whose sums a task holds before it passes them on
_SLICE_CELLS = 1 << 20


def periodogram(df: DataFrame, time: Column, value_col: str, frequencies: Sequence[float],
                series: Sequence[str] = ()) -> DataFrame:
    """``series..., frequency, samples, power``: the share of the variance that
    a sinusoid of that frequency with a free mean explains, by least squares,
    of samples at any times (``time``: a double column, in the unit whose
    inverse the frequencies are).

    A task adds up its samples' products per frequency; the sums merge, and
    the normal equations are solved from them.  ``frequencies`` is a list of
    bounded length; the samples are read once, in any order."""
    ship_package(df.sparkSession)
    series, freqs = list(series), np.asarray(list(frequencies), dtype=np.float64)
    rows = (df.select(*series, time.cast("double").alias("_wl_t"), as_double(value_col).alias("_wl_x"))
            .filter("_wl_t IS NOT NULL AND _wl_x IS NOT NULL"))
    slice_rows = max(1, _SLICE_CELLS // max(1, len(freqs)))

    def sums_of(t: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros((len(_SUMS), len(freqs)))
        for i in range(0, len(t), slice_rows):
            a, b = t[i:i + slice_rows], y[i:i + slice_rows, None]
            turns = np.modf(a[:, None] * freqs[None, :])[0] * (2 * np.pi)
            c, s = np.cos(turns), np.sin(turns)
            total += [np.full(len(freqs), len(a)), np.full(len(freqs), b.sum()),
                      np.full(len(freqs), (b * b).sum()), c.sum(0), s.sum(0), (b * c).sum(0), (b * s).sum(0),
                      (c * c).sum(0), (c * s).sum(0)]
        return total

    fields = _fields(rows, series, _wl_k=T.IntegerType(), **{f"_wl_{c}": T.DoubleType() for c in _SUMS})

    def emitted(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = {c: [] for c in series}
        for key in held:
            for c, cell in zip(series, key):
                columns[c] += [cell] * len(freqs)
        stacked = np.concatenate(list(held.values()), axis=1)
        arrays = [pa.array(columns[c], kinds[c]) for c in series]
        arrays += [pa.array(np.tile(np.arange(len(freqs), dtype=np.int32), len(held)))]
        arrays += [pa.array(stacked[i]) for i in range(len(_SUMS))]
        return pa.RecordBatch.from_arrays(arrays, names=[*series, "_wl_k", *[f"_wl_{c}" for c in _SUMS]])

    kinds: dict[str, pa.DataType] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            kinds.update({c: batch.schema.field(c).type for c in series})
            t, y = batch.column("_wl_t").to_numpy(), batch.column("_wl_x").to_numpy()
            groups: dict[tuple, list[int]] = {}
            cells = list(zip(*[batch.column(c).to_pylist() for c in series])) or [()] * batch.num_rows
            for i, key in enumerate(cells):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                held[key] = held.get(key, 0.0) + sums_of(t[at], y[at])
                if len(held) >= _TASK_SERIES:
                    yield emitted(held)
                    held = {}
        if held:
            yield emitted(held)

    merged = rows.mapInArrow(run, fields).groupBy(*series, "_wl_k").agg(*[
        F.sum(f"_wl_{c}").alias(f"_wl_{c}") for c in _SUMS])
    m = {c: F.col(f"_wl_{c}") / F.col("_wl_n") for c in _SUMS[1:]}
    yy, yc, ys = (m["yy"] - m["y"] * m["y"], m["yc"] - m["y"] * m["c"], m["ys"] - m["y"] * m["s"])
    cc, cs = m["cc"] - m["c"] * m["c"], m["cs"] - m["c"] * m["s"]
    ss = F.lit(1.0) - m["cc"] - m["s"] * m["s"]
    scale = yy * (cc * ss - cs * cs)
    power = F.when(scale > 0, (ss * yc * yc + cc * ys * ys - cs * yc * ys * 2.0) / scale)
    steps = F.array(*[F.lit(float(f)) for f in freqs])
    return merged.select(*series, F.get(steps, F.col("_wl_k")).alias("frequency"),
                         F.col("_wl_n").cast("long").alias("samples"), power.alias("power"))

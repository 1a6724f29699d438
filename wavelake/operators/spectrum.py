"""T6–T12 — the compatible ("index-based") spectrum table.

The reference labels this an FFT but computes, per surviving sample:
``frequency_hz = sample_index * rate / N``, ``magnitude = |amplitude|`` and
``phase = 0``.  This module keeps that exact contract; the real transform is
:mod:`wavelake.operators.dft` (X1).

Deliberate divergence: the sample order is an explicit key (the reference
relied on the arrival order of a one-partition JDBC read).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.functions.numeric import as_double
from wavelake.operators.ordering import contiguous_index

# Fixed values of the compatible spectrum contract.
DEFAULT_SAMPLE_RATE_HZ = 1000.0
SPECTRUM_COLUMNS = ("result_id", "sample_index", "frequency_hz", "magnitude",
                    "phase", "created_time")


def require_columns(df: DataFrame, *names: str) -> None:
    """T12 — fail before any work when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")


def numeric_samples(df: DataFrame, amplitude_col: str = "amplitude",
                    out_col: str = "amplitude_double") -> DataFrame:
    """T6 — coerce the amplitude to double and keep rows where it parsed."""
    require_columns(df, amplitude_col)
    return (df.withColumn(out_col, as_double(amplitude_col))
            .filter(F.col(out_col).isNotNull()))


def spectrum(df: DataFrame, result_id: str | Column,
             order_by: Sequence[str | Column] | None,
             series: Sequence[str] = (),
             amplitude_col: str = "amplitude",
             sample_rate: float = DEFAULT_SAMPLE_RATE_HZ,
             with_created_time: bool = True) -> DataFrame:
    """T6–T11: one spectrum row per surviving sample.

    ``series`` restarts the index and N per group (bulk form); ``result_id``
    may be a column built from the series keys.  Output columns are
    ``series... , result_id, sample_index, frequency_hz, magnitude, phase``
    and ``created_time`` unless ``with_created_time`` is false.
    """
    require_columns(df, amplitude_col, *series)
    order_cols = list(order_by) if order_by is not None else None
    needed = [*series, *[c for c in (order_cols or []) if isinstance(c, str)]]
    samples = numeric_samples(df, amplitude_col, "_wl_amp")
    if all(isinstance(c, str) for c in (order_cols or [])):
        samples = samples.select(*dict.fromkeys(needed), "_wl_amp")
    indexed = contiguous_index(samples, order_cols, partition_by=series,
                               index_col="sample_index", count_col="_wl_n",
                               keep=["_wl_amp"])
    rid = F.lit(result_id) if isinstance(result_id, str) else result_id
    cols = [*[F.col(s) for s in series],
            rid.cast("string").alias("result_id"),
            F.col("sample_index"),
            (F.col("sample_index").cast("double") * F.lit(float(sample_rate))
             / F.col("_wl_n").cast("double")).alias("frequency_hz"),
            F.abs(F.col("_wl_amp")).alias("magnitude"),
            F.lit(0.0).alias("phase")]
    if with_created_time:
        cols.append(F.current_timestamp().alias("created_time"))
    return indexed.select(*cols)

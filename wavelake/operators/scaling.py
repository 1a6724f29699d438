"""M1, M4, M6 — min-max scaling as plain DataFrame code.

The bounds come from one global aggregate (partial per task, one tiny final
merge) used as a scalar subquery: no collect to the driver, no join, one lazy
plan.  For the ``pyspark.ml`` estimator/model see :mod:`wavelake.ml.minmax`.

Semantics (the reference's): ``(x - min) / (max - min)``; when max == min
every row — null ones included — gets 0.5; otherwise null stays null.  With a
NaN in the column Spark's ``max`` is NaN, so every scaled value is NaN.
Empty or all-null input gives null scaled values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: scaled value of a constant column.
CONSTANT_SCALED = 0.5


def require_numeric(df: DataFrame, input_col: str) -> None:
    """M4 — the input column must exist and be numeric."""
    if input_col not in df.columns:
        raise ValueError(f"no column {input_col!r} in the input")
    dtype = df.schema[input_col].dataType
    if not isinstance(dtype, T.NumericType):
        raise ValueError(f"Input column {input_col} must be numeric, not {dtype.simpleString()}")


def scale_expr(x: Column, lo: Column, hi: Column) -> Column:
    rng = hi - lo
    return F.when(rng == 0, F.lit(CONSTANT_SCALED)).otherwise((x - lo) / rng)


def minmax_bounds(df: DataFrame, input_col: str) -> DataFrame:
    """A3 — fused global min and max in one pass (one row)."""
    x = F.col(input_col).cast("double")
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"))


def minmax_scale(df: DataFrame, input_col: str, output_col: str = "scaled") -> DataFrame:
    """M1 — add ``output_col`` scaled to [0, 1]; other columns are kept."""
    require_numeric(df, input_col)
    x = F.col(input_col).cast("double")
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    # Bind the subquery once as a column so it is planned (and run) once.
    with_bounds = df.withColumn("_wl_bounds", bounds)
    b = F.col("_wl_bounds")
    return (with_bounds.withColumn(output_col, scale_expr(x, b.getField("lo"), b.getField("hi")))
            .drop("_wl_bounds"))


def minmax_scale_narrow(df: DataFrame, input_col: str) -> DataFrame:
    """M6 — M1 narrowed to ``[input_col, "scaled"]``, both double and never
    null: a null input fails the job, as in the reference."""
    scaled = minmax_scale(df, input_col, "scaled")
    x = F.col(input_col).cast("double")
    checked = F.when(x.isNull(), F.raise_error(
        F.lit(f"null value in column {input_col}"))).otherwise(x)
    return scaled.select(checked.cast("double").alias(input_col), F.col("scaled"))

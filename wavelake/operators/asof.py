"""As-of join: for each row, the last earlier row of another series.

Both sides are stacked into one table and sorted once by (keys..., time), rows
of the right side before those of the left at equal times.  The last known
right row is then carried down the order by the segmented scan of
:mod:`wavelake.operators.scan`: within a task by position, over task borders
by one row per (task, key).  Every row is moved once; there is no join on a
range predicate, no key whose rows meet in one task, and a key that holds most
rows, or no key at all, spans as many tasks as the sort has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.operators.scan import LAST, running

_DIRECTIONS = ("backward", "forward")


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None,
              by: Sequence[str] = (), direction: str = "backward", allow_equal: bool = True,
              tolerance: Column | None = None, order_ties: Sequence[str] = (), how: str = "left",
              prefix: str = "right_", num_partitions: int | None = None) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` (named with
    ``prefix``) whose ``by`` cells are equal and whose time is not after
    (``direction="forward"``: not before) the row's own.

    ``allow_equal=False`` asks for a strictly earlier time.  Of right rows at
    one time the last in the order of ``order_ties`` (columns of ``right``)
    counts.  ``tolerance`` is a condition on the result's columns that a match
    must meet, such as ``F.col("ts") - F.col("right_ts") < 60``; where it does
    not hold there is no match.  ``how="inner"`` leaves out rows without one.

    A null time, or a null among the ``by`` cells, matches nothing; such left
    rows stay (with nulls) unless ``how`` is ``inner``."""
    if direction not in _DIRECTIONS or how not in ("left", "inner"):
        raise ValueError(f"direction is one of {_DIRECTIONS}, how left or inner")
    by, time = list(by), right_on or on
    names = {c: f"{prefix}{c}" for c in right.columns}
    clash = set(names.values()) & set(left.columns)
    if clash:
        raise ValueError(f"column(s) {sorted(clash)} occur on both sides; choose another prefix")
    usable = F.col(f"`{time}`").isNotNull()
    for c in by:
        usable = usable & F.col(f"`{c}`").isNotNull()

    # one layout: key cells, time, side, order among ties, either row as a struct
    def laid_out(df: DataFrame, at: str, side: int, own: Column, other: Column, ties: Column) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)],
                         F.col(f"`{at}`").alias("_at"), F.lit(side).alias("_side"), ties.alias("_ties"),
                         *([own.alias("_left"), other.alias("_right")] if side == left_side
                           else [other.alias("_left"), own.alias("_right")]))

    # right rows come first at equal times, or last if equal times do not count
    left_side, right_side = (1, 0) if allow_equal else (0, 1)
    left_row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)])
    right_row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(right.columns)])
    tie_row = F.struct(*[F.col(f"`{c}`") for c in order_ties], F.lit(0).alias("_end"))
    left_type = left.select(left_row.alias("r")).schema["r"].dataType
    right_type = right.select(right_row.alias("r")).schema["r"].dataType
    tie_type = right.select(tie_row.alias("r")).schema["r"].dataType
    stacked = laid_out(left, on, left_side, left_row, F.lit(None).cast(right_type),
                       F.lit(None).cast(tie_type)).unionByName(
        laid_out(right.filter(usable), time, right_side, right_row, F.lit(None).cast(left_type), tie_row))
    keys = [f"_by{i}" for i in range(len(by))]
    order = F.col("_at") if direction == "backward" else F.col("_at").desc()
    carried = running(stacked, [order, "_side", "_ties"], {"_match": (LAST, F.col("_right"))},
                      series=keys, num_partitions=num_partitions)
    known = F.col("_at").isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    out = carried.filter(F.col("_left").isNotNull()).select(
        *[F.col(f"_left.c{i}").alias(c) for i, c in enumerate(left.columns)],
        F.when(known, F.col("_match")).alias("_match"))
    columns = [F.col(f"_match.c{i}").alias(names[c]) for i, c in enumerate(right.columns)]
    if tolerance is not None:
        near = out.select(*[F.col(f"`{c}`") for c in left.columns], "_match", *columns)
        out = near.select(*[F.col(f"`{c}`") for c in left.columns],
                          F.when(tolerance, F.col("_match")).alias("_match"))
    if how == "inner":
        out = out.filter(F.col("_match").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *columns)

"""Numeric coercion columns (T6) — safe under ANSI mode.

Spark 4 runs with ANSI casts on; a plain ``cast`` of ``'abc'`` raises.  The
reference (Spark 3.5, lenient casts) turned bad cells into nulls, so every
coercion here is a ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col: str | Column) -> Column:
    """Cell -> double; unparseable cells become null, ``'NaN'`` stays NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return c.try_cast("double")


def as_long_strict(col: str | Column) -> Column:
    """Cell -> long, accepting only an optional sign and digits.

    Matches ``Long.parseLong``: inner or surrounding spaces and ``1.5`` are
    rejected (null), which ``try_cast`` alone would accept or truncate.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = c.cast("string")
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("long"))


def as_double_strict(col: str | Column) -> Column:
    """Cell -> double following ``Double.parseDouble``: surrounding blanks
    (chars <= U+0020) are allowed, inner spaces are not."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.btrim(c.cast("string"), F.lit("".join(map(chr, range(0x21)))))
    return F.when(~s.rlike(r"[\x00-\x20]"), s.try_cast("double"))

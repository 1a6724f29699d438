"""T1, T2, T3, T5 — stateless cleaning, written as ``DataFrame -> DataFrame``
column logic so a streaming frame passes through unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.functions.numeric import as_double_strict, as_long_strict
from wavelake.functions.text import (DEFAULT_FIELDS, FIELD_SEPARATOR,
                                     HEADER_LINE_PATTERN, LOG_LINE_PATTERN,
                                     cast_lenient, split_field)

Fields = Sequence[tuple[str, str]]


def drop_all_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """T1 — drop rows whose every column (of ``subset``) is null.  Partial
    nulls survive and whitespace-only cells count as values."""
    return df.na.drop(how="all", subset=list(subset) if subset else None)


def drop_noise_lines(df: DataFrame, col: str = "value",
                     patterns: Sequence[str] = (LOG_LINE_PATTERN, HEADER_LINE_PATTERN)
                     ) -> DataFrame:
    """T2 — drop lines matching any pattern (no trim: an indented log line
    is kept)."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(col).rlike(p)
    return df.filter(~hit)


def parse_fields(df: DataFrame, col: str = "value", fields: Fields = DEFAULT_FIELDS,
                 sep: str = FIELD_SEPARATOR, keep: Sequence[str] = ()) -> DataFrame:
    """T3 — split each line and cast items 0..k-1; bad or missing cells become
    null and the row is kept (a blank line gives all nulls)."""
    return df.select(*keep, *[cast_lenient(split_field(col, i, sep), t).alias(name)
                              for i, (name, t) in enumerate(fields)])


def parse_fields_strict(df: DataFrame, col: str = "value",
                        fields: Fields = DEFAULT_FIELDS, sep: str = FIELD_SEPARATOR,
                        keep: Sequence[str] = ()) -> DataFrame:
    """T5 — like T3 but a line whose first k items do not all parse is
    dropped; extra items are ignored.  Integral items follow
    ``Long.parseLong`` (digits only), fractional ones ``Double.parseDouble``."""
    cols = []
    for i, (name, t) in enumerate(fields):
        item = split_field(col, i, sep)
        if t in ("long", "bigint", "int", "integer"):
            cols.append(as_long_strict(item).cast(t).alias(name))
        else:
            cols.append(as_double_strict(item).cast(t).alias(name))
    parsed = df.select(*keep, *cols)
    # isNotNull, not na.drop: a parsed NaN is a value (na.drop would drop it)
    ok = F.lit(True)
    for name, _ in fields:
        ok = ok & F.col(name).isNotNull()
    return parsed.filter(ok)


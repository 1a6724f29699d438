"""String columns for cleaning interleaved log / measurement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line classes of the log/measurement text format.
LOG_LINE_PATTERN = r"^\[.*"          # a log line starts with '['
HEADER_LINE_PATTERN = r"^timestamp.*"  # a header line starts with 'timestamp'
LOG_PREFIX = "["
HEADER_PREFIX = "timestamp"
FIELD_SEPARATOR = ","
DEFAULT_FIELDS = (("timestamp", "long"), ("sensor_A", "double"), ("sensor_B", "double"))

# Marker values of the block state machine.
CLOSE_BLOCK = 0
OPEN_BLOCK = 1

# Characters up to U+0020, all of which ``String.trim`` strips.
BLANKS = "".join(map(chr, range(0x21)))


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def java_trim(col: str | Column) -> Column:
    """Strip leading/trailing chars <= U+0020 (``String.trim`` semantics;
    ``F.trim`` strips only spaces)."""
    return F.btrim(_c(col), F.lit(BLANKS))


def is_blank(col: str | Column) -> Column:
    """True for null or text made only of chars <= U+0020."""
    c = _c(col).cast("string")
    return c.isNull() | ~c.rlike(rf"[^\x00-\x20]")


def block_marker(col: str | Column) -> Column:
    """CLOSE_BLOCK for log lines, OPEN_BLOCK for header lines, else null.

    Classified after trimming, so an indented log line still closes a block.
    """
    t = java_trim(col)
    return (F.when(t.startswith(LOG_PREFIX), F.lit(CLOSE_BLOCK))
            .when(t.startswith(HEADER_PREFIX), F.lit(OPEN_BLOCK)))


def split_field(col: str | Column, index: int, sep: str = FIELD_SEPARATOR) -> Column:
    """Item ``index`` of the text split at the literal ``sep``, null when the
    line is shorter (``getItem`` would raise under ANSI mode)."""
    literal = r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E"
    return F.get(F.split(_c(col), literal), index)


def cast_lenient(text: Column, type_name: str) -> Column:
    """Cast a text cell like a non-ANSI Spark 3.5 cast: bad cells -> null.

    Integral targets accept a decimal fraction and truncate it (``'1.5'`` ->
    1), as the lenient cast did; everything else is ``try_cast``.
    """
    if type_name in ("long", "bigint", "int", "integer", "short", "byte"):
        trimmed = java_trim(text)
        whole = F.regexp_extract(trimmed, r"^([+-]?[0-9]+)\.[0-9]*$", 1)
        return (F.when(whole != "", whole)
                .otherwise(trimmed).try_cast(type_name))
    return text.try_cast(type_name)

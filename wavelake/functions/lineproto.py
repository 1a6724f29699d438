"""T13 — time-series line-protocol text as a column expression.

Compatible form (the reference's): ``<measurement> <c1>="v1",<c2>="v2" <ns>``
— every field a quoted string, only ``"`` escaped, null and blank fields
(only chars <= U+0020) skipped, no tags.  A row with no field left renders
null (the reference emitted an invalid line for it); sinks drop nulls.

Full form (``compat=False``): escaped measurement, tag and field keys, tags,
numeric fields unquoted (integers with an ``i`` suffix), ``\\`` and ``"``
escaped in string values.

The timestamp comes from a column (ns since epoch).  Without one, rows count
nanoseconds on from the wall clock (ms x 10^6) of the query: points of one
measurement with the same time would overwrite each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.functions.text import is_blank
from wavelake.functions.time import epoch_micros


def measurement_name(table: str, database: str | None = None) -> str:
    """Table name minus every ``<database>.``, then ``.`` -> ``_``."""
    name = table.replace(f"{database}.", "") if database else table
    return name.replace(".", "_")


def _escape_key(text: str) -> str:
    return text.replace("\\", "\\\\").replace(",", "\\,").replace("=", "\\=").replace(" ", "\\ ")


def _escape_str(col: Column, backslash: bool) -> Column:
    if backslash:
        col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    return F.replace(col, F.lit('"'), F.lit('\\"'))


def epoch_nanos(df: DataFrame, col: str) -> Column:
    """Timestamp (or timestamp_ntz read as UTC) -> ns since epoch."""
    return epoch_micros(df, col) * F.lit(1000)


def row_clock_nanos() -> Column:
    """A nanosecond of each row's own: the query's clock, which is fixed when
    it is planned, plus the row's number in its task and the task's in the
    upper bits.  A retried task gives its rows the same ones again."""
    return F.unix_millis(F.current_timestamp()) * F.lit(1_000_000) + F.monotonically_increasing_id()


def _field(df: DataFrame, name: str, compat: bool) -> Column:
    c = F.col(name)
    dtype = df.schema[name].dataType
    key = name if compat else _escape_key(name)
    if not compat and isinstance(dtype, T.IntegralType):
        return F.when(c.isNotNull(), F.concat(F.lit(key + "="), c.cast("string"), F.lit("i")))
    if not compat and isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        finite = c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
        return F.when(finite, F.concat(F.lit(key + "="), c.cast("string")))
    if not compat and isinstance(dtype, T.BooleanType):
        return F.when(c.isNotNull(), F.concat(F.lit(key + "="), c.cast("string")))
    text = c.cast("string")
    return F.when(~is_blank(text),
                  F.concat(F.lit(key + '="'), _escape_str(text, not compat), F.lit('"')))


def _field_set(df: DataFrame, fields: Sequence[str], compat: bool) -> Column:
    return F.concat_ws(",", *[_field(df, f, compat) for f in fields])


def line_protocol(df: DataFrame, measurement: str, fields: Sequence[str] | None = None,
                  time_col: str | None = None, tags: Sequence[str] = (),
                  compat: bool = True) -> Column:
    """The line for each row of ``df`` (null when no field is left).

    For whole tables prefer :func:`with_line_protocol`, which evaluates the
    field set once per row."""
    head, field_set, ts = _parts(df, measurement, fields, time_col, tags, compat)
    line = F.concat(head, F.lit(" "), field_set, F.lit(" "), ts.cast("string"))
    return F.when(field_set != "", line)


def with_line_protocol(df: DataFrame, measurement: str, fields: Sequence[str] | None = None,
                       time_col: str | None = None, tags: Sequence[str] = (),
                       compat: bool = True, out_col: str = "line") -> DataFrame:
    """``df`` reduced to rendered lines (rows without any field dropped).

    The field set is a column of its own, so the optimizer keeps it in one
    evaluation instead of inlining it into both the filter and the line."""
    head, field_set, ts = _parts(df, measurement, fields, time_col, tags, compat)
    staged = df.select(head.alias("_wl_head"), field_set.alias("_wl_fields"),
                       ts.cast("string").alias("_wl_ts"))
    return (staged.filter(F.col("_wl_fields") != "")
            .select(F.concat_ws(" ", "_wl_head", "_wl_fields", "_wl_ts").alias(out_col)))


def _parts(df: DataFrame, measurement: str, fields: Sequence[str] | None,
           time_col: str | None, tags: Sequence[str], compat: bool):
    if compat and tags:
        raise ValueError("tags need compat=False (the compatible form has none)")
    if fields is None:
        skip = {time_col, *tags}
        fields = [c for c in df.columns if c not in skip]
    field_set = _field_set(df, fields, compat)
    head = F.lit(measurement if compat else
                 measurement.replace(",", "\\,").replace(" ", "\\ "))
    for t in tags:
        v = F.col(t).cast("string")
        tag = F.concat(F.lit("," + _escape_key(t) + "="),
                       F.regexp_replace(v, r"([,= \\])", r"\\$1"))
        head = F.concat(head, F.when(~is_blank(v), tag).otherwise(F.lit("")))
    ts = epoch_nanos(df, time_col) if time_col else row_clock_nanos()
    return head, field_set, ts

"""Date parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.cleaning import bind_once

# Patterns tried, in order, when a date column arrives as text and no single
# format is given.  Month/day may have one or two digits.
DEFAULT_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d",
)


def format_shape(fmt: str) -> str | None:
    """LIKE pattern of the literals of a date format in their order, lower-case: text that lacks it cannot parse.

    None where a format has optional or padded parts.
    """
    if any(c in fmt for c in "[]{}#") or "p" in fmt or "''" in fmt:
        return None
    out, quoted, last = "%", False, "%"
    for c in fmt:
        if c == "'":
            quoted = not quoted
            continue
        last = c.lower() if quoted or not c.isalpha() else "%"
        if last != "%" or out[-1] != "%":
            out += "\\" + last if last in "_\\" else last
    return out if out[-1] == "%" else out + "%"


def _try_format(s: Column, fmt: str) -> Column:
    """A failed parse is an exception, many times dearer than a parse: formats that cannot fit are not tried."""
    parsed, shape = F.try_to_timestamp(s, F.lit(fmt)), format_shape(fmt)
    if shape is None:
        return parsed
    return F.when((F.lower(s) if any(c.isalpha() for c in shape) else s).like(shape), parsed)


def parse_timestamp(col: Column | str, fmt: str | None = "M/d/yyyy",
                    dtype: T.DataType | None = None) -> Column:
    """Text -> timestamp with one format; unparseable -> NULL.

    Date/timestamp columns (``dtype``) pass through unchanged.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if fmt is None:
        return parse_any_timestamp(c, dtype=dtype)
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt))


def parse_any_timestamp(col: Column | str, formats=DEFAULT_DATE_FORMATS,
                        dtype: T.DataType | None = None) -> Column:
    """Text -> timestamp trying several formats; unparseable -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    return bind_once(F.trim(c.cast("string")), lambda s: F.coalesce(*[_try_format(s, f) for f in formats]))


def parse_day(col: Column | str, formats=DEFAULT_DATE_FORMATS, dtype: T.DataType | None = None) -> Column:
    """Parse with any known format and truncate to the calendar day (``date``)."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return F.to_date(parse_any_timestamp(c, formats))


def date_label(col: Column | str) -> Column:
    """``YYYY-MM-DD`` text label."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd")

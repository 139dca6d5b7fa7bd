"""Measurement cleaning expressions (JVM-side, no Python UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number as a plain decimal/scientific literal, an infinity or NaN word.
# Digit groups may be joined by single underscores ("1_000").  Anything else
# (for instance "5d", which the JVM parser would accept) is not a number.
_DIGITS = r"\d(_?\d)*"
_NUMBER = (r"^[+-]?(((" + _DIGITS + r")?\." + _DIGITS + r"|" + _DIGITS + r"\.?)(e[+-]?" + _DIGITS
           + r")?|inf|infinity|nan)$")
_WS = " \t\n\x0b\f\r"


def nan_to_null(col: Column) -> Column:
    """NaN -> NULL.  Spark has both; we keep only NULL (``NaN >= x`` is true in Spark)."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))  # names the column once: nested uses do not multiply


def bind_once(col: Column, f: Callable[[Column], Column]) -> Column:
    """``f(col)`` with ``col`` worked out once a row, however often ``f`` names it; keeps generated code small enough to be compiled."""
    return F.transform(F.array(col), f)[0]


def _strip(col: Column) -> Column:
    return F.trim(col, F.lit(_WS))


def _number(text: Column, strict: bool) -> Column:
    """Parse a stripped string as a double; invalid -> error (strict) or NULL."""
    canon = F.translate(text, "_", "")
    ok = F.lower(text).rlike(_NUMBER)
    parsed = canon.cast("double")
    bad = F.raise_error(F.concat(F.lit("could not convert string to float: "), text)).cast("double")
    return F.when(ok, parsed).otherwise(bad if strict else F.lit(None).cast("double"))


def detection_limit(col: Column | str, strict: bool = True, dtype: T.DataType | None = None) -> Column:
    """Below-detection-limit coercion of one measurement.

    * NULL / NaN / blank / ``bdl`` / ``nd`` (any case)      -> NULL
    * any text containing ``<``: the number after the last ``<``, halved
    * otherwise the value as a double
    * anything else is an error (``strict``) or NULL

    Pass ``dtype`` when the column is already numeric to skip the text path.
    """
    c = F.col(col) if isinstance(col, str) else col
    if dtype is not None and isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast("double"))
    return nan_to_null(bind_once(_strip(c.cast("string")), lambda s: _limit(s, strict)))


def _limit(s: Column, strict: bool) -> Column:
    """:func:`detection_limit` of a stripped text."""
    missing = s.isNull() | (s == "") | F.lower(s).isin("bdl", "nd")
    after_lt = _strip(F.element_at(F.split(s, "<"), -1))
    return (
        F.when(missing, F.lit(None).cast("double"))
        .when(s.contains("<"), bind_once(after_lt, lambda t: _number(t, strict)) / F.lit(2.0))
        .otherwise(_number(s, strict))
    )


def clean_numeric_frame(df: DataFrame, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Apply :func:`detection_limit` to every listed column in one projection."""
    columns = list(df.columns) if columns is None else columns
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in df.columns:
        if name in columns:
            out.append(detection_limit(F.col(f"`{name}`"), strict, types[name]).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)

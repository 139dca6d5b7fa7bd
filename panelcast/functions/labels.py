"""Small derived-label and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def station_year(site: Column | str, day: Column | str) -> Column:
    """``<site>-<year>`` block label."""
    return F.concat_ws("-", _c(site).cast("string"), F.year(_c(day)).cast("string"))


def clip_nonnegative(pred: Column | str) -> Column:
    """``max(pred, 0)`` that keeps NULL as NULL (``greatest(NULL, 0)`` is 0)."""
    p = _c(pred)
    return F.when(p.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(p, F.lit(0.0)))


def is_event(col: Column | str, threshold: float) -> Column:
    """Inclusive threshold exceedance."""
    return _c(col) >= F.lit(float(threshold))


def format_mean_sd(mean: Column | str, sd: Column | str) -> Column:
    """``NA`` / ``%.4f`` / ``%.4f +/- %.4f``."""
    m, s = _c(mean), _c(sd)
    return (
        F.when(m.isNull(), F.lit("NA"))
        .when(s.isNull(), F.format_string("%.4f", m))
        .otherwise(F.format_string("%.4f +/- %.4f", m, s))
    )

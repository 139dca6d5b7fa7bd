"""Reference forecasts every model is compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.folds import seasonal_climatology
from panelcast.operators.select import quote


def persistence(assigned: DataFrame, current: str, out: str = "y_pred") -> DataFrame:
    """Forecast = the current observed value (never clipped)."""
    return assigned.withColumn(out, quote(current).cast("double"))


def baseline_predictions(assigned: DataFrame, *, current: str, target: str, site: str,
                         date: str = "target_date", keep: list[str] | None = None) -> DataFrame:
    """Persistence and seasonal climatology for every (split type, fold, test row).

    Output: split_type, fold, method, model, baseline, ``keep`` columns,
    y_true, y_pred.
    """
    keep = keep or []
    cols = ["split_type", "fold", *keep]

    def label(df: DataFrame, method: str) -> DataFrame:
        return df.select(
            "split_type", "fold", F.lit(method).alias("method"), F.lit("none").alias("model"),
            F.lit(method).alias("baseline"), *[quote(c) for c in keep],
            quote(target).cast("double").alias("y_true"), F.col("y_pred"))

    parts = [
        label(persistence(assigned.select(*[quote(c) for c in dict.fromkeys(cols + [current, target])]),
                          current), "persistence"),
        label(seasonal_climatology(assigned.select(*[quote(c) for c in dict.fromkeys(cols + [site, date, target])]),
                                   site=site, date=date, y=target), "seasonal_climatology"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)

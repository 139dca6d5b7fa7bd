"""Regression and threshold-event metrics as grouped aggregations.

Each function is one ``groupBy(...).agg(...)``: partial (map-side)
aggregation, so a group that holds a third of the rows still costs one small
partial row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.labels import format_mean_sd
from panelcast.operators.select import quote
from panelcast.schema import SUMMARY_METRICS

R2_VARIANCE_ATOL = 1e-8  # variance this close to 0 counts as constant truth


def _err(y_true: str, y_pred: str) -> Column:
    return quote(y_pred) - quote(y_true)


def regression_metric_columns(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    """mae, mse, rmse, r2 (constant truth: 1.0 if perfect else 0.0; fewer than 2 rows: NULL)."""
    e = _err(y_true, y_pred)
    sse = F.sum(e * e)
    n = F.count(F.lit(1))
    sst = F.var_pop(quote(y_true)) * n
    r2 = (F.when(n < 2, F.lit(None).cast("double"))
          .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - sse / sst))
    return [F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
            F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2")]


def event_metric_columns(y_true: str = "y_true", y_pred: str = "y_pred",
                         threshold: float = 1.0) -> list[Column]:
    """mae, rmse, r2 (NULL if < 2 rows or ~constant truth), contingency counts, POD/FAR/CSI."""
    e = _err(y_true, y_pred)
    n = F.count(F.lit(1))
    var = F.var_pop(quote(y_true))
    r2 = F.when((n >= 2) & (var > R2_VARIANCE_ATOL), F.lit(1.0) - F.sum(e * e) / (var * n))
    obs = quote(y_true) >= F.lit(float(threshold))
    pre = quote(y_pred) >= F.lit(float(threshold))
    hits = F.count_if(obs & pre)
    misses = F.count_if(obs & ~pre)
    false_alarms = F.count_if(~obs & pre)
    correct_neg = F.count_if(~obs & ~pre)
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        r2.alias("r2"),
        F.try_divide(hits, hits + misses).alias("pod"),
        F.try_divide(false_alarms, hits + false_alarms).alias("far"),
        F.try_divide(hits, hits + misses + false_alarms).alias("csi"),
        hits.alias("hits"),
        misses.alias("misses"),
        false_alarms.alias("false_alarms"),
        correct_neg.alias("correct_negatives"),
    ]


def regression_metrics(df: DataFrame, by: list[str], y_true: str = "y_true",
                       y_pred: str = "y_pred") -> DataFrame:
    return df.groupBy(*[quote(b) for b in by]).agg(*regression_metric_columns(y_true, y_pred))


def event_metrics(df: DataFrame, by: list[str], y_true: str = "y_true", y_pred: str = "y_pred",
                  threshold: float = 1.0) -> DataFrame:
    """Grouped regression + event metrics (one row per group)."""
    return df.groupBy(*[quote(b) for b in by]).agg(
        F.count(F.lit(1)).alias("test_rows"), *event_metric_columns(y_true, y_pred, threshold))


def summarize_fold_metrics(fold_metrics: DataFrame, metrics=SUMMARY_METRICS) -> DataFrame:
    """Across folds: distinct folds, summed test rows; per metric the number
    of non-NULL folds, unweighted mean, sample SD (NULL for one value) and a
    ``mean +/- sd`` text."""
    keys = ["horizon_days", "split_type", "method", "model", "baseline", "threshold"]
    aggs = [F.countDistinct("fold").alias("folds"), F.sum("test_rows").alias("test_rows")]
    for m in metrics:
        aggs += [F.count(m).alias(f"{m}_valid_folds"), F.avg(m).alias(f"{m}_mean"),
                 F.stddev_samp(m).alias(f"{m}_sd")]
    out = fold_metrics.groupBy(*keys).agg(*aggs)
    return out.select("*", *[format_mean_sd(f"{m}_mean", f"{m}_sd").alias(f"{m}_mean_sd")
                             for m in metrics])


def summarize_pooled_predictions(predictions: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Metrics over all held-out rows of each (split type, method)."""
    keys = ["split_type", "method", "model", "baseline"]
    return predictions.groupBy(*keys).agg(
        F.first("nominal_horizon_days").alias("horizon_days"),
        F.count(F.lit(1)).alias("test_rows"),
        F.lit(float(threshold)).alias("threshold"),
        *event_metric_columns("y_true", "y_pred", threshold),
    )

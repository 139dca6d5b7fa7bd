"""Report sinks: tables, one-row JSON run records, summary text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.schema import EVENT_METRICS, REGRESSION_METRICS

# --- fixed values: display names of the summary text ---
SUMMARY_DISPLAY = {
    "horizon_days": "horizon",
    "test_rows": "N",
    "mae_mean_sd": "MAE (mean +/- sd)",
    "rmse_mean_sd": "RMSE (mean +/- sd)",
    "r2_mean_sd": "R2 (mean +/- sd)",
    "pod_mean_sd": "POD (mean +/- sd)",
    "far_mean_sd": "FAR (mean +/- sd)",
    "csi_mean_sd": "CSI (mean +/- sd)",
}
# --- end of fixed values ---


def write_table(df: DataFrame, path: str, *, fmt: str = "csv", partition_by: list[str] | None = None,
                order_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV (with header) or parquet; ``partition_by`` replaces per-horizon folders;
    ``order_by`` sorts the whole output (files in order, rows in order within them)."""
    if order_by:
        df = df.orderBy(*[F.col(f"`{c}`") for c in order_by])
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


INLINE_ROWS = 10_000  # rows of a table that a report holds itself


def write_json_report(spark: SparkSession, payload: dict, path: str,
                      tables: dict[str, DataFrame] | None = None, inline_rows: int = INLINE_ROWS) -> DataFrame:
    """One-row JSON run record in ``path``.  Scalars come from ``payload`` (kept as a JSON text column).

    A table of up to ``inline_rows`` rows becomes an array of row structs; a longer one is written as JSON lines
    into ``path``-tables/name, by all tasks, and the record holds that path.  Nothing goes through the driver; NULLs
    stay ``null``.
    """
    out = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    for name, table in (tables or {}).items():
        if table.limit(inline_rows + 1).count() > inline_rows:
            place = f"{path.rstrip('/')}-tables/{name}"
            table.write.mode("overwrite").option("ignoreNullFields", False).json(place)
            out = out.withColumn(name, F.lit(place))
        else:
            rows = table.agg(F.collect_list(F.struct("*")).alias(name))  # one row of at most inline_rows structs
            out = out.join(F.broadcast(rows))
    out.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return out


def summary_display(summary: DataFrame) -> DataFrame:
    """Select and rename the summary columns shown in the text report."""
    cols = ["horizon_days", "split_type", "model", "baseline", "folds", "test_rows",
            *[f"{m}_mean_sd" for m in REGRESSION_METRICS], *[f"{m}_mean_sd" for m in EVENT_METRICS]]
    return summary.select(*[F.col(c).alias(SUMMARY_DISPLAY.get(c, c)) for c in cols])


def write_summary_text(summary: DataFrame, path: str) -> None:
    """Tab-separated text lines (header first) of :func:`summary_display`."""
    disp = summary_display(summary)
    header = "\t".join(disp.columns)
    lines = disp.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in disp.columns])
                        .alias("value"))
    spark = summary.sparkSession
    spark.createDataFrame([(header,)], "value string").unionByName(lines) \
        .coalesce(1).write.mode("overwrite").text(path)

"""Resolve source columns by substring and project them (metadata only, no job)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.schema import FeatureSpec


def quote(name: str) -> Column:
    """Column reference that tolerates spaces, dots and symbols in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def first_matching_column(df: DataFrame, needle: str) -> str:
    """First column (in column order) whose name contains ``needle``; else ``KeyError``."""
    for name in df.columns:
        if needle in name:
            return name
    raise KeyError(f"No source column contains {needle!r}")


def extract_features(df: DataFrame, specs: list[FeatureSpec], *, include_date: bool = False,
                     include_site: bool = False, date_needle: str = "Date", site_needle: str = "Site",
                     date_name: str = "Time", site_name: str = "Site") -> DataFrame:
    """One projection: ``Time`` (first column containing ``Date``), ``Site``, then specs in order."""
    cols = []
    if include_date:
        try:
            cols.append(quote(first_matching_column(df, date_needle)).alias(date_name))
        except KeyError:
            raise KeyError("No Date column found") from None
    if include_site:
        try:
            cols.append(quote(first_matching_column(df, site_needle)).alias(site_name))
        except KeyError:
            raise KeyError("No Site column found") from None
    for spec in specs:
        cols.append(quote(first_matching_column(df, spec.source_contains)).alias(spec.output_name))
    return df.select(*cols)

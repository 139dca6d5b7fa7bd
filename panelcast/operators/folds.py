"""Blocked (leave-one-group-out) validation folds.

A fold is not a pair of index lists: every row carries its group value, and
fold ``f`` tests the rows with ``group = f`` and trains on the rest.  Each row
is a test row exactly once per split type, so predictions for all folds are
one pass over the rows.  Training statistics of fold ``f`` are obtained as
*total minus fold f* for additive statistics, so no per-fold copy of the
training data is ever built.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.select import quote

# --- fixed values: split type -> group column of the pairs table ---
SPLIT_GROUP = {"year": "target_year", "station_year": "station_year"}
SPLIT_DESCRIPTION = {
    "year": "leave one target year out",
    "station_year": "leave one monitoring-site target-year block out",
}
# --- end of fixed values ---


def split_group_column(split_type: str) -> str:
    try:
        return SPLIT_GROUP[split_type]
    except KeyError:
        raise ValueError(f"unknown split type {split_type!r}; use one of {sorted(SPLIT_GROUP)}") from None


def assign_blocked_folds(pairs: DataFrame, split_types=("year", "station_year")) -> DataFrame:
    """Long table: each row once per split type, with ``split_type`` and its
    test ``fold`` (the group value as text)."""
    split_types = list(dict.fromkeys(split_types))
    parts = [pairs.select("*", F.lit(st).alias("split_type"),
                          quote(split_group_column(st)).cast("string").alias("fold"))
             for st in split_types]
    return reduce(lambda a, b: a.unionByName(b), parts)


def blocked_fold_sizes(assigned: DataFrame) -> DataFrame:
    """(split_type, fold, train_rows, test_rows).

    Rows per fold come from a partially aggregated count; the split total is
    a sum over the per-fold table (one small row per fold), not a re-scan.
    """
    per = assigned.groupBy("split_type", "fold").agg(F.count(F.lit(1)).alias("test_rows"))
    total = per.groupBy("split_type").agg(F.sum("test_rows").alias("__rows"))  # one row per split type
    return per.join(total, "split_type").select(
        "split_type", "fold", (F.col("__rows") - F.col("test_rows")).alias("train_rows"), "test_rows")


def greedy_group_folds(groups: list[tuple[str, int]], n_splits: int) -> dict[str, int]:
    """Group -> inner fold: whole groups, largest first into the currently
    lightest fold (ties: lower fold, then group name)."""
    load = [(0, j) for j in range(n_splits)]
    out = {}
    for g, n in sorted(groups, key=lambda t: (-t[1], t[0])):
        size, j = heapq.heappop(load)
        out[g] = j
        heapq.heappush(load, (size + n, j))
    return out


def nested_group_folds(assigned: DataFrame, inner_cv: int = 5) -> DataFrame:
    """(split_type, outer, fold, inner): for each outer fold, the inner fold of every other group.

    The result has groups x groups rows per split type by its nature; each
    outer fold is worked out from the list of group sizes.
    """
    counts = assigned.groupBy("split_type", "fold").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("split_type").agg(F.collect_list(F.struct("fold", "n")).alias("groups"))
    rows = counts.select("split_type", F.col("fold").alias("outer")).join(lists, "split_type")

    def run(frames):
        for pdf in frames:
            for split_type, outer, groups in zip(pdf["split_type"], pdf["outer"], pdf["groups"]):
                others = [(g["fold"], int(g["n"])) for g in groups if g["fold"] != outer]
                k = min(inner_cv, len(others))
                if k < 2:
                    raise ValueError("tuning needs at least two training groups in every outer fold")
                found = greedy_group_folds(others, k)
                yield pd.DataFrame({"split_type": split_type, "outer": outer, "fold": list(found), "inner": list(found.values())})

    return rows.mapInPandas(run, "split_type string, outer string, fold string, inner int")


def leave_one_out_mean(total_sum, total_n, fold_sum, fold_n):
    """Mean of the rows outside the fold; NULL when none are left."""
    left = total_n - fold_n
    return F.when(left > 0, (total_sum - fold_sum) / left)


def seasonal_climatology(assigned: DataFrame, *, site: str, date: str, y: str,
                         out: str = "y_pred") -> DataFrame:
    """Training-only mean of ``y`` for the test row's (site, month), falling
    back to the month, then to all training rows; for every fold at once.

    Aggregates at (split_type, fold, site, month), derives all coarser
    totals from that table, and subtracts the fold's own share.
    """
    a = assigned.withColumn("__m", F.month(quote(date)))
    cell_keys = ["split_type", "fold", site, "__m"]
    cell = a.groupBy(*cell_keys).agg(F.sum(quote(y)).alias("s"), F.count(quote(y)).alias("n"))
    site_month = cell.groupBy("split_type", site, "__m").agg(
        F.sum("s").alias("s_sm"), F.sum("n").alias("n_sm"))
    fold_month = cell.groupBy("split_type", "fold", "__m").agg(
        F.sum("s").alias("s_fm"), F.sum("n").alias("n_fm"))
    month = cell.groupBy("split_type", "__m").agg(F.sum("s").alias("s_m"), F.sum("n").alias("n_m"))
    fold = cell.groupBy("split_type", "fold").agg(F.sum("s").alias("s_f"), F.sum("n").alias("n_f"))
    overall = cell.groupBy("split_type").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    pred = (
        cell.join(site_month, ["split_type", site, "__m"])
        .join(fold_month, ["split_type", "fold", "__m"])
        .join(F.broadcast(month), ["split_type", "__m"])      # <= 12 rows per split type
        .join(fold, ["split_type", "fold"])
        .join(F.broadcast(overall), ["split_type"])            # 1 row per split type
        .select(*cell_keys, F.coalesce(
            leave_one_out_mean(F.col("s_sm"), F.col("n_sm"), F.col("s"), F.col("n")),
            leave_one_out_mean(F.col("s_m"), F.col("n_m"), F.col("s_fm"), F.col("n_fm")),
            leave_one_out_mean(F.col("s_all"), F.col("n_all"), F.col("s_f"), F.col("n_f")),
        ).alias(out))
    )
    return a.join(pred, cell_keys).drop("__m")

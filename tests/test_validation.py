"""Blocked folds, baselines and metrics on the reference's fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from panelcast.operators.folds import assign_blocked_folds, blocked_fold_sizes, seasonal_climatology
from panelcast.operators.metrics import (event_metrics, regression_metrics,
                                         summarize_fold_metrics, summarize_pooled_predictions)

D = dt.date


def test_blocked_splits_hold_out_complete_groups(spark):
    meta = spark.createDataFrame([(2020, "A-2020"), (2020, "B-2020"), (2021, "A-2021"),
                                  (2021, "B-2021")], "target_year int, station_year string")
    a = assign_blocked_folds(meta)
    for st, col, nfolds in [("year", "target_year", 2), ("station_year", "station_year", 4)]:
        rows = a.where(F.col("split_type") == st).collect()
        folds = sorted({r["fold"] for r in rows}, key=str)
        assert len(folds) == nfolds
        for f in folds:
            test = {str(r[col]) for r in rows if r["fold"] == f}
            train = {str(r[col]) for r in rows if r["fold"] != f}
            assert test == {f} and not (train & test)
    sizes = {(r["split_type"], r["fold"]): (r["train_rows"], r["test_rows"])
             for r in blocked_fold_sizes(a).collect()}
    assert sizes[("year", "2020")] == (2, 2) and sizes[("station_year", "A-2021")] == (3, 1)


def test_event_metrics_at_threshold_one(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)],
                               "y_true double, y_pred double").withColumn("g", F.lit(1))
    m = event_metrics(df, ["g"], threshold=1.0).first()
    assert (m["hits"], m["misses"], m["false_alarms"], m["correct_negatives"]) == (1, 1, 1, 1)
    assert m["pod"] == 0.5 and m["far"] == 0.5 and abs(m["csi"] - 1 / 3) < 1e-15


def test_no_events_and_r2_edges(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.1, 0.3)], "y_true double, y_pred double")
    m = event_metrics(df.withColumn("g", F.lit(1)), ["g"], threshold=1.0).first()
    assert m["pod"] is None and m["far"] is None and m["csi"] is None and m["r2"] is None
    one = event_metrics(df.limit(1).withColumn("g", F.lit(1)), ["g"]).first()
    assert one["r2"] is None
    perfect = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y_true double, y_pred double")
    assert regression_metrics(perfect.withColumn("g", F.lit(1)), ["g"]).first()["r2"] == 1.0


def test_seasonal_climatology_uses_training_data_only(spark):
    rows = [("A", D(2019, 6, 1), 1.0, "train"), ("A", D(2020, 6, 15), 3.0, "train"),
            ("B", D(2020, 7, 1), 10.0, "train"), ("A", D(2021, 6, 1), 0.0, "test"),
            ("C", D(2021, 7, 1), 0.0, "test"), ("C", D(2021, 8, 1), 0.0, "test")]
    df = spark.createDataFrame(rows, "Site string, target_date date, y double, fold string")
    df = df.withColumn("split_type", F.lit("x"))
    out = seasonal_climatology(df, site="Site", date="target_date", y="y")
    got = {(r["Site"], r["target_date"]): r["y_pred"] for r in out.where("fold = 'test'").collect()}
    assert got[("A", D(2021, 6, 1))] == 2.0
    assert got[("C", D(2021, 7, 1))] == 10.0
    assert abs(got[("C", D(2021, 8, 1))] - 14.0 / 3.0) < 1e-12


def test_pooled_metrics_keep_methods_separate(spark):
    rows = [("year", "linear", "Linear Regression", "none", 7, 0.0, 0.0),
            ("year", "linear", "Linear Regression", "none", 7, 2.0, 2.0),
            ("year", "persistence", "none", "persistence", 7, 0.0, 2.0),
            ("year", "persistence", "none", "persistence", 7, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "split_type string, method string, model string, "
                                     "baseline string, nominal_horizon_days int, y_true double, "
                                     "y_pred double")
    pooled = summarize_pooled_predictions(df).orderBy("method").collect()
    assert [r["method"] for r in pooled] == ["linear", "persistence"]
    assert [r["mae"] for r in pooled] == [0.0, 2.0]


def test_fold_summary_mean_and_sample_sd(spark):
    rows = [(7, "year", f, "persistence", "none", "persistence", 1.0, n, v, v, v, v, v, v)
            for f, n, v in [("2020", 3, 1.0), ("2021", 4, 3.0)]]
    df = spark.createDataFrame(rows, "horizon_days int, split_type string, fold string, "
                                     "method string, model string, baseline string, "
                                     "threshold double, test_rows long, mae double, rmse double, "
                                     "r2 double, pod double, far double, csi double")
    s = summarize_fold_metrics(df).first()
    assert s["folds"] == 2 and s["test_rows"] == 7 and s["mae_mean"] == 2.0
    assert abs(s["mae_sd"] - 2 ** 0.5) < 1e-12 and s["mae_mean_sd"] == "2.0000 +/- 1.4142"


def test_group_kfold_whole_groups_and_balance(spark):
    from testdata_paths import SF001
    from panelcast.plans.catalog import q_group_kfold
    rows = q_group_kfold(spark, SF001).collect()
    outer = {r["outer_fold"] for r in rows}
    for f in outer:
        sub = [r for r in rows if r["outer_fold"] == f]
        assert f not in {r["group"] for r in sub}
        assert len({r["group"] for r in sub}) == len(sub)  # each group in one inner fold
        loads = {}
        for r in sub:
            loads[r["inner_fold"]] = loads.get(r["inner_fold"], 0) + r["rows"]
        assert len(loads) == min(5, len(outer) - 1)
        # greedy: no fold exceeds the lightest by more than the largest group
        assert max(loads.values()) - min(loads.values()) <= max(r["rows"] for r in sub)

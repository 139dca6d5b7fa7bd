"""Series operators on the reference's hand-made fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators.series import (interpolate_daily, multi_horizon_targets, shifted_target,
                                        site_day_mean, weekly_pairs)
from panelcast.schema import TOXIN_MODEL_FEATURES

D = dt.date


def _daily(spark, dates, sites=None, values=None):
    rows = []
    for i, d in enumerate(dates):
        vals = values[i] if values is not None else i
        row = [d] + ([sites[i]] if sites else []) + [float(vals)] * len(TOXIN_MODEL_FEATURES)
        rows.append(row)
    cols = ["Date"] + (["Site"] if sites else []) + TOXIN_MODEL_FEATURES
    return spark.createDataFrame(rows, cols)


def test_horizon_target_does_not_cross_calendar_years(spark):
    dates = [D(2020, 12, 30), D(2020, 12, 31), D(2021, 1, 1), D(2021, 1, 2), D(2021, 1, 3)]
    out = shifted_target(_daily(spark, dates), "Total microcystin", horizon_days=2,
                         out="y").collect()
    assert [(r["Date"], r["y"]) for r in out] == [(D(2021, 1, 1), 4.0)]


def test_horizon_target_does_not_cross_sites(spark):
    dates = [D(2021, 6, 1), D(2021, 6, 2)] * 2
    df = _daily(spark, dates, sites=["A", "A", "B", "B"], values=[0, 1, 10, 11])
    out = shifted_target(df, "Total microcystin", horizon_days=1, site="Site", out="y")
    assert sorted((r["Site"], r["y"]) for r in out.collect()) == [("A", 1.0), ("B", 11.0)]


def test_horizon_validation(spark):
    with pytest.raises(ValueError):
        shifted_target(_daily(spark, [D(2021, 1, 1)]), "Total microcystin", horizon_days=0)


def test_multi_horizon_equals_single_horizons(spark):
    dates = [D(2021, 6, 1) + dt.timedelta(days=i) for i in range(10)]
    df = _daily(spark, dates, sites=["A"] * 10, values=list(range(10))).select(
        "Date", "Site", F.col("`Total microcystin`").alias("t"))
    long = multi_horizon_targets(df, "t", [1, 3], site="Site", out="y").collect()
    by_h = {}
    for r in long:
        by_h.setdefault(r["horizon_days"], []).append((r["Date"], r["y"]))
    for h in (1, 3):
        single = shifted_target(df, "t", horizon_days=h, site="Site", out="y").collect()
        assert sorted(by_h[h]) == sorted((r["Date"], r["y"]) for r in single)


def _obs(spark):
    rows = [("A", D(2020, 6, 1)), ("A", D(2020, 6, 8)), ("A", D(2020, 6, 22)),
            ("B", D(2020, 6, 1)), ("B", D(2020, 6, 10))]
    totals = [0.5, 1.5, 4.0, 2.0, 3.0]
    data = []
    for i, (s, t) in enumerate(rows):
        feats = [float(i)] * len(TOXIN_MODEL_FEATURES)
        feats[0] = totals[i]
        data.append([s, t] + feats)
    return spark.createDataFrame(data, ["Site", "Time"] + TOXIN_MODEL_FEATURES)


def test_weekly_pairs_use_only_consecutive_observed_dates(spark):
    pairs = weekly_pairs(_obs(spark), site="Site", time="Time", target="Total microcystin",
                         features=TOXIN_MODEL_FEATURES).orderBy("target_date", "Site").collect()
    assert [(r["Site"], r["actual_horizon_days"]) for r in pairs] == [("A", 7), ("B", 9)]
    assert [r["target_date"] for r in pairs] == [D(2020, 6, 8), D(2020, 6, 10)]
    assert [r["Total microcystin_target"] for r in pairs] == [1.5, 3.0]
    assert [r["station_year"] for r in pairs] == ["A-2020", "B-2020"]


def test_pair_with_null_next_is_dropped_not_skipped(spark):
    df = spark.createDataFrame([("A", D(2020, 6, 1), 1.0), ("A", D(2020, 6, 8), None),
                                ("A", D(2020, 6, 15), 3.0)], "Site string, Time date, y double")
    assert weekly_pairs(df, site="Site", time="Time", target="y", features=["y"]).count() == 0


def test_weekly_pairs_parameter_validation(spark):
    df = _obs(spark)
    with pytest.raises(ValueError):
        weekly_pairs(df, site="Site", time="Time", target="Total microcystin", features=[],
                     nominal_horizon_days=7, tolerance_days=7)


def test_site_day_mean_skips_nulls(spark):
    df = spark.createDataFrame([("A", "2020-06-01 08:00:00", 2.0, None),
                                ("A", "2020-06-01 15:30:00", 4.0, None)],
                               "Site string, Time string, a double, b double")
    r = site_day_mean(df, "Site", "Time", ["a", "b"]).collect()
    assert len(r) == 1 and r[0]["a"] == 3.0 and r[0]["b"] is None and r[0]["Time"] == D(2020, 6, 1)


def _interp(spark, rows, **kw):
    df = spark.createDataFrame(rows, "Time string, v double, ord long")
    out = interpolate_daily(df, time="Time", values=["v"], order_by="ord", **kw)
    return [(r["Date"], r["v"]) for r in out.orderBy("Date").collect()]


def test_interpolate_same_year(spark):
    got = _interp(spark, [("6/1/2020", 0.0, 0), ("06/04/2020", 3.0, 1)])
    assert got == [(D(2020, 6, 1), 0.0), (D(2020, 6, 2), 1.0), (D(2020, 6, 3), 2.0),
                   (D(2020, 6, 4), 3.0)]


def test_interpolate_year_edge(spark):
    got = _interp(spark, [("12/30/2020", 1.0, 0), ("1/2/2021", 9.0, 1)])
    assert got == [(D(2020, 12, 30), 1.0), (D(2021, 1, 2), 9.0)]


def test_interpolate_duplicate_date(spark):
    got = _interp(spark, [("6/1/2020", 1.0, 0), ("6/1/2020", 5.0, 1), ("6/2/2020", 6.0, 2)])
    assert got == [(D(2020, 6, 1), 5.0), (D(2020, 6, 2), 6.0)]


def test_interpolate_duplicate_date_ends_segment_with_first_row(spark):
    # (1,a) (3,b1) (3,b2) (5,c): days 1-2 run towards b1; days 3-4 start at b2
    got = _interp(spark, [("6/1/2020", 0.0, 0), ("6/3/2020", 10.0, 1), ("6/3/2020", 20.0, 2),
                          ("6/5/2020", 40.0, 3)])
    assert got == [(D(2020, 6, 1), 0.0), (D(2020, 6, 2), 5.0), (D(2020, 6, 3), 20.0),
                   (D(2020, 6, 4), 30.0), (D(2020, 6, 5), 40.0)]


def test_interpolate_missing_next_poisons_segment(spark):
    got = _interp(spark, [("6/1/2020", 1.0, 0), ("6/3/2020", None, 1)])
    assert got == [(D(2020, 6, 1), None), (D(2020, 6, 2), None), (D(2020, 6, 3), None)]


def test_interpolate_drops_unparseable_dates(spark):
    got = _interp(spark, [("2020-06-01", 1.0, 0), ("6/2/2020", 2.0, 1)])
    assert got == [(D(2020, 6, 2), 2.0)]


def test_null_site_kept_by_interpolation_gone_after_target(spark):
    df = spark.createDataFrame([(None, "6/1/2020", 1.0), (None, "6/2/2020", 2.0)],
                               "Site string, Time string, v double")
    daily = interpolate_daily(df, time="Time", values=["v"], site="Site")
    assert daily.count() == 2
    assert shifted_target(daily, "v", horizon_days=1, site="Site").count() == 0


def test_panel_interpolated_rows_equal_day_span(spark):
    from testdata_paths import SF001
    from panelcast.plans import catalog, panel
    d = catalog.daily(spark, SF001)
    obs = panel.observations(spark, SF001)
    span = (obs.groupBy("site", F.year("time").alias("y"))
            .agg((F.datediff(F.max("time"), F.min("time")) + 1).alias("n"))
            .agg(F.sum("n")).first()[0])
    assert d.count() == span == 24474


def test_targets_of_daily_rows_need_one_shuffle_by_site_year(spark):
    """Rows interpolated inside a site-year already lie where the target windows want them."""
    from testdata_paths import SF001
    from panelcast.plans import catalog
    for q in (catalog.q_multi_horizon_targets, catalog.q_shifted_target_7d):
        plan = q(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # site-day means; site-years


def test_year_column_gives_the_same_targets(spark):
    from testdata_paths import SF001
    from panelcast.plans import catalog
    plain, carried = catalog.daily(spark, SF001), catalog.daily(spark, SF001, "yr")
    assert carried.where(F.col("yr") != F.year("Date")).isEmpty() and carried.drop("yr").columns == plain.columns
    for f in (lambda d, **k: shifted_target(d, "total", site="site", **k), lambda d, **k: multi_horizon_targets(d, "total", [1, 7], site="site", **k)):
        a, b = f(plain), f(carried, year_col="yr")
        assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())


def test_quantise_equals_spark_round_and_needs_no_decimal(spark):
    from panelcast.plans.catalog import half_away, quantise
    xs = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, 4503599627370496.5,
          9007199254740993.0, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None, *[i / 8 for i in range(-40, 40)]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select((half_away(F.col("x")) + 0.0).alias("a"), (F.round("x") + 0.0).alias("b")).collect()
    assert all(repr(r["a"]) == repr(r["b"]) for r in got)
    plan = df.select(quantise(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions.cleaning import clean_numeric_frame, detection_limit
from panelcast.functions.dates import parse_any_timestamp, parse_timestamp
from panelcast.functions.labels import clip_nonnegative, format_mean_sd
from panelcast.operators.select import extract_features, first_matching_column
from panelcast.schema import FeatureSpec


def _clean(spark, values, strict=False):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(detection_limit("v", strict=strict)).collect()]


def test_detection_limit_values(spark):
    got = _clean(spark, ["<0.05", " 1.5 ", "BDL", "nd", "", None, "a<0.2", "1_000", "5d", "abc",
                         "NaN", "1e3", ".5"])
    assert got == [0.025, 1.5, None, None, None, None, 0.1, 1000.0, None, None, None, 1000.0, 0.5]


def test_detection_limit_strict_raises(spark):
    df = spark.createDataFrame([("abc",)], "v string")
    with pytest.raises(Exception):
        df.select(detection_limit("v", strict=True)).collect()


def test_clean_numeric_frame_keeps_numeric_columns(spark):
    df = spark.createDataFrame([(1, float("nan"), "<2")], "a int, b double, c string")
    r = clean_numeric_frame(df).collect()[0]
    assert (r["a"], r["b"], r["c"]) == (1.0, None, 1.0)


def test_parse_fixed_format(spark):
    df = spark.createDataFrame([("6/1/2020",), ("06/01/2020",), ("2020-06-01",), ("x",)], "d string")
    got = [r[0] for r in df.select(parse_timestamp("d")).collect()]
    assert got[:2] == [dt.datetime(2020, 6, 1)] * 2 and got[2:] == [None, None]


def test_parse_any_format(spark):
    df = spark.createDataFrame([("6/1/2020",), ("2020-06-01 10:00:00",), ("x",)], "d string")
    got = [r[0] for r in df.select(F.to_date(parse_any_timestamp("d"))).collect()]
    assert got == [dt.date(2020, 6, 1), dt.date(2020, 6, 1), None]


def test_first_matching_column_order_and_error(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Tax a` int, `Tax b` int, `Sample Date` int")
    assert first_matching_column(df, "Tax") == "Tax a"
    with pytest.raises(KeyError):
        first_matching_column(df, "Missing")
    out = extract_features(df, [FeatureSpec("t", "Tax")], include_date=True)
    assert out.columns == ["Time", "t"]
    with pytest.raises(KeyError):
        extract_features(df, [], include_site=True)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "p double")
    assert [r[0] for r in df.select(clip_nonnegative("p")).collect()] == [0.0, None, 2.0]


def test_format_mean_sd(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 0.5)], "m double, s double")
    got = [r[0] for r in df.select(format_mean_sd("m", "s")).collect()]
    assert got == ["NA", "1.0000", "1.0000 +/- 0.5000"]


def test_formats_that_cannot_fit_are_not_tried(spark):
    from panelcast.functions import dates
    assert dates.format_shape("yyyy-MM-dd") == "%-%-%"
    assert dates.format_shape("yyyy-MM-dd'T'HH:mm:ss") == "%-%-%t%:%:%"
    assert dates.format_shape("yyyy[-MM]") is None and dates.format_shape("yyyy_MM") == "%\\_%"
    texts = ["2020-01-02", " 2020-01-02 ", "2020-01-02 03:04:05", "2020-01-02T03:04:05", "2020-01-02t03:04:05", "1/2/2020",
             "1/2/2020 3:04", "1/2/2020 3:04:05", "2020/1/2", "2020-1-2", "1-2-2020", "2020-13-01", "x", "", None, "1/2/2020 3",
             "1999-12-31 23:59:59", "2020-01-02  03:04:05", "1/2/2020\t3:04", "-/-", "2020_01_02"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    tried = F.coalesce(*[F.try_to_timestamp(F.trim("v"), F.lit(f)) for f in dates.DEFAULT_DATE_FORMATS])
    rows = df.select("v", parse_any_timestamp("v").alias("got"), tried.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows), rows
    assert sum(r["want"] is not None for r in rows) >= 8


def test_nan_to_null_names_its_column_once(spark):
    from panelcast.functions.cleaning import nan_to_null
    df = spark.createDataFrame([(float("nan"),), (None,), (1.5,), (float("inf"),)], "v double")
    assert [r[0] for r in df.select(nan_to_null(F.col("v"))).collect()] == [None, None, 1.5, float("inf")]
    nested = nan_to_null(nan_to_null(F.col("cell")))
    assert str(nested).count("cell") == 1

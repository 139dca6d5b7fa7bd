"""Registered queries over the driver tables and their DuckDB oracle SQL.

Every query reads whole tables (no id subsets, no row caps) and returns a
DataFrame whose column names equal those of its oracle.

Floating results are quantised to 1e-6 on both sides because the checker
hashes values: ``round(x * 1e6 + 0.0123456789) / 1e6 + 0.0``.  The test data
is discrete (two-decimal prices and rates, small counts), so many exact
results sit *on* a half-way rounding boundary, where two engines that sum
in a different order land on different sides.  The small fixed offset moves
the boundaries off that grid; ``+ 0.0`` turns -0.0 into 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.select import quote
from panelcast.plans import panel
from panelcast.plans.weekly import PanelSpec, baseline_validation, make_pairs

SEED = 42
THRESHOLD = panel.EVENT_THRESHOLD
SPEC = PanelSpec(site="site", time="time", target="total", features=list(panel.FEATURES))


QUANT = 1e6
QUANT_OFFSET = 0.0123456789


def half_away(x: F.Column) -> F.Column:
    """``round(x)`` to a whole number, halves away from zero, without the decimal text that Spark's ``round`` makes of every value."""
    even = F.rint(x)
    return F.when(F.abs(x - even) == 0.5, x + F.signum(x) * 0.5).otherwise(even)


def quantise(c):
    return half_away(c * F.lit(QUANT) + F.lit(QUANT_OFFSET)) / F.lit(QUANT) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        quantise(quote(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else quote(f.name) for f in df.schema.fields])


def sql_quantise(sql: str) -> str:
    """Rewrite every ``round(<expr>, 6)`` of an oracle string into the same
    quantisation as :func:`quantise`."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("round(")
        last_comma = -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                last_comma = k
            k += 1
        inner_expr = sql[j + len("round("):last_comma] if last_comma > 0 else None
        if inner_expr is not None and sql[last_comma + 1:k].strip() == "6":
            inner_expr = sql_quantise(inner_expr)
            out.append(sql[i:j])
            out.append(f"(round(({inner_expr}) * {QUANT} + {QUANT_OFFSET}) / {QUANT} + 0.0)")
        else:
            out.append(sql[i:k + 1])
        i = k + 1


# ---------------------------------------------------------------- shared SQL
OBS_SQL = """
obs AS (
  SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS time,
         avg(l_quantity) AS qty, avg(l_extendedprice) AS price,
         avg(l_discount) AS part_a, avg(l_tax) AS part_b,
         avg(l_discount) + avg(l_tax) AS total
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
)"""

PAIRS_SQL = OBS_SQL + """,
nx AS (
  SELECT *, lead(time) OVER (PARTITION BY site ORDER BY time) AS t2,
            lead(total) OVER (PARTITION BY site ORDER BY time) AS y2
  FROM obs
),
pairs AS (
  SELECT total, qty, price, part_a, part_b, site, time AS "current_date", t2 AS target_date,
         CAST(year(t2) AS INTEGER) AS target_year,
         concat_ws('-', CAST(site AS VARCHAR), CAST(year(t2) AS VARCHAR)) AS station_year,
         7 AS nominal_horizon_days,
         CAST(date_diff('day', time, t2) AS INTEGER) AS actual_horizon_days,
         y2 AS total_target
  FROM nx
  WHERE date_diff('day', time, t2) BETWEEN 5 AND 9 AND total IS NOT NULL AND y2 IS NOT NULL
)"""


def event_sql(y_true: str, y_pred: str, t: float = THRESHOLD, rounded: bool = True) -> str:
    """Oracle form of the regression + event metric columns."""
    if not rounded:
        return event_sql(y_true, y_pred, t).replace("round(", "(").replace(", 6)", ")")
    e = f"({y_pred} - {y_true})"
    hits = f"CAST(count_if({y_true} >= {t} AND {y_pred} >= {t}) AS BIGINT)"
    misses = f"CAST(count_if({y_true} >= {t} AND {y_pred} < {t}) AS BIGINT)"
    fa = f"CAST(count_if({y_true} < {t} AND {y_pred} >= {t}) AS BIGINT)"
    cn = f"CAST(count_if({y_true} < {t} AND {y_pred} < {t}) AS BIGINT)"
    return f"""
    count(*) AS test_rows,
    round(avg(abs({e})), 6) AS mae,
    round(sqrt(avg({e} * {e})), 6) AS rmse,
    round(CASE WHEN count(*) >= 2 AND var_pop({y_true}) > 1e-8
               THEN 1 - sum({e} * {e}) / (var_pop({y_true}) * count(*)) END, 6) AS r2,
    round({hits} / nullif({hits} + {misses}, 0), 6) AS pod,
    round({fa} / nullif({hits} + {fa}, 0), 6) AS far,
    round({hits} / nullif({hits} + {misses} + {fa}, 0), 6) AS csi,
    {hits} AS hits, {misses} AS misses, {fa} AS false_alarms, {cn} AS correct_negatives"""


# ---------------------------------------------------------------- queries
def q_site_day_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(panel.observations(spark, sf_dir))


SQL_SITE_DAY_MEAN = "WITH " + OBS_SQL + """
SELECT site, time, round(qty, 6) AS qty, round(price, 6) AS price, round(part_a, 6) AS part_a,
       round(part_b, 6) AS part_b, round(total, 6) AS total
FROM obs"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_pairs(panel.observations(spark, sf_dir), SPEC)


def q_weekly_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(pairs(spark, sf_dir))


SQL_WEEKLY_PAIRS = "WITH " + PAIRS_SQL + """
SELECT round(total, 6) AS total, round(qty, 6) AS qty, round(price, 6) AS price,
       round(part_a, 6) AS part_a, round(part_b, 6) AS part_b, site, "current_date", target_date,
       target_year, station_year, nominal_horizon_days, actual_horizon_days,
       round(total_target, 6) AS total_target
FROM pairs"""


def q_persistence_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: how well does last week's value predict this week's, per held-out year?"""
    fm, _ = baseline_validation(pairs(spark, sf_dir), SPEC, split_types=("year",), threshold=THRESHOLD)
    fm = fm.where(F.col("method") == "persistence")
    return round_doubles(fm.select("fold", "test_rows", "mae", "rmse", "r2", "pod", "far", "csi",
                                   "hits", "misses", "false_alarms", "correct_negatives"))


SQL_PERSISTENCE_BY_YEAR = "WITH " + PAIRS_SQL + f"""
SELECT CAST(target_year AS VARCHAR) AS fold, {event_sql('total_target', 'total')}
FROM pairs GROUP BY target_year"""



# ------------------------------------------------------------ text cleaning
RAW_TEXT_SQL = """
raw AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_tax < 0.02 THEN concat('<', CAST(l_discount AS VARCHAR))
              WHEN l_linenumber = 7 THEN 'ND'
              WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'bdl'
              WHEN l_linenumber = 5 AND l_linestatus = 'F' THEN '  '
              WHEN l_returnflag = 'R' THEN concat(' ', CAST(l_tax AS VARCHAR), ' ')
              ELSE CAST(l_tax AS VARCHAR) END AS reading
  FROM lineitem
)"""


def raw_text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = panel.read_table(spark, sf_dir, "lineitem")
    txt = (F.when(F.col("l_tax") < 0.02, F.concat(F.lit("<"), F.col("l_discount").cast("string")))
           .when(F.col("l_linenumber") == 7, F.lit("ND"))
           .when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "A"), F.lit("bdl"))
           .when((F.col("l_linenumber") == 5) & (F.col("l_linestatus") == "F"), F.lit("  "))
           .when(F.col("l_returnflag") == "R",
                 F.concat(F.lit(" "), F.col("l_tax").cast("string"), F.lit(" ")))
           .otherwise(F.col("l_tax").cast("string")))
    return li.select("l_orderkey", "l_linenumber", txt.alias("reading"))


def q_detection_limit_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.functions.cleaning import clean_numeric_frame
    cleaned = clean_numeric_frame(raw_text_readings(spark, sf_dir), ["reading"])
    return round_doubles(cleaned.withColumnRenamed("reading", "value"))


SQL_DETECTION_LIMIT_CLEAN = "WITH " + RAW_TEXT_SQL + """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN reading IS NULL OR trim(reading) = '' OR lower(trim(reading)) IN ('bdl', 'nd')
                  THEN NULL
                  WHEN contains(reading, '<')
                  THEN CAST(trim(string_split(reading, '<')[-1]) AS DOUBLE) / 2
                  ELSE CAST(trim(reading) AS DOUBLE) END, 6) AS value
FROM raw"""


# ------------------------------------------------------- substring columns
def renamed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw sheet whose headers only *contain* the wanted names."""
    li = panel.read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("Order ref"),
        F.col("l_linenumber").alias("Line no."),
        F.col("l_shipdate").alias("Sample Date (UTC)"),
        F.col("l_suppkey").alias("Site code"),
        F.col("l_quantity").alias("Qty ordered (units)"),
        F.col("l_extendedprice").alias("Extended price. USD"),
        F.col("l_discount").alias("Disc + rebate"),
        F.col("l_tax").alias("Tax rate %"),
        F.col("l_discount").alias("Tax rate % (copy)"),
        F.col("l_returnflag").alias("Date flag"),
    )


def q_substring_feature_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.select import extract_features
    from panelcast.schema import FeatureSpec
    specs = [FeatureSpec("order", "Order"), FeatureSpec("line", "Line"), FeatureSpec("qty", "Qty"),
             FeatureSpec("price", "price"), FeatureSpec("part_a", "Disc"),
             FeatureSpec("part_b", "Tax rate")]
    out = extract_features(renamed_lineitem(spark, sf_dir), specs, include_date=True,
                           include_site=True)
    return round_doubles(out.withColumn("Time", F.to_date("Time")))


SQL_SUBSTRING_FEATURE_SELECT = """
SELECT CAST(l_shipdate AS DATE) AS "Time", l_suppkey AS "Site", l_orderkey AS "order",
       l_linenumber AS line, round(l_quantity, 6) AS qty, round(l_extendedprice, 6) AS price,
       round(l_discount, 6) AS part_a, round(l_tax, 6) AS part_b
FROM lineitem"""


# -------------------------------------------------------------- date parse
def q_date_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.functions.dates import parse_day, parse_timestamp
    o = panel.read_table(spark, sf_dir, "orders")
    txt = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a date"))
           .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format("o_orderdate", "yyyy-MM-dd"))
           .otherwise(F.date_format("o_orderdate", "M/d/yyyy")))
    t = o.select("o_orderkey", txt.alias("raw_date"))
    parsed = t.select("o_orderkey",
                      F.to_date(parse_timestamp("raw_date", "M/d/yyyy")).alias("fixed_format_day"),
                      parse_day("raw_date").alias("any_format_day"))
    return parsed.na.drop(subset=["any_format_day"])


SQL_DATE_PARSE_FILTER = """
WITH t AS (
  SELECT o_orderkey,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'not a date'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%d')
              ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS raw_date
  FROM orders
)
SELECT o_orderkey,
       CAST(try_strptime(raw_date, '%m/%d/%Y') AS DATE) AS fixed_format_day,
       CAST(coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%m/%d/%Y')) AS DATE)
         AS any_format_day
FROM t
WHERE coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%m/%d/%Y')) IS NOT NULL"""


# ------------------------------------------------------------ daily series
def daily(spark: SparkSession, sf_dir: str, out_year: str | None = None) -> DataFrame:
    from panelcast.operators.series import add_total, interpolate_daily
    obs = panel.observations(spark, sf_dir).drop("total")
    d = interpolate_daily(obs, time="time", values=panel.MEASURES, site="site", out_year=out_year)
    return add_total(d, ("part_a", "part_b"), "total")


DAILY_SQL = OBS_SQL + """,
nxd AS (
  SELECT *, lead(time) OVER w AS t2, lead(qty) OVER w AS qty2, lead(price) OVER w AS price2,
         lead(part_a) OVER w AS part_a2, lead(part_b) OVER w AS part_b2
  FROM obs WINDOW w AS (PARTITION BY site, year(time) ORDER BY time)
),
exd AS (
  SELECT *, date_diff('day', time, t2) AS span,
         unnest(CASE WHEN t2 IS NULL THEN [0] ELSE range(0, date_diff('day', time, t2)) END) AS i
  FROM nxd
),
daily AS (
  SELECT CAST(time + CAST(i AS INTEGER) AS DATE) AS "Date", site,
         CASE WHEN t2 IS NULL THEN qty ELSE qty + (qty2 - qty) * (i / span) END AS qty,
         CASE WHEN t2 IS NULL THEN price ELSE price + (price2 - price) * (i / span) END AS price,
         CASE WHEN t2 IS NULL THEN part_a ELSE part_a + (part_a2 - part_a) * (i / span) END AS part_a,
         CASE WHEN t2 IS NULL THEN part_b ELSE part_b + (part_b2 - part_b) * (i / span) END AS part_b
  FROM exd
),
dailyt AS (SELECT *, part_a + part_b AS total FROM daily)"""


def q_daily_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(daily(spark, sf_dir))


SQL_DAILY_INTERPOLATE = "WITH " + DAILY_SQL + """
SELECT "Date", site, round(qty, 6) AS qty, round(price, 6) AS price, round(part_a, 6) AS part_a,
       round(part_b, 6) AS part_b, round(total, 6) AS total
FROM dailyt"""


def q_shifted_target_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.series import shifted_target
    out = shifted_target(daily(spark, sf_dir, "__year"), "total", horizon_days=7, date_col="Date", site="site", year_col="__year")
    return round_doubles(out)


SQL_SHIFTED_TARGET_7D = "WITH " + DAILY_SQL + """,
sh AS (SELECT *, lead(total, 7) OVER (PARTITION BY site, year("Date") ORDER BY "Date") AS tgt
       FROM dailyt)
SELECT "Date", site, round(qty, 6) AS qty, round(price, 6) AS price, round(part_a, 6) AS part_a,
       round(part_b, 6) AS part_b, round(total, 6) AS total, round(tgt, 6) AS total_next_7_days
FROM sh WHERE tgt IS NOT NULL AND site IS NOT NULL"""


def q_multi_horizon_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.series import multi_horizon_targets
    d = daily(spark, sf_dir, "__year").select("Date", "site", "__year", "total")
    out = multi_horizon_targets(d, "total", list(range(1, 8)), date_col="Date", site="site", year_col="__year")
    return round_doubles(out)


SQL_MULTI_HORIZON_TARGETS = "WITH " + DAILY_SQL + """,
hz AS (SELECT unnest(range(1, 8)) AS horizon_days),
sh AS (SELECT "Date", site, total,
              lead(total, 1) OVER w AS t1, lead(total, 2) OVER w AS t2, lead(total, 3) OVER w AS t3,
              lead(total, 4) OVER w AS t4, lead(total, 5) OVER w AS t5, lead(total, 6) OVER w AS t6,
              lead(total, 7) OVER w AS t7
       FROM dailyt WINDOW w AS (PARTITION BY site, year("Date") ORDER BY "Date")),
lg AS (SELECT "Date", site, total, CAST(horizon_days AS INTEGER) AS horizon_days,
              CASE horizon_days WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 WHEN 4 THEN t4
                   WHEN 5 THEN t5 WHEN 6 THEN t6 ELSE t7 END AS target
       FROM sh, hz)
SELECT "Date", site, round(total, 6) AS total, horizon_days, round(target, 6) AS target
FROM lg WHERE target IS NOT NULL AND site IS NOT NULL"""


# ---------------------------------------------------------- blocked folds
ASSIGNED_SQL = PAIRS_SQL + """,
assigned AS (
  SELECT 'year' AS split_type, CAST(target_year AS VARCHAR) AS fold, * FROM pairs
  UNION ALL
  SELECT 'station_year' AS split_type, station_year AS fold, * FROM pairs
),
folds AS (SELECT DISTINCT split_type, fold FROM assigned),
tr AS (SELECT f.split_type, f.fold AS tfold, a.site, month(a.target_date) AS m, a.total_target AS y
       FROM folds f JOIN assigned a ON a.split_type = f.split_type AND a.fold <> f.fold),
sm AS (SELECT split_type, tfold, site, m, avg(y) AS v FROM tr GROUP BY ALL),
mm AS (SELECT split_type, tfold, m, avg(y) AS v FROM tr GROUP BY ALL),
gm AS (SELECT split_type, tfold, avg(y) AS v FROM tr GROUP BY ALL),
clim AS (
  SELECT a.*, coalesce(sm.v, mm.v, gm.v) AS clim_pred
  FROM assigned a
  LEFT JOIN sm ON sm.split_type = a.split_type AND sm.tfold = a.fold AND sm.site = a.site
              AND sm.m = month(a.target_date)
  LEFT JOIN mm ON mm.split_type = a.split_type AND mm.tfold = a.fold AND mm.m = month(a.target_date)
  LEFT JOIN gm ON gm.split_type = a.split_type AND gm.tfold = a.fold
),
preds AS (
  SELECT split_type, fold, 'persistence' AS method, 'none' AS model, 'persistence' AS baseline,
         site, "current_date", target_date, nominal_horizon_days, total_target AS y_true, total AS y_pred
  FROM assigned
  UNION ALL
  SELECT split_type, fold, 'seasonal_climatology', 'none', 'seasonal_climatology',
         site, "current_date", target_date, nominal_horizon_days, total_target, clim_pred
  FROM clim
),
sizes AS (
  SELECT split_type, fold, count(*) AS test_rows,
         (SELECT count(*) FROM pairs) - count(*) AS train_rows
  FROM assigned GROUP BY split_type, fold
)"""


def assigned_pairs(spark: SparkSession, sf_dir: str):
    from panelcast.plans.weekly import validation_inputs
    return validation_inputs(pairs(spark, sf_dir))


def q_blocked_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sizes = assigned_pairs(spark, sf_dir)
    return sizes


SQL_BLOCKED_SPLIT_SIZES = "WITH " + ASSIGNED_SQL + """
SELECT split_type, fold, train_rows, test_rows FROM sizes"""


def baseline_run(spark: SparkSession, sf_dir: str, metrics: bool = True):
    return baseline_validation(pairs(spark, sf_dir),
                               SPEC_CUR, threshold=THRESHOLD, metrics=metrics)


def _climatology(spark: SparkSession, sf_dir: str, split_type: str) -> DataFrame:
    _, preds = baseline_run(spark, sf_dir, metrics=False)
    p = preds.where((F.col("method") == "seasonal_climatology") & (F.col("split_type") == split_type))
    return round_doubles(p.select("fold", "site", "current_date", "target_date", "y_true", "y_pred"))


def q_seasonal_climatology_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _climatology(spark, sf_dir, "year")


def q_seasonal_climatology_station_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _climatology(spark, sf_dir, "station_year")


def _sql_climatology(split_type: str) -> str:
    return "WITH " + ASSIGNED_SQL + f"""
SELECT fold, site, "current_date", target_date, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred
FROM preds WHERE method = 'seasonal_climatology' AND split_type = '{split_type}'"""


def q_event_metrics_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm, _ = baseline_run(spark, sf_dir)
    return round_doubles(fm.drop("best_params", "best_inner_cv_rmse", "inner_cv_splits",
                                 "fit_seconds"))


FOLD_METRICS_SQL = ASSIGNED_SQL + f""",
fm AS (
  SELECT p.split_type, p.fold, method, model, baseline, min(nominal_horizon_days) AS horizon_days,
         {event_sql('y_true', 'y_pred', rounded=False)}
  FROM preds p GROUP BY p.split_type, p.fold, method, model, baseline
)"""

SQL_EVENT_METRICS_BY_FOLD = "WITH " + FOLD_METRICS_SQL + f"""
SELECT horizon_days, fm.split_type, fm.fold, method, model, baseline, s.train_rows, fm.test_rows,
       {THRESHOLD} AS threshold, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
       round(pod, 6) AS pod, round(far, 6) AS far, round(csi, 6) AS csi, hits, misses,
       false_alarms, correct_negatives
FROM fm JOIN sizes s ON s.split_type = fm.split_type AND s.fold = fm.fold"""


def q_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.metrics import summarize_fold_metrics
    fm, _ = baseline_run(spark, sf_dir)
    return round_doubles(summarize_fold_metrics(fm))


def _summary_sql() -> str:
    from panelcast.schema import SUMMARY_METRICS
    parts = []
    for m in SUMMARY_METRICS:
        parts.append(f"""count({m}) AS {m}_valid_folds, round(avg({m}), 6) AS {m}_mean,
       round(stddev_samp({m}), 6) AS {m}_sd,
       CASE WHEN avg({m}) IS NULL THEN 'NA'
            WHEN stddev_samp({m}) IS NULL THEN printf('%.4f', avg({m}))
            ELSE printf('%.4f +/- %.4f', avg({m}), stddev_samp({m})) END AS {m}_mean_sd""")
    body = ",\n       ".join(parts)
    return "WITH " + FOLD_METRICS_SQL + f"""
SELECT horizon_days, split_type, method, model, baseline, {THRESHOLD} AS threshold,
       count(DISTINCT fold) AS folds, CAST(sum(test_rows) AS BIGINT) AS test_rows,
       {body}
FROM fm GROUP BY horizon_days, split_type, method, model, baseline"""


def q_pooled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.metrics import summarize_pooled_predictions
    _, preds = baseline_run(spark, sf_dir, metrics=False)
    return round_doubles(summarize_pooled_predictions(preds, threshold=THRESHOLD))


SQL_POOLED_SUMMARY = "WITH " + ASSIGNED_SQL + f"""
SELECT split_type, method, model, baseline, min(nominal_horizon_days) AS horizon_days,
       {THRESHOLD} AS threshold, {event_sql('y_true', 'y_pred')}
FROM preds GROUP BY split_type, method, model, baseline"""


SPEC_CUR = PanelSpec(site="site", time="time", target="total", features=list(panel.FEATURES))


# ------------------------------------------------- random split / k-fold
def horizon_dataset(spark: SparkSession, sf_dir: str, horizon_days: int = 7) -> DataFrame:
    from panelcast.operators.series import shifted_target
    return shifted_target(daily(spark, sf_dir, "__year"), "total", horizon_days=horizon_days,
                          date_col="Date", site="site", out="y", year_col="__year")


HORIZON_SQL = DAILY_SQL + """,
hd AS (
  SELECT * FROM (
    SELECT *, lead(total, 7) OVER (PARTITION BY site, year("Date") ORDER BY "Date") AS y FROM dailyt)
  WHERE y IS NOT NULL AND site IS NOT NULL
),
hk AS (SELECT *, md5(concat_ws(':', '42', CAST(site AS VARCHAR), CAST("Date" AS VARCHAR))) AS h
       FROM hd),
rk AS (SELECT *, row_number() OVER (ORDER BY h, site, "Date") - 1 AS shuffle_pos,
              count(*) OVER () AS n_all FROM hk),
sp AS (SELECT *, shuffle_pos < ceil(n_all * 0.2) AS is_test FROM rk)"""


def q_exact_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.ranking import exact_split
    s = exact_split(horizon_dataset(spark, sf_dir), ["site", "Date"], test_size=0.2, seed=SEED)
    return s.select("site", "Date", "is_test", "shuffle_pos")


SQL_EXACT_RANDOM_SPLIT = "WITH " + HORIZON_SQL + """
SELECT site, "Date", is_test, shuffle_pos FROM sp"""


def q_kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.ranking import kfold_assign
    s = kfold_assign(horizon_dataset(spark, sf_dir), ["site", "Date"], k=5, test_size=0.2, seed=SEED)
    return s.select("site", "Date", "is_test", "cv_fold")


SQL_KFOLD_ASSIGN = "WITH " + HORIZON_SQL + """
SELECT site, "Date", is_test,
       CASE WHEN NOT is_test
            THEN CAST(ntile(5) OVER (PARTITION BY is_test ORDER BY shuffle_pos) - 1 AS INTEGER) END
         AS cv_fold
FROM sp"""


def q_fixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.ranking import fixed_sample
    s = fixed_sample(horizon_dataset(spark, sf_dir), ["site", "Date"], 200, seed=SEED)
    return round_doubles(s.select("site", "Date", "total", "y"))


SQL_FIXED_SAMPLE = "WITH " + HORIZON_SQL + """
SELECT site, "Date", round(total, 6) AS total, round(y, 6) AS y
FROM hk ORDER BY h, site, "Date" LIMIT 200"""


# ------------------------------------------------ fold-local statistics
def _assigned_materialized(spark: SparkSession, sf_dir: str):
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.session import cut_lineage
    return assign_blocked_folds(cut_lineage(pairs(spark, sf_dir)))


def q_fold_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.foldstats import complement_moments
    m = complement_moments(_assigned_materialized(spark, sf_dir), panel.FEATURES)
    return round_doubles(m)


LONGV_SQL = ASSIGNED_SQL + """,
longv AS (
  SELECT split_type, fold, 'total' AS feature, total AS value FROM assigned
  UNION ALL SELECT split_type, fold, 'qty', qty FROM assigned
  UNION ALL SELECT split_type, fold, 'price', price FROM assigned
  UNION ALL SELECT split_type, fold, 'part_a', part_a FROM assigned
  UNION ALL SELECT split_type, fold, 'part_b', part_b FROM assigned
),
trv AS (SELECT f.split_type, f.fold, x.feature, x.value
        FROM folds f JOIN longv x ON x.split_type = f.split_type AND x.fold <> f.fold)"""

SQL_FOLD_STANDARDIZE = "WITH " + LONGV_SQL + """
SELECT split_type, fold, feature, count(*) AS n, round(avg(value), 6) AS mean,
       round(CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END, 6) AS sd
FROM trv GROUP BY split_type, fold, feature"""


def q_fold_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.foldstats import complement_median
    m = complement_median(_assigned_materialized(spark, sf_dir), panel.FEATURES,
                          ["site", "current_date"])
    return round_doubles(m)


SQL_FOLD_MEDIAN_IMPUTE = "WITH " + LONGV_SQL + """
SELECT split_type, fold, feature, round(median(value), 6) AS median
FROM trv GROUP BY split_type, fold, feature"""


# ------------------------------------------------------------------ models
def q_linear_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold-local OLS for every year and station-year fold, from one pass of moment matrices."""
    from panelcast.plans.weekly import fold_metrics, linear_predictions
    preds, details = linear_predictions(_assigned_materialized(spark, sf_dir), SPEC)
    return round_doubles(fold_metrics(preds, THRESHOLD, details).drop("fit_seconds"))


def _solve_sql(xs: list[str], y: str, keys: str, source: str) -> tuple[str, str]:
    """(CTEs, prediction) of a least-squares fit with intercept by Gaussian elimination, one system per ``keys``.

    ``source`` holds the training rows.  The CTE ``beta`` has columns b0, b1, ...
    """
    names = [*xs, y]
    k = len(xs)
    cov = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS s_{i}_{j}" for i in range(k) for j in range(i, k + 1))
    ctes = [f"e0 AS (SELECT {keys}, {cov}, {', '.join(f'avg({n}) AS m_{i}' for i, n in enumerate(names))} FROM {source} GROUP BY {keys})"]
    means = ", ".join(f"m_{i}" for i in range(k + 1))
    for step in range(k):
        cells = [f"s_{i}_{j}" if i <= step else f"s_{i}_{j} - s_{step}_{i} / s_{step}_{step} * s_{step}_{j} AS s_{i}_{j}"
                 for i in range(k) for j in range(i, k + 1)]
        ctes.append(f"e{step + 1} AS (SELECT {keys}, {means}, {', '.join(cells)} FROM e{step})")
    source = f"e{k}"
    for i in reversed(range(k)):
        later = "".join(f" - s_{i}_{j} * b{j + 1}" for j in range(i + 1, k))
        ctes.append(f"r{i} AS (SELECT *, (s_{i}_{k}{later}) / s_{i}_{i} AS b{i + 1} FROM {source})")
        source = f"r{i}"
    b0 = f"m_{k}" + "".join(f" - b{i + 1} * m_{i}" for i in range(k))
    ctes.append(f"beta AS (SELECT {keys}, {', '.join(f'b{i + 1}' for i in range(k))}, {b0} AS b0 FROM {source})")
    return ",\n".join(ctes), "b0" + "".join(f" + b{i + 1} * {{t}}.{x}" for i, x in enumerate(xs))


def _linear_sql() -> str:
    # ``total`` is the sum of two other features: predictions do not change without it
    ctes, pred = _solve_sql(["qty", "price", "part_a", "part_b"], "total_target", "split_type, fold", "lt")
    return "WITH " + ASSIGNED_SQL.split(",\ntr AS")[0] + f""",
lt AS (SELECT f.split_type, f.fold, a.* EXCLUDE (split_type, fold)
       FROM folds f JOIN assigned a ON a.split_type = f.split_type AND a.fold <> f.fold),
{ctes},
lp AS (SELECT a.split_type, a.fold, a.nominal_horizon_days, a.total_target AS y_true,
              greatest({pred.format(t="a")}, 0.0) AS y_pred
       FROM assigned a JOIN beta USING (split_type, fold)),
ls AS (SELECT split_type, count(*) AS n_all FROM assigned GROUP BY split_type)
SELECT min(nominal_horizon_days) AS horizon_days, split_type, fold, 'linear' AS method, 'Linear Regression' AS model,
       'none' AS baseline, min(n_all) - count(*) AS train_rows, {THRESHOLD} AS threshold,
       '{{}}' AS best_params, CAST(NULL AS DOUBLE) AS best_inner_cv_rmse, CAST(0 AS INTEGER) AS inner_cv_splits,
       {event_sql('y_true', 'y_pred')}
FROM lp JOIN ls USING (split_type) GROUP BY split_type, fold"""


# ---------------------------------------------- raw sheet to weekly dataset
SHEET_SPEC = PanelSpec(site="Site", time="Time", target="total", features=list(panel.FEATURES))


def raw_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a sheet of text readings with detection limits, missing cells and missing dates."""
    def shown(c: str) -> F.Column:
        return F.concat(F.lit(" "), F.col(c).cast("string"))

    return panel.read_table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 6, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Sample Date (UTC)"),
        F.col("l_suppkey").alias("Site code"),
        shown("l_quantity").alias("Qty ordered (units)"),
        F.when(F.col("l_linenumber") == 5, "nd").otherwise(shown("l_extendedprice")).alias("Extended price. USD"),
        F.when(F.col("l_discount") < 0.02, "<0.02").otherwise(shown("l_discount")).alias("Disc + rebate"),
        F.when(F.col("l_tax") < 0.01, "bdl").otherwise(shown("l_tax")).alias("Tax rate %"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.plans.weekly import prepare_observed
    from panelcast.schema import FeatureSpec
    specs = [FeatureSpec("qty", "Qty"), FeatureSpec("price", "price"), FeatureSpec("part_a", "Disc"), FeatureSpec("part_b", "Tax rate")]
    return prepare_observed(raw_sheet(spark, sf_dir), specs, total_parts=("part_a", "part_b"), total_name="total")


def q_observed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sheet to one cleaned row per site and day."""
    return round_doubles(observed(spark, sf_dir))


def q_weekly_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sheet to weekly pairs, in one plan."""
    return round_doubles(make_pairs(observed(spark, sf_dir), SHEET_SPEC))


SHEET_SQL = """
obs AS (
  SELECT site, time, qty, price, part_a, part_b, part_a + part_b AS total
  FROM (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS time, avg(l_quantity) AS qty,
               avg(CASE WHEN l_linenumber <> 5 THEN l_extendedprice END) AS price,
               avg(CASE WHEN l_discount < 0.02 THEN 0.02 / 2 ELSE l_discount END) AS part_a,
               avg(CASE WHEN l_tax >= 0.01 THEN l_tax END) AS part_b
        FROM lineitem WHERE l_linenumber <> 6 GROUP BY l_suppkey, CAST(l_shipdate AS DATE))
)"""

SQL_OBSERVED_DATASET = "WITH " + SHEET_SQL + """
SELECT site AS "Site", time AS "Time", round(qty, 6) AS qty, round(price, 6) AS price, round(part_a, 6) AS part_a,
       round(part_b, 6) AS part_b, round(total, 6) AS total
FROM obs"""

SQL_WEEKLY_DATASET = "WITH " + PAIRS_SQL.replace(OBS_SQL, SHEET_SQL) + """
SELECT site AS "Site", "current_date", target_date, target_year, station_year, nominal_horizon_days, actual_horizon_days,
       round(qty, 6) AS qty, round(price, 6) AS price, round(part_a, 6) AS part_a, round(part_b, 6) AS part_b,
       round(total, 6) AS total, round(total_target, 6) AS total_target
FROM pairs"""


# ------------------------------------------------------------ panel with gaps
def _gap(column: str) -> F.Column:
    """True for about one cell in 16, by a hash of the row's place and the column."""
    return F.substring(F.md5(F.concat_ws(":", F.col("site").cast("string"), F.col("current_date").cast("string"), F.lit(column))), 1, 1) == "0"


def pairs_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly pairs with missing feature cells."""
    p = pairs(spark, sf_dir)
    return p.select(*[F.when(~_gap(c), quote(c)).alias(c) if c in panel.FEATURES else quote(c) for c in p.columns])


def _gap_sql(c: str) -> str:
    return f"""CASE WHEN substr(md5(concat_ws(':', CAST(site AS VARCHAR), CAST("current_date" AS VARCHAR), '{c}')), 1, 1) <> '0' THEN {c} END AS {c}"""


GAPS_SQL = PAIRS_SQL + f""",
gp AS (SELECT * EXCLUDE ({", ".join(panel.FEATURES)}), {", ".join(_gap_sql(c) for c in panel.FEATURES)} FROM pairs)"""


def q_knn_regress_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN (k=5, uniform, p=2) per held-out year on the panel with gaps, filled with each fold's training medians.

    No SQL twin: all pairs do not fit into memory there; tests compare with brute force.
    """
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.plans.weekly import knn_blocked_predictions
    from panelcast.session import cut_lineage
    assigned = assign_blocked_folds(cut_lineage(pairs_with_gaps(spark, sf_dir)), ("year",))
    preds, _ = knn_blocked_predictions(assigned, SPEC)
    return round_doubles(preds.select("fold", "site", "current_date", "y_true", "y_pred"))


def q_linear_blocked_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OLS predictions for every year and station-year fold on the panel with gaps (fold medians inside)."""
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.plans.weekly import linear_predictions
    from panelcast.session import cut_lineage
    preds, _ = linear_predictions(assign_blocked_folds(cut_lineage(pairs_with_gaps(spark, sf_dir))), SPEC)
    return round_doubles(preds.select("split_type", "fold", "site", "current_date", "y_true", "y_pred"))


def _linear_missing_sql() -> str:
    ctes, pred = _solve_sql(panel.FEATURES, "total_target", "split_type, fold", "lt")
    ms = ", ".join(f"coalesce(median(a.{f}), 0) AS m_{f}" for f in panel.FEATURES)
    fill = ", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in panel.FEATURES)
    rest = ", ".join(panel.FEATURES)
    return "WITH " + GAPS_SQL + f""",
assigned AS (SELECT 'year' AS split_type, CAST(target_year AS VARCHAR) AS fold, * FROM gp
             UNION ALL SELECT 'station_year', station_year, * FROM gp),
folds AS (SELECT DISTINCT split_type, fold FROM assigned),
tr AS (SELECT f.split_type, f.fold, a.* EXCLUDE (split_type, fold)
       FROM folds f JOIN assigned a ON a.split_type = f.split_type AND a.fold <> f.fold),
md AS (SELECT split_type, fold, {ms} FROM tr a GROUP BY split_type, fold),
lt AS (SELECT split_type, fold, total_target, {fill} FROM tr JOIN md USING (split_type, fold)),
{ctes},
te AS (SELECT a.* EXCLUDE ({rest}), {fill} FROM assigned a JOIN md USING (split_type, fold))
SELECT te.split_type, te.fold, site, "current_date", round(total_target, 6) AS y_true,
       round(greatest({pred.format(t="te")}, 0.0), 6) AS y_pred
FROM te JOIN beta USING (split_type, fold)"""


def q_knn_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the panel filled from the five nearest rows."""
    from panelcast.operators.impute import impute_knn
    out = impute_knn(pairs_with_gaps(spark, sf_dir), panel.FEATURES, ["site", "current_date"])
    return round_doubles(out.select("site", "current_date", *panel.FEATURES))


def _impute_sql(feats=tuple(panel.FEATURES), k: int = 5) -> str:
    square = " + ".join(f"coalesce((q.{f} - c.{f}) * (q.{f} - c.{f}), 0)" for f in feats)
    common = " + ".join(f"CAST(q.{f} IS NOT NULL AND c.{f} IS NOT NULL AS INTEGER)" for f in feats)
    top = ", ".join(f"list_avg(list_transform(min_by(struct_pack(v := c{i}), struct_pack(d := d, s := csite, t := cdate), {k}) "
                    f"FILTER (WHERE q{i} IS NULL AND c{i} IS NOT NULL AND d IS NOT NULL), lambda x: x.v)) AS n_{f}" for i, f in enumerate(feats))
    return "WITH " + GAPS_SQL + f""",
qs AS (SELECT * FROM gp WHERE {" OR ".join(f"{f} IS NULL" for f in feats)}),
pr AS (SELECT q.site, q."current_date", c.site AS csite, c."current_date" AS cdate,
              {", ".join(f"q.{f} AS q{i}, c.{f} AS c{i}" for i, f in enumerate(feats))},
              CASE WHEN {common} > 0 THEN sqrt(({square}) * {len(feats)} / ({common})) END AS d
       FROM qs q CROSS JOIN gp c),
nb AS (SELECT site, "current_date", {top} FROM pr GROUP BY site, "current_date"),
av AS (SELECT {", ".join(f"avg({f}) AS a_{f}" for f in feats)} FROM gp)
SELECT gp.site, gp."current_date", {", ".join(f"round(coalesce(gp.{f}, n_{f}, a_{f}), 6) AS {f}" for f in feats)}
FROM gp LEFT JOIN nb ON nb.site = gp.site AND nb."current_date" = gp."current_date" CROSS JOIN av"""


def q_knn_regress_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact fold-local KNN (k=5, uniform, p=2) for every held-out year."""
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.operators.foldstats import complement_moments
    from panelcast.operators.knn import knn_neighbours, knn_predict
    from panelcast.session import cut_lineage
    assigned = assign_blocked_folds(cut_lineage(pairs(spark, sf_dir)), ("year",))
    mom = complement_moments(assigned, panel.FEATURES)
    nn = knn_neighbours(assigned, panel.FEATURES, "total_target", ["site", "current_date"], mom,
                        k_max=5, p=2)
    pred = knn_predict(nn, 5, "uniform")
    truth = assigned.select("fold", "site", "current_date", F.col("total_target").alias("y_true"))
    return round_doubles(pred.join(truth, ["fold", "site", "current_date"])
                         .select("fold", "site", "current_date", "y_true", "y_pred"))


def _knn_sql(feats=tuple(panel.FEATURES), k: int = 5) -> str:
    sds = ", ".join(f"CASE WHEN stddev_pop(x.{f}) = 0 THEN 1.0 ELSE stddev_pop(x.{f}) END AS s_{f}"
                    for f in feats)
    dist = " + ".join(f"((q.{f} - c.{f}) / q.s_{f}) * ((q.{f} - c.{f}) / q.s_{f})" for f in feats)
    return "WITH " + PAIRS_SQL + f""",
yr AS (SELECT CAST(target_year AS VARCHAR) AS fold, * FROM pairs),
fy AS (SELECT DISTINCT fold FROM yr),
mom AS (SELECT f.fold, {sds} FROM fy f JOIN yr x ON x.fold <> f.fold GROUP BY f.fold),
q AS (SELECT yr.*, {", ".join(f"mom.s_{f}" for f in feats)} FROM yr JOIN mom USING (fold)),
pr AS (SELECT q.fold, q.site, q."current_date", q.total_target AS y_true, c.total_target AS cy,
              sqrt({dist}) AS d
       FROM q JOIN yr c ON c.fold <> q.fold),
top AS (SELECT * FROM pr
        QUALIFY row_number() OVER (PARTITION BY fold, site, "current_date" ORDER BY d) <= {k})
SELECT fold, site, "current_date", round(min(y_true), 6) AS y_true, round(avg(cy), 6) AS y_pred
FROM top GROUP BY fold, site, "current_date\""""


# ----------------------------------------------------------------- outliers
def q_outlier_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination 0.5 % threshold and report per raw measure column."""
    from panelcast.operators.outliers import flag_outliers
    raw = panel.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("part_a"),
        F.col("l_tax").alias("part_b"))
    _, report = flag_outliers(raw, panel.MEASURES, ["l_orderkey", "l_linenumber"],
                              contamination=0.005)
    return round_doubles(report)


SQL_OUTLIER_THRESHOLD = """
WITH raw AS (SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice AS price,
                    l_discount AS part_a, l_tax AS part_b FROM lineitem),
lg AS (SELECT l_orderkey, l_linenumber, 'qty' AS "column", qty AS value FROM raw
       UNION ALL SELECT l_orderkey, l_linenumber, 'price', price FROM raw
       UNION ALL SELECT l_orderkey, l_linenumber, 'part_a', part_a FROM raw
       UNION ALL SELECT l_orderkey, l_linenumber, 'part_b', part_b FROM raw),
st AS (SELECT "column", avg(value) AS m, stddev_pop(value) AS s FROM lg GROUP BY "column"),
sc AS (SELECT lg.*, -abs((value - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END) AS score
       FROM lg JOIN st USING ("column")),
th AS (SELECT "column", quantile_cont(score, 0.005) AS threshold FROM sc GROUP BY "column")
SELECT "column", count(value) AS original_non_nan,
       CAST(count_if(value IS NOT NULL AND NOT (score < threshold)) AS BIGINT) AS filtered_non_nan,
       CAST(count_if(score < threshold) AS BIGINT) AS outliers, round(min(threshold), 6) AS threshold
FROM sc JOIN th USING ("column") GROUP BY "column\""""


def _tree_blocked(spark: SparkSession, sf_dir: str, name: str, params: dict) -> DataFrame:
    """Tree model for every held-out year: fold metrics.

    The registered query fits one grid point per fold (``params``); nested
    tuning over the whole grid is ``fit_blocked_spark_ml(..., tune=True)``.
    """
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.operators.models import fit_blocked_spark_ml, make_model_spec
    from panelcast.plans.weekly import PAIR_METADATA, fold_metrics
    from panelcast.session import cut_lineage
    from dataclasses import replace
    spec = make_model_spec(name, random_state=SEED)
    spec = replace(spec, param_grid={k: [v] for k, v in params.items()})
    assigned = assign_blocked_folds(cut_lineage(pairs(spark, sf_dir)), ("year",))
    preds, details = fit_blocked_spark_ml(assigned, spec, panel.FEATURES, "total_target",
                                          split_type="year", group_col="target_year", tune=False)
    preds = preds.select("split_type", "fold", F.lit(spec.name).alias("method"),
                         F.lit(spec.label).alias("model"), F.lit("none").alias("baseline"),
                         "site", *PAIR_METADATA, F.col("total_target").alias("y_true"), "y_pred")
    fm = fold_metrics(preds, THRESHOLD, details.drop("fit_seconds").withColumn("fit_seconds", F.lit(0.0)))
    return round_doubles(fm.drop("fit_seconds"))


def q_random_forest_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_blocked(spark, sf_dir, "random_forest", {"max_depth": 8})


def _block_model(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """Fold metrics of one of the block models for every held-out year."""
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.operators.models import make_model_spec
    from panelcast.plans.weekly import block_model_predictions, fold_metrics
    from panelcast.session import cut_lineage
    assigned = assign_blocked_folds(cut_lineage(pairs(spark, sf_dir)), ("year",))
    preds, details = block_model_predictions(assigned, SPEC, make_model_spec(name, random_state=SEED), split_type="year", **options)
    return round_doubles(fold_metrics(preds, THRESHOLD, details).drop("fit_seconds"))


def q_extra_trees_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 extra trees on all features for every held-out year."""
    return _block_model(spark, sf_dir, "extra_trees", tune=False, param_grid={"max_features": [1.0]})


def q_gbt_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 rounds of boosting at depth 2 for every held-out year."""
    return _block_model(spark, sf_dir, "xgboost", tune=False, param_grid={"max_depth": [2]}, n_estimators=60)


def q_ann_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net with two hidden layers for every held-out year, 20 epochs of four batches at a rate of 0.01."""
    return _block_model(spark, sf_dir, "ann", tune=False, epochs=20, rate=0.01)


def q_svr_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel machine on 40 landmarks, C tuned inside every held-out year, 12 steps."""
    return _block_model(spark, sf_dir, "svm", landmarks=40, steps=12)


# ------------------------------------------------ daily KNN grid search
def _daily_long(spark: SparkSession, sf_dir: str, horizons) -> DataFrame:
    from panelcast.operators.series import multi_horizon_targets
    d = daily(spark, sf_dir, "__year")
    return multi_horizon_targets(d, "total", list(horizons), date_col="Date", site="site", out="y", year_col="__year")


def q_knn_grid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cv_results of the 20-point KNN grid (5-fold CV, 7-day horizon), test and train scores."""
    from panelcast.plans.daily import knn_grid_search
    cv_results, _, _, _ = knn_grid_search(_daily_long(spark, sf_dir, [7]), panel.FEATURES, "y", ["site", "Date"], seed=SEED)
    return round_doubles(cv_results.withColumnRenamed("split_type", "horizon_days"))


def q_horizon_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons 1 to 7: KNN grid search per horizon, all in one plan."""
    from panelcast.plans.daily import horizon_comparison
    return round_doubles(horizon_comparison(_daily_long(spark, sf_dir, range(1, 8)), panel.FEATURES,
                                            "y", ["site", "Date"], seed=SEED, train_scores=False))


def q_polynomial_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree-2 ridge (alpha = 1) on fold-standardised features, every fold."""
    from panelcast.plans.weekly import fold_metrics, linear_predictions
    preds, details = linear_predictions(_assigned_materialized(spark, sf_dir), SPEC, alpha=1.0, degree=2,
                                        method="polynomial", label="Polynomial Regression")
    return round_doubles(fold_metrics(preds, THRESHOLD, details).drop("fit_seconds"))


# ------------------------------------------------------------ explanations
def _split_linear(spark: SparkSession, sf_dir: str):
    """Daily 7-day horizon: exact 80/20 split, OLS fitted on the training rows."""
    from panelcast.operators.linear import fit_blocked_linear
    from panelcast.operators.ranking import exact_split
    from panelcast.session import written
    d = exact_split(horizon_dataset(spark, sf_dir), ["site", "Date"], test_size=0.2, seed=SEED, position=None)
    d = written(d.select(F.lit("h7").alias("split_type"),
                         F.when(F.col("is_test"), "test").otherwise("train").alias("fold"),
                         "site", "Date", *panel.FEATURES, "y"))
    coefs = fit_blocked_linear(d, panel.FEATURES, "y").where(F.col("fold") == "test").first()
    beta = {f: coefs[f"b_{i}"] for i, f in enumerate(panel.FEATURES)}  # model parameters
    return d.where(F.col("fold") == "test"), beta, coefs["b0"]


def q_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.explain import linear_predictor, permutation_importance
    test, beta, b0 = _split_linear(spark, sf_dir)
    return round_doubles(permutation_importance(test, panel.FEATURES, "y", ["site", "Date"],
                                                linear_predictor(beta, b0), n_repeats=30, seed=SEED))


def q_shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelcast.operators.explain import linear_shapley
    from panelcast.operators.ranking import fixed_sample
    test, beta, _ = _split_linear(spark, sf_dir)
    sample = fixed_sample(test, ["site", "Date"], 200, seed=SEED)
    return round_doubles(linear_shapley(sample, panel.FEATURES, ["site", "Date"], beta))


def _tuned_knn(spark: SparkSession, sf_dir: str):
    """KNN tuned on the weekly pairs (random split, 5-fold grid search), fitted on the training rows; and the test rows."""
    from panelcast.operators.explain_knn import KnnModel
    from panelcast.operators.ranking import exact_split
    from panelcast.plans.daily import knn_grid_search
    from panelcast.session import cut_lineage
    keys = ["site", "current_date"]
    d = cut_lineage(pairs(spark, sf_dir).select(F.lit(7).alias("horizon_days"), *keys, *panel.FEATURES, F.col("total_target").alias("y")))
    _, best, _, _ = knn_grid_search(d, panel.FEATURES, "y", keys, seed=SEED, train_scores=False)
    g = best.first()  # one row
    parts = cut_lineage(exact_split(d, keys, test_size=0.2, seed=SEED, by=["horizon_days"]))
    model = KnnModel(parts.where("NOT is_test"), panel.FEATURES, "y", keys, k=g["n_neighbors"], weights=g["weights"], p=g["p"])
    return model, parts.where("is_test"), keys


def q_knn_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance (30 repeats) of the tuned KNN on the test rows."""
    from panelcast.operators.explain_knn import permutation_importance
    model, test, keys = _tuned_knn(spark, sf_dir)
    return round_doubles(permutation_importance(model, test, "y", keys, n_repeats=30, seed=SEED))


def q_knn_shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of the tuned KNN for a fixed sample of 60 test rows, all coalitions of the five features."""
    from panelcast.operators.explain_knn import shapley_values
    model, test, keys = _tuned_knn(spark, sf_dir)
    return round_doubles(shapley_values(model, test, keys, max_samples=60, seed=SEED))


def q_iforest_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation-forest outlier report (0.5 % contamination) per raw measure."""
    from panelcast.operators.outliers import flag_outliers, isolation_forest_columns
    raw = panel.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("part_a"),
        F.col("l_tax").alias("part_b"))
    ids = ["l_orderkey", "l_linenumber"]
    scored = isolation_forest_columns(raw, panel.MEASURES, ids, seed=SEED)
    _, report = flag_outliers(raw, panel.MEASURES, ids, contamination=0.005, scored=scored)
    return round_doubles(report)


def q_blocked_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN, linear and polynomial models with fixed parameters and both baselines, every fold of
    both split types, summarised across folds."""
    from panelcast.plans.weekly import evaluate_blocked_validation
    _, _, summary, _ = evaluate_blocked_validation(pairs(spark, sf_dir), SPEC, threshold=THRESHOLD, tune=False)
    return round_doubles(summary)


def _knn_nested(spark: SparkSession, sf_dir: str, split_type: str) -> DataFrame:
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.plans.weekly import fold_metrics, knn_nested_predictions
    from panelcast.session import cut_lineage
    assigned = assign_blocked_folds(cut_lineage(pairs(spark, sf_dir)), (split_type,))
    preds, details = knn_nested_predictions(assigned, SPEC, split_type=split_type)
    return round_doubles(fold_metrics(preds, THRESHOLD, details).drop("fit_seconds"))


def q_knn_nested_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN with the 20-point grid tuned by inner group k-fold CV inside every held-out year (nested), scored per fold."""
    return _knn_nested(spark, sf_dir, "year")


def q_knn_nested_station_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same inside every held-out station-year."""
    return _knn_nested(spark, sf_dir, "station_year")


def q_ridge_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polynomial ridge, alpha in {1, 10} tuned by nested group k-fold CV per held-out year."""
    from panelcast.operators.folds import assign_blocked_folds
    from panelcast.plans.weekly import fold_metrics, ridge_nested_predictions
    from panelcast.session import cut_lineage
    assigned = assign_blocked_folds(cut_lineage(pairs(spark, sf_dir)), ("year",))
    preds, details = ridge_nested_predictions(assigned, SPEC)
    return round_doubles(fold_metrics(preds, THRESHOLD, details).drop("fit_seconds"))


def q_group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner group k-fold (5 splits) of the training years inside every held-out
    year: (outer_fold, group, inner_fold, rows)."""
    from panelcast.operators.folds import assign_blocked_folds, nested_group_folds
    from panelcast.session import cut_lineage
    assigned = assign_blocked_folds(cut_lineage(pairs(spark, sf_dir)), ("year",))
    counts = assigned.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
    return nested_group_folds(assigned, 5).join(counts, "fold").select(
        F.col("outer").alias("outer_fold"), F.col("fold").alias("group"), F.col("inner").alias("inner_fold"), "rows")


SQL_GROUP_KFOLD = "WITH RECURSIVE " + PAIRS_SQL + """,
cnt AS (SELECT CAST(target_year AS VARCHAR) AS g, count(*) AS n FROM pairs GROUP BY 1),
o AS (SELECT a.g AS outer_fold, b.g AS g, b.n AS n, row_number() OVER (PARTITION BY a.g ORDER BY b.n DESC, b.g) AS i
      FROM cnt a JOIN cnt b ON a.g <> b.g),
r AS (
  SELECT g AS outer_fold, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS load, CAST(NULL AS VARCHAR) AS g,
         CAST(NULL AS BIGINT) AS n, CAST(NULL AS INTEGER) AS j FROM cnt
  UNION ALL
  SELECT r.outer_fold, o.i, list_transform(r.load, lambda x, k: x + CASE WHEN k = list_position(r.load, list_min(r.load)) THEN o.n ELSE 0 END),
         o.g, o.n, CAST(list_position(r.load, list_min(r.load)) - 1 AS INTEGER)
  FROM r JOIN o ON o.outer_fold = r.outer_fold AND o.i = r.i + 1)
SELECT outer_fold, g AS "group", j AS inner_fold, n AS "rows" FROM r WHERE g IS NOT NULL"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "site_day_mean": q_site_day_mean,
    "weekly_pairs": q_weekly_pairs,
    "persistence_by_year": q_persistence_by_year,
    "detection_limit_clean": q_detection_limit_clean,
    "substring_feature_select": q_substring_feature_select,
    "date_parse_filter": q_date_parse_filter,
    "daily_interpolate": q_daily_interpolate,
    "shifted_target_7d": q_shifted_target_7d,
    "multi_horizon_targets": q_multi_horizon_targets,
    "blocked_split_sizes": q_blocked_split_sizes,
    "seasonal_climatology_year": q_seasonal_climatology_year,
    "seasonal_climatology_station_year": q_seasonal_climatology_station_year,
    "event_metrics_by_fold": q_event_metrics_by_fold,
    "fold_summary": q_fold_summary,
    "pooled_summary": q_pooled_summary,
    "exact_random_split": q_exact_random_split,
    "kfold_assign": q_kfold_assign,
    "fixed_sample": q_fixed_sample,
    "fold_standardize": q_fold_standardize,
    "fold_median_impute": q_fold_median_impute,
    "linear_blocked": q_linear_blocked,
    "knn_regress_year": q_knn_regress_year,
    "outlier_threshold": q_outlier_threshold,
    "random_forest_blocked": q_random_forest_blocked,
    "knn_grid_rank": q_knn_grid_rank,
    "polynomial_blocked": q_polynomial_blocked,
    "permutation_importance": q_permutation_importance,
    "shapley_values": q_shapley_values,
    "knn_permutation_importance": q_knn_permutation_importance,
    "knn_shapley_values": q_knn_shapley_values,
    "iforest_outliers": q_iforest_outliers,
    "blocked_validation_summary": q_blocked_validation_summary,
    "knn_nested_year": q_knn_nested_year,
    "knn_nested_station_year": q_knn_nested_station_year,
    "extra_trees_blocked": q_extra_trees_blocked,
    "gbt_blocked": q_gbt_blocked,
    "ann_blocked": q_ann_blocked,
    "svr_blocked": q_svr_blocked,
    "ridge_nested_year": q_ridge_nested,
    "observed_dataset": q_observed_dataset,
    "weekly_dataset": q_weekly_dataset,
    "linear_blocked_missing": q_linear_blocked_missing,
    "knn_regress_missing": q_knn_regress_missing,
    "knn_impute": q_knn_impute,
    "group_kfold": q_group_kfold,
}

ORACLE_SQL_RAW: dict[str, str] = {
    "site_day_mean": SQL_SITE_DAY_MEAN,
    "weekly_pairs": SQL_WEEKLY_PAIRS,
    "persistence_by_year": SQL_PERSISTENCE_BY_YEAR,
    "detection_limit_clean": SQL_DETECTION_LIMIT_CLEAN,
    "substring_feature_select": SQL_SUBSTRING_FEATURE_SELECT,
    "date_parse_filter": SQL_DATE_PARSE_FILTER,
    "daily_interpolate": SQL_DAILY_INTERPOLATE,
    "shifted_target_7d": SQL_SHIFTED_TARGET_7D,
    "multi_horizon_targets": SQL_MULTI_HORIZON_TARGETS,
    "blocked_split_sizes": SQL_BLOCKED_SPLIT_SIZES,
    "seasonal_climatology_year": _sql_climatology("year"),
    "seasonal_climatology_station_year": _sql_climatology("station_year"),
    "event_metrics_by_fold": SQL_EVENT_METRICS_BY_FOLD,
    "fold_summary": _summary_sql(),
    "pooled_summary": SQL_POOLED_SUMMARY,
    "exact_random_split": SQL_EXACT_RANDOM_SPLIT,
    "kfold_assign": SQL_KFOLD_ASSIGN,
    "fixed_sample": SQL_FIXED_SAMPLE,
    "fold_standardize": SQL_FOLD_STANDARDIZE,
    "fold_median_impute": SQL_FOLD_MEDIAN_IMPUTE,
    "knn_regress_year": _knn_sql(),
    "outlier_threshold": SQL_OUTLIER_THRESHOLD,
    "observed_dataset": SQL_OBSERVED_DATASET,
    "weekly_dataset": SQL_WEEKLY_DATASET,
    "linear_blocked": _linear_sql(),
    "linear_blocked_missing": _linear_missing_sql(),
    "knn_impute": _impute_sql(),
    "group_kfold": SQL_GROUP_KFOLD,
}

ORACLE_SQL: dict[str, str] = {k: sql_quantise(v) for k, v in ORACLE_SQL_RAW.items()}

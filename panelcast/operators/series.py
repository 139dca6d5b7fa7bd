"""Entity time-series operators: site-day means, consecutive pairing,
daily interpolation and shifted (future) targets.

Skew note: :func:`site_day_mean` and :func:`interpolate_daily` first reduce
the input to at most one row per (site, day) with a partially aggregated
hash aggregate, so every later window partition (a site, or a site-year)
holds at most one row per calendar day, however hot the site is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.cleaning import nan_to_null
from panelcast.functions.dates import parse_day, parse_timestamp
from panelcast.functions.labels import station_year
from panelcast.operators.select import quote


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


def site_day_mean(df: DataFrame, site: str, time: str, measures: list[str],
                  date_formats=None) -> DataFrame:
    """Mean of each measure per (site, calendar day); NULLs skipped, all-NULL -> NULL.

    Rows whose time does not parse or whose site is NULL are dropped first.
    """
    day = (parse_day(quote(time), dtype=_dtype(df, time)) if date_formats is None
           else parse_day(quote(time), formats=date_formats, dtype=_dtype(df, time)))
    base = df.select(quote(site).alias(site), day.alias(time),
                     *[nan_to_null(quote(m).cast("double")).alias(m) for m in measures])
    base = base.where(quote(site).isNotNull() & quote(time).isNotNull())
    return base.groupBy(quote(site), quote(time)).agg(*[F.avg(quote(m)).alias(m) for m in measures])


def add_total(df: DataFrame, parts: tuple[str, str] | list[str], out: str) -> DataFrame:
    """``out = part_a + part_b``; NULL if either part is NULL."""
    expr = quote(parts[0])
    for p in parts[1:]:
        expr = expr + quote(p)
    return df.withColumn(out, expr)


def weekly_pairs(obs: DataFrame, *, site: str, time: str, target: str, features: list[str],
                 nominal_horizon_days: int = 7, tolerance_days: int = 2,
                 target_out: str | None = None) -> DataFrame:
    """Pair each observation with the *next* observation of the same site.

    A pair is kept when the gap is within ``nominal +/- tolerance`` days
    (inclusive) and both target values are present.  A missing next value
    removes the pair; it does not skip ahead.  ``obs`` must hold one row per
    (site, day) (see :func:`site_day_mean`).
    """
    if nominal_horizon_days < 1:
        raise ValueError(f"nominal_horizon_days is {nominal_horizon_days}; give one day or more")
    if tolerance_days < 0 or tolerance_days >= nominal_horizon_days:
        raise ValueError(f"tolerance_days is {tolerance_days}; give 0 or more, and less than the horizon")
    lo, hi = nominal_horizon_days - tolerance_days, nominal_horizon_days + tolerance_days
    target_out = target_out or f"{target}_target"
    w = Window.partitionBy(quote(site)).orderBy(quote(time))
    nxt = F.lead(F.struct(quote(time).alias("t"), quote(target).alias("y"))).over(w)
    feats = list(dict.fromkeys(features))
    stepped = obs.select(*[quote(f) for f in dict.fromkeys(feats + [site, time, target])],
                         nxt.alias("__next"))
    gap = F.datediff(F.col("__next.t"), quote(time))
    kept = stepped.where(gap.between(lo, hi) & quote(target).isNotNull()
                         & F.col("__next.y").isNotNull())
    return kept.select(
        *[quote(f) for f in feats],
        quote(site),
        quote(time).alias("current_date"),
        F.col("__next.t").alias("target_date"),
        F.year(F.col("__next.t")).alias("target_year"),
        station_year(quote(site), F.col("__next.t")).alias("station_year"),
        F.lit(nominal_horizon_days).alias("nominal_horizon_days"),
        gap.alias("actual_horizon_days"),
        F.col("__next.y").alias(target_out),
    )


def interpolate_daily(df: DataFrame, *, time: str, values: list[str] | None = None,
                      site: str | None = None, order_by: str | None = None,
                      date_format: str | None = "M/d/yyyy", include_time_value: bool = False,
                      out_date: str = "Date", out_year: str | None = None) -> DataFrame:
    """Linear interpolation to one row per day inside each (site, calendar year).

    * Between consecutive observation days d < e of the same site-year, days
      d..e-1 get ``cur + (nxt - cur) * (offset / (e - d))``; a NULL endpoint
      gives NULL (also on the observed day).
    * The last observation day of a site-year is emitted once, unchanged (no
      fill across a year end).
    * Several rows on one day: the last one (by ``order_by``) starts the next
      segment, the first one ends the previous segment; the others vanish.
    * Unparseable times are dropped.  A NULL site is its own series.

    ``order_by`` is a unique row-order column used only to break same-day
    ties; without it ties are broken by a hash of the row.  ``out_year`` names
    a column for the year, by which (with the site) the rows already lie
    together: given to the target functions, it saves their shuffle.
    """
    dtype = _dtype(df, time)
    if values is None:
        values = [c for c in df.columns if c not in (time, site, order_by)]
    ts = parse_timestamp(quote(time), fmt=date_format, dtype=dtype)
    key_cols = [quote(site).alias("__site")] if site else []
    order = (quote(order_by).cast("long") if order_by
             else F.xxhash64(*[quote(v) for v in values]))
    # a day stays the column it is, so that rows grouped by it before need no second shuffle
    day = quote(time) if isinstance(dtype, T.DateType) else F.to_date(ts)
    base = df.select(*key_cols, ts.alias("__ts"), day.alias("__day"), order.alias("__ord"),
                     *[quote(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)])
    base = base.where(F.col("__ts").isNotNull())
    vcols = [f"__v{i}" for i in range(len(values))]
    if include_time_value:
        base = base.withColumn("__vt", F.unix_micros(F.col("__ts")).cast("double"))
        vcols.append("__vt")

    # One row per (site, day): last row (starts a segment), first row (ends one).
    group = (["__site"] if site else []) + ["__day"]
    per_day = base.groupBy(*group).agg(
        *[F.max_by(c, "__ord").alias(f"{c}_last") for c in vcols],
        *[F.min_by(c, "__ord").alias(f"{c}_first") for c in vcols],
    )
    part = ([F.col("__site")] if site else []) + [F.col("__year")]
    # a fixed number: partitions coalesced by their size before the rows become days would be too large after it
    per_day = per_day.withColumn("__year", F.year("__day")) \
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *part)
    w = Window.partitionBy(*part).orderBy("__day")
    stepped = per_day.select(
        *group, "__year",
        *[F.col(f"{c}_last") for c in vcols],
        F.lead("__day").over(w).alias("__nday"),
        *[F.lead(f"{c}_first").over(w).alias(f"{c}_next") for c in vcols],
    )
    span = F.datediff("__nday", "__day")
    offsets = F.when(F.col("__nday").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), span - 1))
    exploded = stepped.select("*", F.explode(offsets).alias("__i"), span.alias("__span"))
    last = F.col("__nday").isNull()

    def interp(c: str) -> Column:
        cur, nxt = F.col(f"{c}_last"), F.col(f"{c}_next")
        return F.when(last, cur).otherwise(cur + (nxt - cur) * (F.col("__i") / F.col("__span")))

    out = [F.date_add("__day", F.col("__i")).alias(out_date)]
    if site:
        out.append(F.col("__site").alias(site))
    if include_time_value:
        out.append(F.timestamp_micros(interp("__vt").cast("long")).alias(time))
    out += [interp(f"__v{i}").alias(v) for i, v in enumerate(values)]
    if out_year:
        out.append(F.col("__year").alias(out_year))  # no segment crosses a year end
    return exploded.select(*out)


def _lead_window(date_col: str, site: str | None, order_by: str | None, year_col: str | None = None):
    part = ([quote(site)] if site else []) + [quote(year_col) if year_col else F.year(quote(date_col))]
    order = [quote(date_col)] + ([quote(order_by)] if order_by else [])
    return Window.partitionBy(*part).orderBy(*order)


def shifted_target(df: DataFrame, target: str, *, horizon_days: int = 7, date_col: str = "Date",
                   site: str | None = None, out: str | None = None, drop_all_na: bool = False,
                   order_by: str | None = None, year_col: str | None = None) -> DataFrame:
    """Value ``horizon_days`` *rows* ahead within the same site and calendar year.

    Rows without such a target are dropped (``drop_all_na``: rows with any
    NULL).  With a site column, NULL-site rows never get a target.
    ``year_col`` names a column that holds the year of ``date_col``; it is
    used in its place and does not appear in the result.
    """
    if horizon_days < 1:
        raise ValueError(f"horizon_days is {horizon_days}; give one day or more")
    out = out or f"{target}_next_{horizon_days}_days"
    w = _lead_window(date_col, site, order_by, year_col)
    res = df.withColumn(out, F.lead(quote(target), horizon_days).over(w))
    if year_col:
        res = res.drop(year_col)
    if site:
        res = res.where(quote(site).isNotNull())
    return res.na.drop() if drop_all_na else res.where(quote(out).isNotNull())


def multi_horizon_targets(df: DataFrame, target: str, horizons: list[int], *, date_col: str = "Date",
                          site: str | None = None, out: str = "target",
                          horizon_col: str = "horizon_days", order_by: str | None = None,
                          year_col: str | None = None) -> DataFrame:
    """All horizons in one plan: one window, one ``lead`` per horizon, then a
    long table ``(horizon_days, target)`` with the rows that have a target.
    ``year_col`` as in :func:`shifted_target`."""
    hs = sorted(set(int(h) for h in horizons))
    if not hs or hs[0] < 1:
        raise ValueError(f"horizons {list(horizons)} must all be whole days, one or more")
    w = _lead_window(date_col, site, order_by, year_col)
    wide = df.select("*", *[F.lead(quote(target), h).over(w).alias(f"__h{h}") for h in hs])
    if site:
        wide = wide.where(quote(site).isNotNull())
    pairs = ", ".join(f"{h}, `__h{h}`" for h in hs)
    keep = [quote(c) for c in df.columns if c != year_col]
    long = wide.select(*keep, F.expr(f"stack({len(hs)}, {pairs}) as (`{horizon_col}`, `{out}`)"))
    return long.where(quote(out).isNotNull())

"""Fold-local preprocessing statistics for every blocked fold at once.

Training rows of fold ``f`` are "all rows but group f".  Additive statistics
(count, sum, sum of squares) are obtained as total minus the fold's share;
medians, which are not additive, come from bucket counts and an exact
order-statistic identity inside the few buckets that matter (see
:func:`complement_median`).  Neither builds a per-fold copy of the training
data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.select import quote
from panelcast.session import cut_lineage


def long_values(assigned: DataFrame, features: list[str], id_cols: list[str],
                keep_null: bool = False) -> DataFrame:
    """(split_type, fold, *id_cols, feature, value) for every (non-NULL) value."""
    stacked = F.expr("stack({n}, {pairs}) as (feature, value)".format(
        n=len(features),
        pairs=", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)))
    long = assigned.select("split_type", "fold", *[quote(c) for c in id_cols], stacked)
    return long if keep_null else long.where(F.col("value").isNotNull())


EPS = 2.220446049250313e-16


def complement_moments(assigned: DataFrame, features: list[str],
                       medians: DataFrame | None = None) -> DataFrame:
    """(split_type, fold, feature, n, mean, sd) of the rows *outside* each fold.

    Sums are taken around the split-wide mean, so large offsets do not cancel.
    Without ``medians`` NULLs are left out; with them (split_type, fold,
    feature, median) a NULL counts as the fold's training median, as a scaler
    behind an imputer sees it.  ``sd`` (population) of a constant column is 1.
    """
    long = long_values(assigned, features, [], keep_null=True)
    keys = ["split_type", "feature"]
    centre = long.groupBy(*keys).agg(F.avg("value").alias("c"))
    d = F.col("value") - F.col("c")
    # one row per split type and feature: a plain join would send all their values to one task
    per = long.join(F.broadcast(centre), keys).groupBy("split_type", "fold", "feature", "c").agg(
        F.count("value").alias("n_f"), F.sum(d).alias("s_f"), F.sum(d * d).alias("q_f"),
        F.count_if(F.col("value").isNull()).alias("m_f"))
    total = per.groupBy(*keys).agg(*[F.sum(f"{x}_f").alias(f"{x}_all") for x in "nsqm"])
    left = per.join(F.broadcast(total), keys)
    rest = {x: F.coalesce(F.col(f"{x}_all"), F.lit(0)) - F.coalesce(F.col(f"{x}_f"), F.lit(0)) for x in "nsqm"}
    n, s, q = rest["n"], rest["s"], rest["q"]
    if medians is not None:
        left = left.join(medians.select("split_type", "fold", "feature", "median"),
                         ["split_type", "fold", "feature"], "left")
        med = F.coalesce("median", F.lit(0.0)) - F.coalesce("c", F.lit(0.0))
        n, s, q = n + rest["m"], s + rest["m"] * med, q + rest["m"] * med * med
    shift = s / n
    mean = F.coalesce("c", F.lit(0.0)) + shift
    var = F.greatest(q / n - shift * shift, F.lit(0.0))
    constant = var <= n * EPS * var + F.pow(n * mean * EPS, F.lit(2.0))
    return left.select("split_type", "fold", "feature", n.alias("n"),
                       F.when(n > 0, mean).alias("mean"),
                       F.when(n > 0, F.when(constant, F.lit(1.0)).otherwise(F.sqrt(var))).alias("sd"))


def bucket_count(rows: int, per_bucket: int = 200_000, least: int = 64, most: int = 4096) -> int:
    """Rank buckets for a table of ``rows`` rows: tasks grow with the data."""
    return max(least, min(most, -(-rows // per_bucket)))


def _middle_buckets(folds: DataFrame, total: DataFrame) -> DataFrame:
    """(split_type, feature, fold, __b, k, r): the buckets that hold the middle training values of each fold.

    ``total`` has a row per bucket, a bounded number, and goes to every task;
    ``folds`` has each fold's own counts.  The training values up to a bucket are
    those of all rows less the fold's own, so the bucket of place k is found by
    bisection, and no row per fold and bucket is made.
    """
    kinds: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for t in total.collect():
        kinds.setdefault((t["split_type"], t["feature"]), []).append((t["__b"], t["n_b"]))
    at = {kind: i for i, kind in enumerate(kinds)}
    lists = [sorted(v) for v in kinds.values()]
    bucket = np.array([b for v in lists for b, _ in v], dtype=np.int64)
    upto = np.array([c for v in lists for c in np.cumsum([n for _, n in v])], dtype=np.int64)
    ends = np.cumsum([0, *[len(v) for v in lists]])
    span = int(bucket.max(initial=0)) + 1
    key = np.repeat(np.arange(len(lists)), np.diff(ends)) * span + bucket
    wide = len(bucket) + 1
    held = total.sparkSession.sparkContext.broadcast((at, bucket, upto, ends, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket, upto, ends, key = held.value
        for b in batches:
            kind = np.array([at.get(t, -1) for t in zip(b.column("split_type").to_pylist(), b.column("feature").to_pylist())], dtype=np.int64)
            b, kind = b.filter(pa.array(kind >= 0)), kind[kind >= 0]
            own = b.column("own")
            n_own = np.nan_to_num(pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            cells = own.flatten()
            row = np.repeat(np.arange(len(kind)), n_own)
            place = row * wide + np.searchsorted(key, kind[row] * span + cells.field(0).to_numpy(zero_copy_only=False))
            order = np.argsort(place)
            place, sums = place[order], np.concatenate([[0], np.cumsum(cells.field(1).to_numpy(zero_copy_only=False)[order])]).astype(np.int64)
            first, last = ends[kind], ends[kind + 1] - 1
            base = np.arange(len(kind)) * wide
            start = sums[np.searchsorted(place, base)]

            def training(j: np.ndarray) -> np.ndarray:
                """Training values of each row's fold in its buckets up to j."""
                return np.where(j < first, 0, upto[j] - (sums[np.searchsorted(place, base + j, side="right")] - start))

            n = training(last)
            found = []
            for k in ((n - 1) // 2, n // 2):
                lo, hi = first.copy(), last.copy()
                while (lo < hi).any():
                    mid = (lo + hi) // 2
                    enough = training(mid) > k
                    hi, lo = np.where(enough, mid, hi), np.where(enough, lo, np.minimum(mid + 1, hi))
                found.append((k, lo, k - training(lo - 1)))
            for (k, j, r), kept in zip(found, (n > 0, (n > 0) & (n % 2 == 0))):  # with an odd count both places are the same one
                some = b.filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [some.column("split_type"), some.column("feature"), some.column("fold"), pa.array(bucket[j[kept]]), pa.array(k[kept]),
                     pa.array(r[kept])], ["split_type", "feature", "fold", "__b", "k", "r"])

    return folds.select("split_type", "feature", "fold", "own").mapInArrow(
        run, "split_type string, feature string, fold string, __b long, k long, r long")


def complement_median(assigned: DataFrame, features: list[str], id_cols: list[str]) -> DataFrame:
    """(split_type, fold, feature, median) of the values outside each fold; an
    all-missing training column gets 0.0.

    Two steps.  Counts per value bucket, for all rows and for each fold, tell
    in which bucket a fold's middle values lie and which rank r they have there
    among the values of other folds.  Only those buckets are sorted: a value at
    place g of its bucket and place j among its own fold's values there has
    g - j values of other folds before it, so the wanted one stands at place
    r + #{own values with g - j <= r}.
    """
    by = ["split_type", "feature"]
    long = long_values(assigned, features, id_cols)
    long = long.withColumn("__h", F.xxhash64(*[quote(c) for c in id_cols]))
    buckets = bucket_count(assigned.count())
    long, bucket = with_value_buckets(long, by, buckets=buckets)
    rows = long.select(*by, "fold", "value", "__h", *[quote(c) for c in id_cols], bucket.alias("__b"))
    per = cut_lineage(rows.groupBy(*by, "fold", "__b").agg(F.count(F.lit(1)).alias("n_f")))
    total = per.groupBy(*by, "__b").agg(F.sum("n_f").alias("n_b"))
    folds = assigned.select("split_type", "fold").distinct().select(
        "*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    own_counts = per.groupBy(*by, "fold").agg(F.collect_list(F.struct("__b", "n_f")).alias("own"))
    targets = cut_lineage(_middle_buckets(folds.join(own_counts, [*by, "fold"], "left"), total))
    order = [F.col("value"), F.col("__h"), *[quote(c) for c in id_cols]]
    # at most all buckets
    near = rows.join(F.broadcast(targets.select(*by, "__b").distinct()), [*by, "__b"], "left_semi")
    placed = near.withColumn("g", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1) \
        .withColumn("j", F.row_number().over(Window.partitionBy(*by, "__b", "fold").orderBy(*order)) - 1) \
        .select(*by, "__b", "fold", "value", F.col("g").cast("long").alias("g"), "j")
    placed = cut_lineage(placed)
    own = placed.select(*by, "__b", "fold", (F.col("g") - F.col("j")).alias("d"))
    at = targets.join(own, [*by, "__b", "fold"], "left").groupBy(*by, "fold", "__b", "k", "r").agg(
        F.count_if(F.col("d") <= F.col("r")).alias("m"))
    found = at.select(*by, "fold", "__b", "k", (F.col("r") + F.col("m")).alias("g")) \
        .join(placed.select(*by, "__b", "g", "value"), [*by, "__b", "g"])
    # one or two middle values per fold; with an odd count both ranks are the same one
    middle = found.groupBy("split_type", "feature", "fold").agg(F.avg("value").alias("median"))
    return folds.join(middle, ["split_type", "feature", "fold"], "left").select(
        "split_type", "fold", "feature", F.coalesce("median", F.lit(0.0)).alias("median"))


HASH_SPAN = 18446744073709551616.0  # 2**64
HASH_SHIFT = 9223372036854775808.0  # 2**63


def with_value_buckets(long: DataFrame, by: list[str], value: str = "value", h: str = "__h",
                       buckets: int = 64) -> tuple[DataFrame, Column]:
    """Attach approximate quantile cut points per ``by`` group (a table of
    ``groups x buckets`` numbers, broadcast) and return a bucket expression
    monotone in the order ``(value, h)``.

    bucket = lo * B + r, lo = #cuts below the value.  A value equal to ``e``
    cut points (a hot value holding many rows) is spread over ``e + 1``
    sub-buckets by its hash ``h``, so even a value held by a third of all
    rows is ranked by many tasks.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = long.groupBy(*by).agg(F.percentile_approx(value, probs, 10000).alias("__cuts"))
    out = long.join(F.broadcast(cuts), by)
    v = F.col(value)
    # by bisection: the cut points are sorted, and their number grows with the rows
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    lo = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) < v, at + step).otherwise(at))
    eq = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) <= v, at + step).otherwise(at)) - lo
    u = (F.col(h).cast("double") + F.lit(HASH_SHIFT)) / F.lit(HASH_SPAN)
    r = F.least(F.floor(u * (eq + 1)), eq.cast("long"))
    return out, (lo.cast("long") * F.lit(buckets) + r).cast("long")


def impute_with(assigned: DataFrame, features: list[str], medians: DataFrame) -> DataFrame:
    """Each test row's NULL features replaced by its own fold's training median."""
    wide = medians.groupBy("split_type", "fold").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"__med_{i}") for i, f in enumerate(features)])
    at = {f: i for i, f in enumerate(features)}
    out = assigned.join(wide, ["split_type", "fold"], "left")
    return out.select(*[
        F.coalesce(quote(c).cast("double"), F.col(f"__med_{at[c]}"), F.lit(0.0)).alias(c) if c in at else quote(c)
        for c in assigned.columns])

"""Column outlier flags: exact contamination threshold and per-column report.

A value is an outlier when its score is strictly below the
``contamination`` percentile (linear interpolation between order
statistics) of all scores of its column.  The percentile is exact and
distributed: approximate quantiles on both sides of the wanted rank bracket it,
one pass counts what lies below and between, and only the distinct values in
the bracket are sorted; a bracket that holds too many is narrowed again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ranking import md5_bucket, md5_key
from panelcast.operators.select import quote
from panelcast.session import cut_lineage

SORTED_VALUES = 200_000  # values of a bracket that are sorted
BRACKET = 0.001          # share of the values on either side of the wanted rank


def unpivot_measures(df: DataFrame, columns: list[str], id_cols: list[str]) -> DataFrame:
    """(id..., column, value) for every cell of the listed columns (NULLs kept)."""
    stacked = F.expr("stack({n}, {pairs}) as (`column`, value)".format(
        n=len(columns), pairs=", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)))
    return df.select(*[quote(c) for c in id_cols], stacked)


def exact_percentile(long: DataFrame, by: list[str], value: str, q: float, id_cols: list[str] | None = None,
                     out: str = "threshold") -> DataFrame:
    """Per ``by`` group (few of them): the ``q`` quantile of ``value`` with linear interpolation
    (NumPy's default).  NULL values are ignored; ``id_cols`` are not needed any more."""
    v = long.where(quote(value).isNotNull()).select(*by, quote(value).cast("double").alias("v"))
    group = F.struct(*by)
    rows = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(group.alias("g"), "n").collect()  # one row per group
    # per group: a bracket [low, high], values below it and inside it
    state = {r["g"]: [-math.inf, math.inf, 0, r["n"], r["n"]] for r in rows}
    wide = {g for g, (_, _, _, inside, _) in state.items() if inside > SORTED_VALUES}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.select(*by).schema)

    def inside(groups) -> DataFrame:
        table = long.sparkSession.createDataFrame([(*g, *state[g][:2]) for g in groups], f"{kinds}, low double, high double")
        return v.join(F.broadcast(table), by).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    while wide:
        spread = {}
        for g in wide:
            low, high, below, held, n = state[g]
            r = (q * (n - 1) - below) / max(held - 1, 1)
            spread[g] = [min(max(r + e, 0.0), 1.0) for e in (-BRACKET, BRACKET)]
        # one sketch of all quantiles that any group asks for
        every = sorted({p for pair in spread.values() for p in pair})
        cuts = inside(wide).groupBy(*by).agg(F.percentile_approx("v", every, 20_000).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        ends = {}
        for r in cuts.select(group.alias("g"), "c", "least", "most").collect():
            p0, p1 = spread[r["g"]]
            ends[r["g"]] = (r["least"] if p0 == 0.0 else r["c"][every.index(p0)], r["most"] if p1 == 1.0 else r["c"][every.index(p1)])
        table = long.sparkSession.createDataFrame([(*g, *e) for g, e in ends.items()], f"{kinds}, c0 double, c1 double")
        counted = v.join(F.broadcast(table), by).groupBy(*by).agg(
            F.count_if(F.col("v") < F.col("c0")).alias("below"), F.count_if((F.col("v") >= F.col("c0")) & (F.col("v") <= F.col("c1"))).alias("held"))
        for r in counted.select(group.alias("g"), "below", "held").collect():
            g, (c0, c1) = r["g"], ends[r["g"]]
            n, pos = state[g][4], q * (state[g][4] - 1)
            hit = r["below"] <= math.floor(pos) and math.ceil(pos) < r["below"] + r["held"]
            # a miss of the sketch, or a bracket that cannot shrink (one value, or as many as before), is sorted as it is
            done = not hit or c0 == c1 or r["held"] <= SORTED_VALUES or r["held"] >= state[g][3]
            if hit:
                state[g][:4] = [c0, c1, r["below"], r["held"]]
            if done:
                wide.discard(g)
    found = inside(list(state)) if state else v.limit(0).withColumns({"low": F.lit(0.0), "high": F.lit(0.0)})
    counts = found.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("m"))
    before = long.sparkSession.createDataFrame([(*g, st[2], float(q * (st[4] - 1))) for g, st in state.items()], f"{kinds}, below long, pos double")
    placed = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy("v"))).join(F.broadcast(before), by) \
        .withColumns({"first": F.col("below") + F.col("upto") - F.col("m"), "last": F.col("below") + F.col("upto") - 1})
    at = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col("v")))
    lo, hi = at(F.floor("pos")), at(F.ceil("pos"))
    return placed.groupBy(*by).agg((lo + (hi - lo) * F.max(F.col("pos") - F.floor("pos"))).alias(out))


def zscore_score(value: Column, mean: Column, sd: Column) -> Column:
    """Deterministic outlier score: ``-|z|`` (population SD)."""
    return -F.abs((value - mean) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))


def flag_outliers(df: DataFrame, columns: list[str], id_cols: list[str], *,
                  contamination: float = 0.005, scores: DataFrame | None = None, scored: DataFrame | None = None):
    """Set outlying cells to NULL; return (filtered frame, report).

    ``scores`` (id..., column, score) may come from any scorer; ``scored`` is ``df`` with the
    columns ``__score_0``, ... (as from ``isolation_forest_columns``), which needs no join; by
    default the z-score twin is used.  The report has one row per column: original_non_nan,
    filtered_non_nan, outliers.
    """
    if scored is not None:
        def score(i: int) -> Column:
            return F.col(f"__score_{i}")
    elif scores is None:
        stats = df.agg(*[f(quote(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns)
                         for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # two numbers per column
        def score(i: int) -> Column:
            return zscore_score(quote(columns[i]).cast("double"), F.lit(stats[f"m{i}"]).cast("double"),
                                F.lit(stats[f"s{i}"]).cast("double"))
        scored = df
    else:
        wide = scores.groupBy(*[quote(c) for c in id_cols]).agg(
            *[F.max(F.when(F.col("column") == c, F.col("score"))).alias(f"__score_{i}") for i, c in enumerate(columns)])
        scored = df.join(wide, id_cols, "left")
        def score(i: int) -> Column:
            return F.col(f"__score_{i}")
    scored = cut_lineage(scored.select("*", *[score(i).alias(f"__sc_{i}") for i in range(len(columns))]))
    long = scored.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__sc_{i}").alias("score")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    limit = {r["column"]: r["threshold"] for r in exact_percentile(long, ["column"], "score", contamination).collect()}  # one number per column
    def out(i: int) -> Column:
        return F.coalesce(F.col(f"__sc_{i}") < F.lit(limit.get(columns[i])).cast("double"), F.lit(False))
    at = {c: i for i, c in enumerate(columns)}
    filtered = scored.select(*[F.when(~out(at[c]), quote(c)).alias(c) if c in at else quote(c) for c in df.columns])
    report = scored.agg(*[x.alias(f"{n}{i}") for i, c in enumerate(columns) for n, x in (
        ("a", F.count(quote(c))), ("b", F.count_if(quote(c).isNotNull() & ~out(i))), ("o", F.count_if(out(i))))])
    report = report.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"a{i}").alias("original_non_nan"), F.col(f"b{i}").alias("filtered_non_nan"),
        F.col(f"o{i}").alias("outliers"), F.lit(limit.get(c)).cast("double").alias("threshold"))
        for i, c in enumerate(columns)])).alias("x")).select("x.*")
    return filtered, report


# ------------------------------------------------------------ isolation forest
EULER_GAMMA = 0.5772156649015329


def average_path_length(n):
    """Expected path length of an unsuccessful search in a binary tree of n points."""
    import numpy as np
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _tree_seed(seed: int, column: str, tree: int) -> int:
    import hashlib
    return int(hashlib.md5(f"{seed}:{column}:{tree}".encode()).hexdigest()[:12], 16)


def _build_tree(values, max_depth: int, rng):
    """1-D isolation tree -> (sorted thresholds, path length of each leaf
    interval).  A split draws t uniformly in [min, max); x <= t goes left."""
    import numpy as np
    stack = [(np.sort(values), 0, None)]
    out = []
    while stack:
        v, depth, upper = stack.pop()
        lo, hi = v[0], v[-1]
        if depth >= max_depth or len(v) <= 1 or lo == hi:
            out.append((upper, depth + float(average_path_length([len(v)])[0])))
            continue
        t = rng.uniform(lo, hi)
        if t >= hi:
            t = lo
        k = int(np.searchsorted(v, t, side="right"))
        # push right first so leaves come out left to right
        stack.append((v[k:], depth + 1, upper))
        stack.append((v[:k], depth + 1, t))
    thresholds = [u for u, _ in out if u is not None]
    lengths = [h for _, h in out]
    return np.array(thresholds, dtype=float), np.array(lengths, dtype=float)


def _sampled(df: DataFrame, columns: list[str], id_cols: list[str], n_trees: int, max_samples: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """((column, tree, value) of every tree's places in hash order, values per column).

    Only cells of the hash buckets that hold a wanted place are ranked.
    """
    import numpy as np
    import pandas as pd

    long = unpivot_measures(df, columns, id_cols).where(F.col("value").isNotNull())
    cells = cut_lineage(long.withColumn("__h", md5_key(seed, F.col("column"), *id_cols)).withColumn("__b", md5_bucket("__h")))
    sizes = cells.groupBy("column", "__b").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("column").orderBy("__b"))  # at most 65,536 buckets a column
    ends = cut_lineage(sizes.select("column", "__b", (upto - F.col("m")).alias("before"), upto.alias("upto")))
    counts = {r["column"]: r["n"] for r in ends.groupBy("column").agg(F.max("upto").alias("n")).collect()}
    tasks = df.sparkSession.createDataFrame([(c, t, n) for c, n in counts.items() for t in range(n_trees)], "column string, tree int, n long")

    def places(frames):
        for pdf in frames:
            for c, t, n in zip(pdf["column"], pdf["tree"], pdf["n"]):
                psi = min(max_samples, n)
                rng = np.random.default_rng(_tree_seed(seed, c, t))
                got: dict[int, None] = {}  # distinct places in the order drawn, without a list of all n
                while len(got) < psi:
                    got |= dict.fromkeys(rng.integers(0, n, psi - len(got)).tolist())
                yield pd.DataFrame({"column": c, "tree": t, "__pos": list(got)})

    picked = cut_lineage(tasks.mapInPandas(places, "column string, tree int, __pos long"))  # columns x trees x psi rows
    # the bucket of every place: the last one that begins at or before it
    marks = ends.select("column", F.col("before").alias("at"), "__b", F.lit(None).cast("long").alias("__pos"), F.lit(None).cast("int").alias("tree")) \
        .unionByName(picked.select("column", F.col("__pos").alias("at"), F.lit(None).cast("int").alias("__b"), "__pos", "tree"))
    w = Window.partitionBy("column").orderBy("at", F.col("__pos").isNotNull())
    wanted = marks.withColumn("__bucket", F.last("__b", ignorenulls=True).over(w)).where(F.col("__pos").isNotNull()) \
        .select("column", "tree", "__pos", F.col("__bucket").alias("__b"))
    wanted = cut_lineage(wanted.join(ends.select("column", "__b", "before"), ["column", "__b"]))
    near = cells.join(F.broadcast(wanted.select("column", "__b").distinct()), ["column", "__b"], "left_semi")
    order = Window.partitionBy("column", "__b").orderBy("__h", *[quote(c) for c in id_cols])
    ranked = near.select("column", "__b", "value", (F.row_number().over(order) - 1).cast("long").alias("__r"))
    sample = wanted.withColumn("__r", F.col("__pos") - F.col("before")).join(ranked, ["column", "__b", "__r"])
    return sample.select("column", "tree", "value"), counts


def fit_isolation_forest(df: DataFrame, columns: list[str], id_cols: list[str], *, n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> dict:
    """column -> (thresholds, mean path length of each interval, normaliser): one 1-D forest per column.

    Each tree of a column draws psi = min(max_samples, n) seeded distinct
    places in [0, n) and takes the values that stand there in hash order, so
    every size of data is sampled in the same way.
    """
    import numpy as np
    import pandas as pd

    sample, counts = _sampled(df, columns, id_cols, n_trees, max_samples, seed)
    max_depth = int(math.ceil(math.log2(max(max_samples, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        col, tree = pdf["column"].iloc[0], int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([_tree_seed(seed, col, tree), 1])
        thr, lens = _build_tree(pdf["value"].to_numpy(float), max_depth, rng)
        return pd.DataFrame({"column": [col], "tree": [tree], "thr": [thr.tolist()],
                             "len": [lens.tolist()]})

    # the forest: at most n_trees * psi thresholds per column (bounded model), fetched once
    trees = sample.groupBy("column", "tree").applyInPandas(
        build, "column string, tree int, thr array<double>, len array<double>").collect()
    forest = {}
    for col, n in counts.items():
        rows = sorted((r for r in trees if r["column"] == col), key=lambda r: r["tree"])
        allthr = np.unique(np.concatenate([np.asarray(r["thr"]) for r in rows]))
        reps = np.append(allthr, np.inf)
        total = np.zeros(len(reps))
        for r in rows:
            total += np.asarray(r["len"])[np.searchsorted(np.asarray(r["thr"]), reps, side="left")]
        c = float(average_path_length([min(max_samples, n)])[0])
        forest[col] = (allthr, total / len(rows), c if c > 0 else 1.0)

    return forest


def isolation_forest_columns(df: DataFrame, columns: list[str], id_cols: list[str], **options) -> DataFrame:
    """``df`` with ``__score_0``, ...: -2**(-E[h(x)] / c(psi)) per listed column (lower = more anomalous, like
    ``score_samples``), NULL where the value is missing."""
    import numpy as np
    import pyarrow as pa

    model = df.sparkSession.sparkContext.broadcast(fit_isolation_forest(df, columns, id_cols, **options))
    names = df.columns
    held = df.withColumns({f"__v{i}": quote(c).cast("double") for i, c in enumerate(columns)})

    def score(batches):
        for b in batches:
            out = list(b.columns[:len(names)])
            for i, c in enumerate(columns):
                value = b.column(len(names) + i)
                x = value.to_numpy(zero_copy_only=False)
                if c not in model.value:
                    out.append(pa.nulls(len(x), pa.float64()))
                    continue
                thr, mean_len, norm = model.value[c]
                s = -np.power(2.0, -mean_len[np.searchsorted(thr, x, side="left").clip(max=len(mean_len) - 1)] / norm)
                out.append(pa.array(s, pa.float64(), mask=value.is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(out, [*names, *[f"__score_{i}" for i in range(len(columns))]])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"__score_{i} double" for i in range(len(columns))]
    return held.mapInArrow(score, ", ".join(kinds))


def isolation_forest_scores(df: DataFrame, columns: list[str], id_cols: list[str], **options) -> DataFrame:
    """(id..., column, score) for every value, as rows."""
    wide = isolation_forest_columns(df, columns, id_cols, **options)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__score_{i}").alias("score")) for i, c in enumerate(columns)]))
    return wide.select(*[quote(c) for c in id_cols], cells.alias("x")).select(*[quote(c) for c in id_cols], "x.*").where(F.col("score").isNotNull())

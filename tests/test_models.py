"""Fold-local models against NumPy brute force."""

import numpy as np
from pyspark.sql import functions as F

from panelcast.operators.foldstats import complement_median
from panelcast.operators.linear import fit_blocked_linear


def _fixture(spark, with_nulls=False):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(4):
        for i in range(25):
            x = rng.normal(size=3) * [1.0, 10.0, 0.1]
            y = 1.5 + x @ [2.0, -0.3, 5.0] + rng.normal() * 0.1
            xs = [float(v) for v in x]
            if with_nulls and (i % 7 == 0):
                xs[i % 3] = None
            rows.append((str(g), f"r{g}_{i}", *xs, float(y)))
    df = spark.createDataFrame(rows, "fold string, rid string, a double, b double, c double, y double")
    return df.withColumn("split_type", F.lit("year"))


def _np_fit(pdf, f, feats, alpha=0.0):
    tr = pdf[pdf.fold != f]
    X = tr[feats].to_numpy(dtype=float)
    med = np.nanmedian(X, axis=0)
    X = np.where(np.isnan(X), med, X)
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1
    Z = (X - mu) / sd
    yc = tr.y.to_numpy() - tr.y.mean()
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(len(feats)), Z.T @ yc)
    beta = w / sd
    return beta, tr.y.mean() - mu @ beta


def test_blocked_ols_and_ridge_match_numpy(spark):
    feats = ["a", "b", "c"]
    df = _fixture(spark, with_nulls=True)
    pdf = df.toPandas()
    meds = complement_median(df, feats, ["rid"])
    for alpha in (0.0, 10.0):
        coefs = {r["fold"]: r for r in fit_blocked_linear(df, feats, "y", alpha=alpha,
                                                          medians=meds).collect()}
        for f in ["0", "1", "2", "3"]:
            beta, b0 = _np_fit(pdf, f, feats, alpha)
            got = np.array([coefs[f][f"b_{i}"] for i in range(3)])
            assert np.allclose(got, beta, rtol=1e-7, atol=1e-9)
            assert abs(coefs[f]["b0"] - b0) < 1e-7


def test_complement_median_matches_numpy(spark):
    df = _fixture(spark, with_nulls=True)
    pdf = df.toPandas()
    got = {(r["fold"], r["feature"]): r["median"]
           for r in complement_median(df, ["a", "b", "c"], ["rid"]).collect()}
    for f in ["0", "1", "2", "3"]:
        for c in ["a", "b", "c"]:
            assert abs(got[(f, c)] - np.nanmedian(pdf[pdf.fold != f][c].to_numpy(dtype=float))) < 1e-12


def _np_knn(pdf, feats, sds, k, p, weights):
    preds = {}
    for f in pdf.fold.unique():
        tr, te = pdf[pdf.fold != f], pdf[pdf.fold == f]
        X, Q = tr[feats].to_numpy(float), te[feats].to_numpy(float)
        s = np.array([sds[(f, c)] for c in feats])
        diff = np.abs(Q[:, None, :] - X[None, :, :]) / s
        dist = diff.sum(-1) if p == 1 else np.sqrt((diff ** 2).sum(-1))
        for qi, rid in enumerate(te.rid):
            order = np.lexsort((tr.rid.to_numpy(), dist[qi]))[:k]
            dd, yy = dist[qi][order], tr.y.to_numpy()[order]
            if weights == "uniform":
                preds[(f, rid)] = yy.mean()
            elif (dd == 0).any():
                preds[(f, rid)] = yy[dd == 0].mean()
            else:
                preds[(f, rid)] = (yy / dd).sum() / (1 / dd).sum()
    return preds


def test_knn_exact_against_brute_force(spark):
    from panelcast.operators.foldstats import complement_moments
    from panelcast.operators.knn import knn_neighbours, knn_predict
    feats = ["a", "b", "c"]
    df = _fixture(spark)
    pdf = df.toPandas()
    mom = complement_moments(df, feats)
    sds = {(r["fold"], r["feature"]): r["sd"] for r in mom.collect()}
    for p, cap in ((1, 200_000), (2, 200_000), (2, 40)):
        # cap=40 forces salted (split) kernel tasks: results must not change
        nn = knn_neighbours(df, feats, "y", ["rid"], mom, k_max=11, p=p, max_group_rows=cap).cache()
        for k, wts in ((3, "uniform"), (11, "distance")):
            got = {(r["fold"], r["rid"]): r["y_pred"] for r in knn_predict(nn, k, wts).collect()}
            want = _np_knn(pdf, feats, sds, k, p, wts)
            assert set(got) == set(want)
            assert max(abs(got[key] - want[key]) for key in want) < 1e-9


def test_permutation_importance_matches_numpy(spark):
    import hashlib
    from panelcast.operators.explain import linear_predictor, permutation_importance
    df = _fixture(spark).where("fold = '0'")
    pdf = df.toPandas()
    beta, b0 = {"a": 2.0, "b": -0.3, "c": 5.0}, 1.5
    got = {r["feature"]: r for r in permutation_importance(
        df, ["a", "b", "c"], "y", ["rid"], linear_predictor(beta, b0), n_repeats=4, seed=3).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    ids = sorted(pdf.rid, key=lambda r: (md5(f"3:{r}"), r))
    X = pdf.set_index("rid").loc[ids]
    pred = lambda M: b0 + M.a * beta["a"] + M.b * beta["b"] + M.c * beta["c"]
    base = ((pred(X) - X.y) ** 2).mean()
    for f in ("a", "b", "c"):
        imps = []
        for r in range(4):
            donor = sorted(pdf.rid, key=lambda i: (md5(f"3:{f}:{r}:{i}"), i))
            M = X.copy()
            M[f] = pdf.set_index("rid").loc[donor][f].to_numpy()
            imps.append(((pred(M) - M.y) ** 2).mean() - base)
        assert abs(got[f]["importance_mean"] - np.mean(imps)) < 1e-9
        assert abs(got[f]["importance_std"] - np.std(imps)) < 1e-9


def test_linear_shapley_sums_to_prediction_gap(spark):
    from panelcast.operators.explain import linear_shapley
    df = _fixture(spark).where("fold = '1'")
    beta = {"a": 2.0, "b": -0.3, "c": 5.0}
    long = linear_shapley(df, ["a", "b", "c"], ["rid"], beta).toPandas()
    pdf = df.toPandas().set_index("rid")
    for f in beta:
        sub = long[long.feature == f].set_index("rid")
        want = beta[f] * (pdf[f] - pdf[f].mean())
        assert np.allclose(sub.shap_value.sort_index(), want.sort_index(), atol=1e-12)


def _comp_sds(pdf, feats):
    out = {}
    for f in pdf.fold.unique():
        rest = pdf[pdf.fold != f]
        for c in feats:
            s = rest[c].to_numpy(float).std()
            out[(f, c)] = s if s > 0 else 1.0
    return out


def test_nested_knn_tuning_matches_numpy(spark):
    import datetime as dt

    from panelcast.operators.knn import parameter_grid
    from panelcast.plans.weekly import PanelSpec, knn_nested_predictions
    feats = ["a", "b", "c"]
    df = _fixture(spark)
    df = (df.withColumnRenamed("rid", "site").withColumn("current_date", F.lit(dt.date(2020, 1, 1)))
          .withColumn("t_target", F.col("y")).withColumn("target_date", F.lit(dt.date(2020, 1, 8)))
          .withColumn("target_year", F.col("fold").cast("int"))
          .withColumn("station_year", F.col("fold")).withColumn("nominal_horizon_days", F.lit(7))
          .withColumn("actual_horizon_days", F.lit(7)))
    spec = PanelSpec(site="site", time="current_date", target="t", features=feats)
    grid = {"n_neighbors": [3, 5], "weights": ["uniform", "distance"], "p": [1, 2]}
    preds, details = knn_nested_predictions(df, spec, split_type="year", inner_cv=5, param_grid=grid)
    got = {(r["fold"], r["site"]): r["y_pred"] for r in preds.collect()}
    pdf = df.select("fold", F.col("site").alias("rid"), *feats, "y").toPandas()
    cands = parameter_grid(grid)
    for f in sorted(pdf.fold.unique()):
        sub = pdf[pdf.fold != f].copy()
        scores = []
        for g in cands:
            want = _np_knn(sub, feats, _comp_sds(sub, feats), g["n_neighbors"], g["p"], g["weights"])
            se = {}
            for (ff, rid), v in want.items():
                yv = float(sub[sub.rid == rid].y.iloc[0])
                se.setdefault(ff, []).append((v - yv) ** 2)
            scores.append(np.mean([np.mean(v) for v in se.values()]))
        best = cands[int(np.argmin(scores))]
        both = pdf[(pdf.fold == f) | (pdf.fold != f)].copy()
        both["fold"] = np.where(both.fold == f, "test", "train")
        sds = _comp_sds(both, feats)
        want = _np_knn(both, feats, sds, best["n_neighbors"], best["p"], best["weights"])
        for (ff, rid), v in want.items():
            if ff == "test":
                assert abs(got[(f, rid)] - max(v, 0.0)) < 1e-9
    assert details.count() == 4


def test_nested_ridge_tuning_matches_numpy(spark):
    import datetime as dt

    from panelcast.plans.weekly import PanelSpec, ridge_nested_predictions
    feats = ["a", "b", "c"]
    df = _fixture(spark)
    df = (df.withColumnRenamed("rid", "site").withColumn("current_date", F.lit(dt.date(2020, 1, 1)))
          .withColumn("t_target", F.col("y")).withColumn("target_date", F.lit(dt.date(2020, 1, 8)))
          .withColumn("target_year", F.col("fold").cast("int"))
          .withColumn("station_year", F.col("fold")).withColumn("nominal_horizon_days", F.lit(7))
          .withColumn("actual_horizon_days", F.lit(7)))
    spec = PanelSpec(site="site", time="current_date", target="t", features=feats)
    preds, _ = ridge_nested_predictions(df, spec, split_type="year", alphas=(1.0, 10.0))
    got = {(r["fold"], r["site"]): r["y_pred"] for r in preds.collect()}
    pdf = df.select("fold", F.col("site").alias("rid"), *feats, "y").toPandas()
    names = list(feats)
    for i, a in enumerate(feats):
        for b in feats[i:]:
            n = f"{a}*{b}" if a != b else f"{a}^2"
            pdf[n] = pdf[a] * pdf[b]
            names.append(n)
    for f in sorted(pdf.fold.unique()):
        sub = pdf[pdf.fold != f]
        scores = []
        for alpha in (1.0, 10.0):
            mses = []
            for j in sorted(sub.fold.unique()):
                beta, b0 = _np_fit(sub, j, names, alpha)
                te = sub[sub.fold == j]
                mses.append((((te[names].to_numpy() @ beta + b0) - te.y) ** 2).mean())
            scores.append(np.mean(mses))
        alpha = (1.0, 10.0)[int(np.argmin(scores))]
        beta, b0 = _np_fit(pdf, f, names, alpha)
        te = pdf[pdf.fold == f]
        for rid, v in zip(te.rid, te[names].to_numpy() @ beta + b0):
            assert abs(got[(f, rid)] - max(v, 0.0)) < 1e-7


def test_many_folds_are_solved_together(spark, monkeypatch):
    """No Python call per fold: the systems of a batch are one stack, equal to each fold's least squares."""
    from panelcast.operators import linear
    rng = np.random.default_rng(5)
    rows = [("s", f"f{i % 60}", int(i), float(x), float(z), float(2 * x - z + e))
            for i, (x, z, e) in enumerate(rng.normal(size=(600, 3)))]
    df = spark.createDataFrame(rows, "split_type string, fold string, id int, a double, b double, y double")
    plan = linear.fit_blocked_linear(df, ["a", "b"], "y", degree=2, alpha=1.0)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    got = {r["fold"]: r for r in linear.fit_blocked_linear(df, ["a", "b"], "y").collect()}
    assert len(got) == 60
    for f in ("f0", "f59"):
        keep = np.array([[1.0, r[3], r[4], r[5]] for r in rows if r[1] != f])
        want = np.linalg.lstsq(keep[:, :3], keep[:, 3], rcond=None)[0]
        assert np.allclose([got[f]["b0"], got[f]["b_0"], got[f]["b_1"]], want) and got[f]["n_train"] == 590


def test_fold_metrics_work_out_the_predictions_once(spark):
    from panelcast.plans.weekly import fold_metrics
    rows = [("s", f"f{i % 3}", "m", "M", "none", 7, float(i), float(i + 1)) for i in range(9)]
    preds = spark.createDataFrame(rows, "split_type string, fold string, method string, model string, baseline string, "
                                        "nominal_horizon_days int, y_true double, v double").withColumn("y_pred", F.sqrt("v"))
    fm = fold_metrics(preds, 1.0)
    assert "SQRT" not in fm._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["fold"], r["train_rows"], r["test_rows"]) for r in fm.collect()) == [(f"f{i}", 6, 3) for i in range(3)]


def test_permutation_importance_in_several_passes_is_the_same_and_leaves_no_shuffle(spark, monkeypatch):
    import time
    from pathlib import Path

    from panelcast.operators import explain
    rows = [(i, float(i % 7), float((i * 5) % 11), float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")

    def run():
        got = explain.permutation_importance(df, ["a", "b"], "y", ["id"], explain.linear_predictor({"a": 0.5, "b": -0.25}, 1.0), n_repeats=5, seed=3)
        return [tuple(r) for r in got.collect()]

    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}

    whole = run()
    monkeypatch.setattr(explain, "CELLS_AT_ONCE", 1)
    passes, plain = [], explain.global_index

    def counted(d, *a, **k):
        passes.append(1)
        return plain(d, *a, **k)

    monkeypatch.setattr(explain, "global_index", counted)
    before = files()
    several = run()
    assert len(passes) == 1 + 5
    for x, y in zip(whole, several, strict=True):
        assert x[0] == y[0] and np.allclose(x[1:], y[1:], rtol=1e-12)
    for _ in range(50):  # files are removed in the background; the last, small table may keep its own
        left = len(files() - before)
        if left <= 8:
            break
        time.sleep(0.2)
    assert left <= 8


def test_a_checkpoint_gives_its_shuffles_back(spark):
    import time
    from pathlib import Path

    from panelcast.session import cut_lineage
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    df = cut_lineage(spark.range(5000).groupBy((F.col("id") % 100).alias("g")).agg(F.sum("id").alias("s")))
    assert df.count() == 100 and df.agg(F.sum("s")).first()[0] == 4999 * 2500
    own = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    assert own == "false"
    for _ in range(50):
        if len(files() - before) <= 2:  # the two small sums above
            break
        time.sleep(0.2)
    assert len(files() - before) <= 2


def test_forest_passes_are_small_and_change_nothing(spark):
    from pyspark.ml.feature import VectorAssembler
    from panelcast.operators.models import NODE_MEMORY_MB, make_model_spec, spark_estimator
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(a * b)) for a, b in x], "a double, b double, label double")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    est = spark_estimator(make_model_spec("random_forest"), {"max_depth": 4}).setNumTrees(10)
    assert est.getCacheNodeIds() and est.getMaxMemoryInMB() == NODE_MEMORY_MB < 256
    got = est.fit(data).transform(data).select("prediction").collect()
    assert got == est.copy({est.cacheNodeIds: False, est.maxMemoryInMB: 256}).fit(data).transform(data).select("prediction").collect()


def test_permuted_values_meet_their_rows_by_hash_and_null_keys_keep_their_order(spark, monkeypatch):
    import hashlib

    from panelcast.operators import explain
    rows = [(None if i % 9 == 0 else f"s{i // 9}", i, float(i % 7), float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "site string, id long, a double, y double")
    joins, join = [], type(df).join

    def seen(self, other, *a, **k):
        out = join(self, other, *a, **k)
        if "__pos" in self.columns and "__v" in self.columns:
            joins.append(out)
        return out

    monkeypatch.setattr(type(df), "join", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = explain.permutation_importance(df, ["a"], "y", ["site", "id"], explain.linear_predictor({"a": 0.5}, 1.0), n_repeats=2, seed=3).collect()
        plan = joins[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan
    text = lambda *parts: hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()
    order = sorted(rows, key=lambda r: text(3, r[0], r[1]))
    gains = []
    for r in range(2):
        donor = sorted(rows, key=lambda x: text(3, "a", r, x[0], x[1]))
        gains.append(np.mean([(1 + 0.5 * d[2] - o[3]) ** 2 - (1 + 0.5 * o[2] - o[3]) ** 2 for d, o in zip(donor, order, strict=True)]))
    assert np.isclose(got[0]["importance_mean"], np.mean(gains)) and np.isclose(got[0]["importance_std"], np.std(gains))

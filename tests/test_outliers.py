import numpy as np

from panelcast.operators.outliers import exact_percentile, flag_outliers, isolation_forest_scores


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.normal(size=500), 2)  # ties on purpose
    df = spark.createDataFrame([(i, "c", float(v)) for i, v in enumerate(vals)],
                               "id long, `column` string, v double")
    for q in (0.005, 0.5, 0.9):
        got = exact_percentile(df, ["column"], "v", q, ["id"]).first()["threshold"]
        assert abs(got - np.percentile(vals, 100 * q)) < 1e-12


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(2)
    vals = list(rng.normal(size=1000)) + [25.0, -30.0, 40.0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, x double")
    scores = isolation_forest_scores(df, ["x"], ["id"], n_trees=100, seed=42)
    filtered, report = flag_outliers(df, ["x"], ["id"], contamination=0.005, scores=scores)
    r = report.first()
    assert r["original_non_nan"] == 1003
    assert 3 <= r["outliers"] <= 6  # about 0.5 % of 1003, strict "<" on the threshold
    dropped = {row["id"] for row in filtered.where("x IS NULL").collect()}
    assert {1000, 1001, 1002} <= dropped


def test_forest_matches_numpy_forest_with_the_same_seeds(spark):
    import hashlib

    from panelcast.operators.outliers import _build_tree, _tree_seed, average_path_length
    rng = np.random.default_rng(5)
    for n in (40, 700):  # fewer and more values than a sample holds
        vals = rng.normal(size=n)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, x double")
        got = {r["id"]: r["score"] for r in isolation_forest_scores(df, ["x"], ["id"], n_trees=20, seed=9).collect()}
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"9:x:{i}".encode()).hexdigest(), i))
        psi = min(256, n)
        depth = np.zeros(n)
        for t in range(20):
            draw, places = np.random.default_rng(_tree_seed(9, "x", t)), {}
            while len(places) < psi:
                places |= dict.fromkeys(draw.integers(0, n, psi - len(places)).tolist())
            thr, lens = _build_tree(vals[[order[p] for p in places]], 8, np.random.default_rng([_tree_seed(9, "x", t), 1]))
            depth += lens[np.searchsorted(thr, vals, side="left")]
        want = -np.power(2.0, -(depth / 20) / average_path_length([psi])[0])
        assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-12


def test_columns_without_values_have_no_outliers(spark):
    df = spark.createDataFrame([(i, None, float(i)) for i in range(30)], "id long, e double, x double")
    scores = isolation_forest_scores(df, ["e", "x"], ["id"], n_trees=5)
    filtered, report = flag_outliers(df, ["e", "x"], ["id"], scores=scores)
    rows = {r["column"]: r for r in report.collect()}
    assert (rows["e"]["original_non_nan"], rows["e"]["filtered_non_nan"], rows["e"]["outliers"]) == (0, 0, 0)
    assert filtered.count() == 30


def test_percentile_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr("panelcast.operators.outliers.SORTED_VALUES", 20)
    rng = np.random.default_rng(3)
    vals = {"c": rng.normal(size=3000), "t": np.round(rng.normal(size=2500), 1), "one": np.full(400, 7.0), "few": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(c, float(x)) for c, v in vals.items() for x in v] + [("c", None), ("none", None)], "`column` string, v double").repartition(5)
    for q in (0.0, 0.005, 0.37, 1.0):
        got = {r["column"]: r["threshold"] for r in exact_percentile(df, ["column"], "v", q).collect()}
        assert got.keys() == vals.keys()
        assert all(abs(got[c] - np.percentile(v, 100 * q)) < 1e-12 for c, v in vals.items())

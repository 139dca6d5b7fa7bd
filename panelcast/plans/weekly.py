"""Observed weekly pairs and blocked validation (baselines, metrics, summaries)."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.cleaning import clean_numeric_frame
from panelcast.functions.labels import clip_nonnegative
from panelcast.operators.baselines import baseline_predictions
from panelcast.operators.boosting import boosted_predictions
from panelcast.operators.extra_trees import extra_trees_predictions
from panelcast.operators.folds import assign_blocked_folds, blocked_fold_sizes, nested_group_folds, split_group_column
from panelcast.operators.foldstats import complement_median, complement_moments
from panelcast.operators.knn import fold_score, knn_neighbours, knn_predict, knn_prediction, knn_rows, parameter_grid
from panelcast.operators.knn_tuning import nested_scores
from panelcast.operators.linear import fit_blocked_linear, predict_blocked_linear, tune_blocked_ridge
from panelcast.operators.metrics import event_metric_columns, summarize_fold_metrics, summarize_pooled_predictions
from panelcast.operators.kernel_svr import svr_predictions
from panelcast.operators.models import ModelSpec, fit_blocked_spark_ml, make_model_spec
from panelcast.operators.neural import neural_predictions
from panelcast.operators.select import extract_features, quote
from panelcast.operators.series import add_total, site_day_mean, weekly_pairs
from panelcast.session import cut_lineage
from panelcast.schema import (BASE_FEATURES, KNN_PARAM_GRID, TOTAL_NAME, TOTAL_PARTS, TOXIN_FEATURES,
                              TOXIN_MODEL_FEATURES, FeatureSpec)

PAIR_METADATA = ["current_date", "target_date", "target_year", "station_year",
                 "nominal_horizon_days", "actual_horizon_days"]


@dataclass
class PanelSpec:
    """Names of the entity/time/target columns of an observation table."""

    site: str = "Site"
    time: str = "Time"
    target: str = TOTAL_NAME
    features: list[str] = field(default_factory=lambda: list(TOXIN_MODEL_FEATURES))

    @property
    def target_out(self) -> str:
        return f"{self.target}_target"


def prepare_observed(raw: DataFrame, specs: list[FeatureSpec] | None = None, *,
                     total_parts=TOTAL_PARTS, total_name: str = TOTAL_NAME,
                     strict: bool = True) -> DataFrame:
    """Raw text table -> one row per (Site, day): extract columns by substring,
    clean detection limits, parse dates, drop rows without date or site,
    average per site-day, add the total."""
    specs = specs if specs is not None else TOXIN_FEATURES + BASE_FEATURES
    extracted = extract_features(raw, specs, include_date=True, include_site=True)
    measures = [s.output_name for s in specs]
    cleaned = clean_numeric_frame(extracted, measures, strict=strict)
    obs = site_day_mean(cleaned, "Site", "Time", measures)
    return add_total(obs, total_parts, total_name)


def validation_inputs(pairs: DataFrame, split_types=("year", "station_year")):
    assigned = assign_blocked_folds(pairs, split_types)
    return assigned, blocked_fold_sizes(assigned)


def baseline_validation(pairs: DataFrame, spec: PanelSpec, *, split_types=("year", "station_year"),
                        threshold: float = 1.0, materialize: bool = True, metrics: bool = True):
    """Baseline-only blocked validation: (fold_metrics, predictions); without ``metrics`` (None, predictions).

    The pairs table feeds several aggregations; with ``materialize`` it is
    checkpointed once (to ``spark.checkpoint.dir``) instead of being
    recomputed from the raw table by every branch.
    """
    if materialize:
        pairs = cut_lineage(pairs)
    assigned = assign_blocked_folds(pairs, split_types)
    keep = [spec.site, *PAIR_METADATA]
    preds = baseline_predictions(assigned, current=spec.target, target=spec.target_out,
                                 site=spec.site, keep=keep)
    return fold_metrics(preds, threshold) if metrics else None, preds


def fold_metrics(predictions: DataFrame, threshold: float,
                 model_details: DataFrame | None = None) -> DataFrame:
    """Per (split type, fold, method) metrics, fold sizes and fit details.

    One aggregation over the predictions; ``train_rows`` is the split's row
    count minus the fold's (each row is a test row exactly once per split
    type and method), from sums over the per-fold table.
    """
    keys = ["split_type", "fold", "method", "model", "baseline"]
    # one small row per fold and method, written once: the split's row counts would work out all predictions again
    met = cut_lineage(predictions.groupBy(*keys).agg(
        F.min("nominal_horizon_days").alias("horizon_days"), F.count(F.lit(1)).alias("test_rows"),
        *event_metric_columns("y_true", "y_pred", threshold)))
    split_rows = met.groupBy("split_type", "method").agg(F.sum("test_rows").alias("__rows"))
    out = met.join(split_rows, ["split_type", "method"]).withColumn("train_rows", F.col("__rows") - F.col("test_rows"))
    if model_details is not None:
        out = out.join(model_details, ["split_type", "fold", "method"], "left")
    else:
        out = (out.withColumn("best_params", F.lit(""))
               .withColumn("best_inner_cv_rmse", F.lit(None).cast("double"))
               .withColumn("inner_cv_splits", F.lit(None).cast("int"))
               .withColumn("fit_seconds", F.lit(0.0)))
    return out.select(
        "horizon_days", "split_type", "fold", "method", "model", "baseline", "train_rows",
        "test_rows", F.lit(float(threshold)).alias("threshold"), "best_params",
        "best_inner_cv_rmse", "inner_cv_splits", "fit_seconds", "mae", "rmse", "r2", "pod", "far",
        "csi", "hits", "misses", "false_alarms", "correct_negatives")


def make_pairs(obs: DataFrame, spec: PanelSpec, nominal_horizon_days: int = 7,
               tolerance_days: int = 2) -> DataFrame:
    return weekly_pairs(obs, site=spec.site, time=spec.time, target=spec.target,
                        features=spec.features, nominal_horizon_days=nominal_horizon_days,
                        tolerance_days=tolerance_days, target_out=spec.target_out)


def require_rows(df: DataFrame) -> DataFrame:
    """Empty-result guard at an action boundary."""
    if df.isEmpty():
        raise ValueError("no pairs: widen the tolerance or check the observation dates of each site")
    return df


def pair_columns(spec: PanelSpec) -> list:
    return [quote(c) for c in [*spec.features, spec.site, *PAIR_METADATA, spec.target_out]]


def pair_ids(spec: PanelSpec) -> list[str]:
    return [spec.site, "current_date"]


def gap_medians(assigned: DataFrame, features: list[str], id_cols: list[str]) -> DataFrame | None:
    """Training medians of every fold, or None when no feature has a gap."""
    gaps = assigned.agg(*[F.count_if(quote(f).isNull()).alias(f"g{i}") for i, f in enumerate(features)]).first()
    return cut_lineage(complement_median(assigned, features, id_cols)) if any(gaps) else None


def model_rows(pred: DataFrame, spec: PanelSpec, method: str, label: str) -> DataFrame:
    """Predictions in the common layout."""
    return pred.select("split_type", "fold", F.lit(method).alias("method"), F.lit(label).alias("model"),
                       F.lit("none").alias("baseline"), *[quote(c) for c in [spec.site, *PAIR_METADATA]],
                       quote(spec.target_out).cast("double").alias("y_true"), "y_pred")


def linear_predictions(assigned: DataFrame, spec: PanelSpec, *, medians: DataFrame | None = None,
                       alpha: float = 0.0, degree: int = 1, method: str = "linear",
                       label: str = "Linear Regression") -> tuple[DataFrame, DataFrame]:
    """Fold-local OLS (or ridge) predictions for every test row, clipped at 0, and the fit details."""
    if medians is None:
        medians = gap_medians(assigned, spec.features, pair_ids(spec))
    # one small row per fold, read by every test row: written once
    coefs = cut_lineage(fit_blocked_linear(assigned, spec.features, spec.target_out, alpha=alpha, medians=medians, degree=degree))
    params = json.dumps({"alpha": alpha}) if alpha else "{}"
    return (model_rows(predict_blocked_linear(assigned, coefs, spec.features, degree=degree), spec, method, label),
            model_details(coefs, method, params, seconds="seconds"))


def model_details(folds: DataFrame, method: str, best_params: str = "{}", inner_cv_splits: int = 0,
                  seconds: str | float = 0.0) -> DataFrame:
    """One row per (split type, fold) with the fit details of a model without
    tuning; ``seconds`` names a column of ``folds`` or is a number."""
    took = F.max(seconds) if isinstance(seconds, str) else F.lit(float(seconds))
    return folds.groupBy("split_type", "fold").agg(took.alias("fit_seconds")).select(
        "split_type", "fold", F.lit(method).alias("method"), F.lit(best_params).alias("best_params"),
        F.lit(None).cast("double").alias("best_inner_cv_rmse"),
        F.lit(inner_cv_splits).cast("int").alias("inner_cv_splits"), "fit_seconds")


def knn_blocked_predictions(assigned: DataFrame, spec: PanelSpec, *, k: int = 5, weights: str = "uniform", p: int = 2,
                            medians: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact fold-local KNN predictions for every test row (clipped at 0), and the fit details."""
    if medians is None:
        medians = gap_medians(assigned, spec.features, pair_ids(spec))
    began = time.perf_counter()
    mom = complement_moments(assigned, spec.features, medians)
    ids = pair_ids(spec)
    nn = knn_neighbours(assigned, spec.features, spec.target_out, ids, mom, k_max=k, p=p, medians=medians)
    # written without the neighbours: several tables of metrics read the predictions
    pred = cut_lineage(knn_predict(nn, k, weights).select("split_type", "fold", *[quote(c) for c in ids], clip_nonnegative("y_pred").alias("y_pred")))
    rows = assigned.join(pred, ["split_type", "fold", *ids])
    # one search serves all folds: each gets its share of the time
    folds = assigned.select("split_type", "fold").distinct()
    share = (time.perf_counter() - began) / max(1, folds.count())
    params = json.dumps({"n_neighbors": k, "p": p, "weights": weights}, sort_keys=True)
    return model_rows(rows, spec, "knn", "KNN"), model_details(folds, "knn", params, seconds=share)


def evaluate_blocked_validation(pairs: DataFrame, spec: PanelSpec, *, split_types=("year", "station_year"),
                                model_names=("knn", "linear", "polynomial"), threshold: float = 1.0,
                                tune: bool = True, inner_cv: int = 5):
    """Models + persistence + seasonal climatology for every blocked fold.

    Returns (fold_metrics, predictions, summary, pooled).  Gaps are filled with
    each fold's training medians in every model.  With ``tune`` every model
    that has a grid is tuned inside each outer fold by group k-fold, whatever
    the number of folds; without, ``knn`` runs with k=5, uniform, p=2,
    ``polynomial`` with alpha = 1 and trees with the last point of their grid.
    """
    pairs = require_rows(cut_lineage(pairs))
    assigned = assign_blocked_folds(pairs, split_types)
    medians = gap_medians(assigned, spec.features, pair_ids(spec))
    parts, details = [], []
    for name in dict.fromkeys(model_names):
        ms = make_model_spec(name)
        if name == "linear":
            found = [linear_predictions(assigned, spec, medians=medians)]
        elif name == "polynomial" and tune:
            found = [ridge_nested_predictions(assigned, spec, medians=medians, inner_cv=inner_cv)]
        elif name == "polynomial":
            found = [linear_predictions(assigned, spec, medians=medians, alpha=1.0, degree=2, method=name, label=ms.label)]
        elif name == "knn" and tune:
            found = [knn_nested_predictions(assigned, spec, split_type=st, medians=medians, inner_cv=inner_cv)
                     for st in dict.fromkeys(split_types)]
        elif name == "knn":
            found = [knn_blocked_predictions(assigned, spec, medians=medians)]
        elif ms.kind == "spark_ml":
            found = []
            for st in dict.fromkeys(split_types):
                pr, det = fit_blocked_spark_ml(assigned, ms, spec.features, spec.target_out, split_type=st,
                                               group_col=split_group_column(st), fold_medians=medians, tune=tune,
                                               inner_cv=inner_cv)
                found.append((model_rows(pr, spec, name, ms.label), det))
        else:
            found = [block_model_predictions(assigned, spec, ms, split_type=st, medians=medians, inner_cv=inner_cv, tune=tune)
                     for st in dict.fromkeys(split_types)]
        parts += [pr for pr, _ in found]
        details += [det for _, det in found]
    base = baseline_predictions(assigned, current=spec.target, target=spec.target_out,
                                site=spec.site, keep=[spec.site, *PAIR_METADATA])
    fm, preds = fold_metrics(base, threshold), base
    if parts:
        models = reduce(DataFrame.unionByName, parts)
        fm = fold_metrics(models, threshold, reduce(DataFrame.unionByName, details)).unionByName(fm)
        preds = models.unionByName(base)
    return fm, preds, summarize_fold_metrics(fm), summarize_pooled_predictions(preds, threshold)


def block_model_predictions(assigned: DataFrame, spec: PanelSpec, ms: ModelSpec, *, split_type: str, medians: DataFrame | None = None,
                            inner_cv: int = 5, tune: bool = True, param_grid: dict | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Predictions and fit details of extra trees, boosting, the neural net or the kernel machine for every fold of a split type.

    ``options`` go to the model's own function and override the registry's fixed values.
    """
    ids, f = pair_ids(spec), ms.fixed
    common = dict(split_type=split_type, param_grid=param_grid or ms.param_grid, inner_cv=inner_cv, tune=tune)
    args = (assigned, spec.features, spec.target_out, ids)
    if ms.kind == "extra_trees":
        fixed = dict(n_estimators=f["n_estimators"], min_samples_leaf=f["min_samples_leaf"], seed=f["seed"])
        pred, details = extra_trees_predictions(*args, **common, **(fixed | options))
    elif ms.kind == "boosting":
        fixed = dict(n_estimators=f["n_estimators"], learning_rate=f["learning_rate"], subsample=f["subsample"], colsample=f["colsample_bytree"],
                     lam=f["reg_lambda"], seed=f["seed"], medians=medians)
        pred, details = boosted_predictions(*args, **common, **(fixed | options))
    elif ms.kind == "neural":
        pred, details = neural_predictions(*args, **common, **(dict(epochs=f["max_iter"], rate=f["learning_rate"], seed=f["seed"], medians=medians) | options))
    elif ms.kind == "kernel":
        pred, details = svr_predictions(*args, **common, **(dict(medians=medians) | options))
    else:
        raise ValueError(f"model {ms.name!r} is not one of the block models")
    part = assigned.where(F.col("split_type") == split_type)
    return model_rows(part.join(pred, ["split_type", "fold", *ids]), spec, ms.name, ms.label), details


def _inner_table(part: DataFrame, inner: DataFrame, columns: list[str]) -> DataFrame:
    """The inner validation problems as split types of their own: each row once for every outer fold it trains."""
    return cut_lineage(part.join(inner.select("outer", "fold", "inner"), "fold").select(
        F.col("outer").alias("split_type"), F.col("inner").cast("string").alias("fold"), *[quote(c) for c in dict.fromkeys(columns)]))


def knn_nested_predictions(assigned: DataFrame, spec: PanelSpec, *, split_type: str = "year", inner_cv: int = 5,
                           param_grid: dict | None = None, medians: DataFrame | None = None):
    """KNN tuned inside every outer fold by group k-fold CV (nested), then
    used to predict the fold's test rows.  Returns (predictions, details).

    Complete features: one neighbour search per metric answers every inner
    problem of every outer fold from lists that know each neighbour's group
    (``knn_tuning.nested_scores``); no row is copied.  With gaps the medians
    differ from one inner training set to the next, and each training row takes
    part once per outer fold it trains.
    """
    began = time.perf_counter()
    grid = parameter_grid(param_grid or KNN_PARAM_GRID)
    ids = pair_ids(spec)
    part = cut_lineage(assigned.where(F.col("split_type") == split_type))
    own_medians = gap_medians(part, spec.features, ids) if medians is None else medians.where(F.col("split_type") == split_type)
    if own_medians is None:
        rows = knn_rows(part, spec.features, spec.target_out, ids, False)
        scores = nested_scores(rows, len(spec.features), grid, inner_cv)
    else:
        scores = _copied_scores(part, spec, grid, inner_cv)
    # a grid point that does not fit one inner fold has no score there
    mean = scores.groupBy("fold", "candidate").agg(
        F.when(F.count("mse") == F.max("splits"), F.avg("mse")).alias("mean_mse"), F.max("splits").alias("splits"))
    # ties: the first grid point
    best = cut_lineage(mean.where(F.col("mean_mse").isNotNull()).groupBy("fold").agg(
        F.min(F.struct("mean_mse", "candidate")).alias("b"), F.max("splits").cast("int").alias("inner_cv_splits"))
        .select("fold", "b.candidate", "b.mean_mse", "inner_cv_splits"))
    chosen = _best_predictions(part, spec, grid, best, own_medians) \
        .select("split_type", "fold", *[quote(c) for c in ids], clip_nonnegative("y_pred").alias("y_pred"))
    out = model_rows(part.join(chosen, ["split_type", "fold", *ids]), spec, "knn", "KNN")
    names = F.create_map(*[x for c, g in enumerate(grid) for x in (F.lit(c), F.lit(json.dumps(g, sort_keys=True)))])
    share = (time.perf_counter() - began) / max(1, best.count())
    details = best.select(
        F.lit(split_type).alias("split_type"), "fold", F.lit("knn").alias("method"), names[F.col("candidate")].alias("best_params"),
        F.sqrt("mean_mse").alias("best_inner_cv_rmse"), "inner_cv_splits", F.lit(share).alias("fit_seconds"))
    return out, details


def _best_predictions(part: DataFrame, spec: PanelSpec, grid: list[dict], best: DataFrame, medians: DataFrame | None) -> DataFrame:
    """(split_type, fold, ids, y_pred): every fold's test rows by its own grid point; one search per metric for the folds that use it."""
    ids = pair_ids(spec)
    moments = complement_moments(part, spec.features, medians)
    out = []
    for p in sorted({g["p"] for g in grid}):
        mine = {c: g for c, g in enumerate(grid) if g["p"] == p}
        used = {r["candidate"] for r in best.select("candidate").distinct().collect()} & set(mine)  # grid points
        if not used:
            continue
        nn = knn_neighbours(part, spec.features, spec.target_out, ids, moments, p=p, medians=medians,
                            query_folds=best.where(F.col("candidate").isin(sorted(used))), k_max=max(mine[c]["n_neighbors"] for c in used))
        chosen = F.coalesce(*[F.when(F.col("candidate") == c, knn_prediction(mine[c]["n_neighbors"], mine[c]["weights"])) for c in sorted(used)])
        out.append(nn.join(best.select("fold", "candidate"), "fold").select("split_type", "fold", *[quote(c) for c in ids], chosen.alias("y_pred")))
    return reduce(DataFrame.unionByName, out)


def _copied_scores(part: DataFrame, spec: PanelSpec, grid: list[dict], inner_cv: int) -> DataFrame:
    """(fold, inner, candidate, mse, splits) where features have gaps: the inner problem of fold f is a split type of its own."""
    ids = pair_ids(spec)
    inner_folds = cut_lineage(nested_group_folds(part, inner_cv))
    inner = _inner_table(part, inner_folds, [*ids, *spec.features, spec.target_out])
    medians = gap_medians(inner, spec.features, ids)
    moments = complement_moments(inner, spec.features, medians)
    names = ["split_type", "fold", *ids]
    truth = inner.select(*[quote(c) for c in names], quote(spec.target_out).cast("double").alias("__y"))
    k_max = max(g["n_neighbors"] for g in grid)
    out = []
    for p in sorted({g["p"] for g in grid}):
        nn = knn_neighbours(inner, spec.features, spec.target_out, ids, moments, k_max=k_max, p=p, medians=medians)
        nn = cut_lineage(nn.join(truth, names))
        out += [knn_predict(nn, g["n_neighbors"], g["weights"], strict=False).withColumn("candidate", F.lit(c)).drop("nn")
                for c, g in enumerate(grid) if g["p"] == p]
    scored = reduce(DataFrame.unionByName, out).withColumn("__se", (F.col("y_pred") - F.col("__y")) ** 2)
    splits = inner_folds.groupBy("outer").agg((F.max("inner") + 1).alias("splits"))
    return scored.groupBy(F.col("split_type").alias("outer"), "candidate", F.col("fold").alias("inner")).agg(fold_score().alias("mse")) \
        .join(splits, "outer").select(F.col("outer").alias("fold"), "inner", "candidate", "mse", "splits")


def ridge_nested_predictions(assigned: DataFrame, spec: PanelSpec, *, split_type: str | None = None,
                             alphas=(1.0, 10.0), inner_cv: int = 5, medians: DataFrame | None = None):
    """Polynomial (degree 2) ridge with alpha tuned by nested group k-fold CV
    inside every outer fold, of one split type or of all.  Inner training and validation
    matrices are sums of group matrices; rows are copied (once per outer fold)
    only to take medians where features have gaps.  Returns (predictions, details)."""
    ids = pair_ids(spec)
    assigned = cut_lineage(assigned if split_type is None else assigned.where(F.col("split_type") == split_type))
    inner = cut_lineage(nested_group_folds(assigned, inner_cv))
    if medians is None:
        medians = gap_medians(assigned, spec.features, ids)
    inner_medians = None
    if medians is not None:
        keys = F.to_json(F.struct("split_type", "outer"))
        copies = cut_lineage(assigned.join(inner, ["split_type", "fold"]).select(
            keys.alias("split_type"), F.col("inner").cast("string").alias("fold"), *[quote(c) for c in dict.fromkeys([*ids, *spec.features])]))
        named = F.from_json("split_type", "split_type string, outer string")
        inner_medians = complement_median(copies, spec.features, ids).select(
            named["split_type"].alias("split_type"), named["outer"].alias("outer"), F.col("fold").alias("inner"), "feature", "median")
    coefs = cut_lineage(tune_blocked_ridge(
        assigned, spec.features, spec.target_out, inner, alphas=[float(a) for a in alphas], degree=2,
        medians=medians, inner_medians=inner_medians))
    pred = predict_blocked_linear(assigned, coefs, spec.features, degree=2)
    splits = inner.groupBy("split_type", F.col("outer").alias("fold")).agg((F.max("inner") + 1).cast("int").alias("inner_cv_splits"))
    details = coefs.join(splits, ["split_type", "fold"]).select(
        "split_type", "fold", F.lit("polynomial").alias("method"), F.to_json(F.struct("alpha")).alias("best_params"),
        F.sqrt("mse").alias("best_inner_cv_rmse"), "inner_cv_splits", F.col("seconds").alias("fit_seconds"))
    return model_rows(pred, spec, "polynomial", "Polynomial Regression"), details

"""Feature catalogue and model-input list.

These are configuration values, not logic: any (entity, time, measures)
table can be described with its own ``FeatureSpec`` list.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FeatureSpec:
    """Output column ``output_name`` taken from the first source column whose
    name contains ``source_contains`` (case-sensitive)."""

    output_name: str
    source_contains: str


# --- fixed values: default water-quality catalogue (output name, source substring) ---
BASE_FEATURES = [
    FeatureSpec("Chla", "Extracted Chlorophyll a"),
    FeatureSpec("TP", "Total Phosphorus"),
    FeatureSpec("AMM", "Ammonia"),
    FeatureSpec("SRP", "Soluble Reactive Phosphorus"),
    FeatureSpec("Temp", "CTD Temperature"),
    FeatureSpec("DO", "CTD Dissolved Oxygen"),
    FeatureSpec("TDP", "Total Dissolved Phosphorus"),
    FeatureSpec("NN", "Nitrate + Nitrite"),
    FeatureSpec("POC", "Particulate Organic Carbon"),
    FeatureSpec("Depth", "Station Depth"),
    FeatureSpec("PON", "Particulate Organic Nitrogen"),
    FeatureSpec("Cond", "CTD Specific Conductivity"),
    FeatureSpec("SD", "Secchi Depth"),
    FeatureSpec("TSS", "Total Suspended Solids"),
    FeatureSpec("Wind", "Wind speed"),
    FeatureSpec("PAR", "Photosynthetically Active Radiation"),
]

TOXIN_FEATURES = [
    FeatureSpec("Phycocyanin", "Extracted Phycocyanin"),
    FeatureSpec("Dissolved Microcystin", "Dissolved Microcystin"),
    FeatureSpec("Particulate Microcystin", "Particulate Microcystin"),
    FeatureSpec("TUR", "2_Turbidity"),
]

# Model inputs; the first one is the current value of the forecast target.
TOXIN_MODEL_FEATURES = [
    "Total microcystin", "Temp", "Chla", "Depth", "Phycocyanin", "Wind", "DO", "PAR",
    "AMM", "Cond", "SD", "NN", "TP", "SRP", "TUR",
]

# Target = sum of these two parts; summary metric names; model registry names.
TOTAL_PARTS = ("Dissolved Microcystin", "Particulate Microcystin")
TOTAL_NAME = "Total microcystin"
REGRESSION_METRICS = ("mae", "rmse", "r2")
EVENT_METRICS = ("pod", "far", "csi")
SUMMARY_METRICS = REGRESSION_METRICS + EVENT_METRICS
SUPPORTED_MODELS = ("knn", "linear", "polynomial", "random_forest", "xgboost", "ann", "svm",
                    "extra_trees")
KNN_PARAM_GRID = {"n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"], "p": [1, 2]}
# --- end of fixed values ---

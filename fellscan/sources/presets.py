"""The seven detection presets: passes in order, fusion weights, confidence floor, per-pass settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Preset:
    name: str
    passes: list[str]
    min_confidence: float
    weights: dict[str, float] = field(default_factory=dict)
    params: dict[str, dict] = field(default_factory=dict)


# Preset contents.
PRESETS = {
    "aggressive_cave": Preset(
        "aggressive_cave", ["fill_difference", "local_relief_model", "tpi", "curvature", "sky_view_factor", "morphometric_filter"], 0.15,
        {"fill_difference": 1.5, "local_relief_model": 1.5, "tpi": 1.0, "curvature": 1.0, "sky_view_factor": 1.2, "morphometric_filter": 0.0},
        {"fill_difference": {"min_depth_m": 0.3, "min_area_m2": 20, "max_area_m2": 50000},
         "local_relief_model": {"kernel_sizes": [50, 100, 200], "threshold_m": 0.15, "min_area_m2": 10, "max_area_m2": 50000},
         "tpi": {"threshold": -0.3, "radius_m": 15}, "curvature": {"type": "total", "threshold": -0.005},
         "sky_view_factor": {"radius_m": 30, "n_directions": 16, "threshold": 0.8, "min_area_pixels": 2},
         "morphometric_filter": {"min_depth_m": 0.3, "max_area_m2": 50000, "min_circularity": 0.1}}),
    "cave_hunting": Preset(
        "cave_hunting", ["local_relief_model", "fill_difference", "sky_view_factor", "morphometric_filter"], 0.4,
        {"local_relief_model": 1.5, "fill_difference": 1.2, "sky_view_factor": 1.0, "morphometric_filter": 0.0},
        {"local_relief_model": {"kernel_sizes": [50, 100, 200], "threshold_m": 1.0, "min_area_m2": 50, "max_area_m2": 5000},
         "fill_difference": {"min_depth_m": 1.0, "min_area_m2": 50, "max_area_m2": 5000},
         "sky_view_factor": {"radius_m": 30, "n_directions": 16, "threshold": 0.75, "min_area_pixels": 10},
         "morphometric_filter": {"min_depth_m": 0.5, "min_area_m2": 100, "max_area_m2": 4000, "min_circularity": 0.3}}),
    "landscape_discovery": Preset(
        "landscape_discovery", ["raised_features", "linear_features", "enclosures", "repeated_patterns", "geological_forms"], 0.3),
    "lava_tube_detection": Preset(
        "lava_tube_detection", ["fill_difference", "local_relief_model", "sky_view_factor", "morphometric_filter"], 0.4,
        {"fill_difference": 1.2, "local_relief_model": 1.5, "sky_view_factor": 1.3, "morphometric_filter": 0.0},
        {"fill_difference": {"min_depth_m": 0.5, "min_area_m2": 50, "max_area_m2": 50000},
         "local_relief_model": {"kernel_sizes": [30, 75, 150], "threshold_m": 0.5, "min_area_m2": 50, "max_area_m2": 50000},
         "sky_view_factor": {"radius_m": 20, "n_directions": 16, "threshold": 0.7, "min_area_pixels": 10},
         "morphometric_filter": {"min_depth_m": 0.3, "max_area_m2": 50000, "min_circularity": 0.05}}),
    "mine_detection": Preset(
        "mine_detection", ["fill_difference", "local_relief_model", "tpi", "point_density", "multi_return", "morphometric_filter"], 0.3,
        {"fill_difference": 1.2, "local_relief_model": 1.0, "tpi": 1.0, "point_density": 1.5, "multi_return": 1.3, "morphometric_filter": 0.0},
        {"fill_difference": {"min_depth_m": 0.5, "max_area_m2": 3000}, "local_relief_model": {"kernel_sizes": [30, 75, 150], "threshold_m": 0.3},
         "tpi": {"threshold": -1.5, "radius_m": 10}, "point_density": {"cell_size_m": 2.0, "z_score_threshold": -2.0},
         "multi_return": {"search_radius_m": 3.0, "min_multi_return_ratio": 0.3},
         "morphometric_filter": {"min_depth_m": 0.3, "max_area_m2": 2000, "min_circularity": 0.15}}),
    "salt_dome_detection": Preset(
        "salt_dome_detection", ["fill_difference", "tpi", "morphometric_filter"], 0.4,
        {"fill_difference": 1.5, "tpi": 1.3, "morphometric_filter": 0.0},
        {"fill_difference": {"min_depth_m": 0.3, "min_area_m2": 500, "max_area_m2": 200000}, "tpi": {"threshold": -0.5, "min_area_pixels": 10},
         "morphometric_filter": {"min_depth_m": 0.3, "max_area_m2": 200000, "min_circularity": 0.2}}),
    "sinkhole_survey": Preset(
        "sinkhole_survey", ["fill_difference", "local_relief_model", "tpi", "curvature", "sky_view_factor", "point_density", "morphometric_filter"], 0.3,
        {"fill_difference": 1.5, "local_relief_model": 1.5, "tpi": 1.3, "curvature": 0.8, "sky_view_factor": 1.0, "point_density": 2.0, "morphometric_filter": 0.0},
        {"fill_difference": {"min_depth_m": 0.5, "min_area_m2": 25, "max_area_m2": 50000},
         "local_relief_model": {"kernel_sizes": [50, 100, 200], "threshold_m": 0.4, "min_area_m2": 25, "max_area_m2": 50000},
         "tpi": {"threshold": -1.0, "radius_m": 15, "min_area_pixels": 25, "max_area_pixels": 5000},
         "curvature": {"type": "total", "threshold": -0.03, "min_area_pixels": 25, "max_area_pixels": 5000},
         "sky_view_factor": {"radius_m": 30, "n_directions": 16, "threshold": 0.65, "min_area_pixels": 25, "max_area_pixels": 5000},
         "point_density": {"cell_size_m": 2.0, "z_score_threshold": -2.0},
         "morphometric_filter": {"min_depth_m": 0.3, "max_area_m2": 50000, "min_circularity": 0.3}}),
}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; known: {sorted(PRESETS)}")
    return PRESETS[name]


def preset_weights(spark: SparkSession, name: str | None = None) -> DataFrame:
    """(preset, ord, pass_name, weight); an unlisted pass weighs 1."""
    rows = [(p.name, i, n, float(p.weights.get(n, 1.0))) for p in PRESETS.values() if name in (None, p.name) for i, n in enumerate(p.passes)]
    return spark.createDataFrame(rows, "preset string, ord int, pass_name string, weight double")

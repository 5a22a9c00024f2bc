"""Depression and point-cloud passes: mask, label, aggregate, score.

Centroids are mean cell centres (index + 0.5) in lattice units; ``georeference`` turns them into survey coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscan.functions.scalars import classify, saturating
from fellscan.operators.blocks import BLOCK
from fellscan.operators.components import label
from fellscan.operators.pointgrid import multi_return_ratio, point_density
from fellscan.operators.regions import REGION, batch_morphometrics, region_stats
from fellscan.plans.registry import Found, as_candidates, register_pass


def sanitise(df: DataFrame, col: str, hi: float | None = 1000, lo: float | None = None) -> DataFrame:
    """Values that are not finite or beyond the sentinels become 0."""
    c = F.col(col).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    if hi is not None:
        ok = ok & (c < hi)
    if lo is not None:
        ok = ok & (c > lo)
    return df.withColumn(col, F.when(ok, c).otherwise(F.lit(0.0)))


def mask(df: DataFrame, col: str, op: str, threshold: float) -> DataFrame:
    tests = {">": lambda c: c > threshold, "<": lambda c: c < threshold, ">=": lambda c: c >= threshold, "<=": lambda c: c <= threshold}
    return df.where(tests[op](F.col(col)))


def normalise_svf(surface: DataFrame, col: str = "svf") -> DataFrame:
    """Divide by the survey's maximum where that exceeds 1.5."""
    top = surface.groupBy("survey_id").agg(F.max(col).alias("_top"))
    return surface.join(top, "survey_id").withColumn(col, F.when(F.col("_top") > 1.5, F.col(col) / F.col("_top")).otherwise(F.col(col))).drop("_top")


def _regions(masked: DataFrame, value: str, block: int) -> tuple[DataFrame, DataFrame]:
    lab = label(masked.select("survey_id", "row", "col", F.col(value).alias("_v")), block)
    return lab, region_stats(lab, "_v")


def _found(name: str, lab: DataFrame, kept: DataFrame, score: Column, kind, area: Column, **morph: Column) -> Found:
    cands = as_candidates(kept, name, score, kind, area, **morph)
    return Found(cands, lab.select(*REGION, "row", "col").join(kept.select(*REGION), REGION, "left_semi"))


@register_pass("fill_difference", ["fill_diff"], min_depth_m=0.5, min_area_m2=25.0, max_area_m2=5000.0, res=1.0, block=BLOCK)
def fill_difference(surface, min_depth_m, min_area_m2, max_area_m2, res, block) -> Found:
    lab, stats = _regions(mask(sanitise(surface, "fill_diff"), "fill_diff", ">", min_depth_m), "fill_diff", block)
    area = F.col("cells") * (res * res)
    kept = stats.where((area >= min_area_m2) & (area <= max_area_m2))
    return _found("fill_difference", lab, kept, saturating("max_v", 5.0), "depression", area, depth_m=F.col("max_v"))


@register_pass("local_relief_model", [], threshold_m=0.3, min_area_m2=10.0, max_area_m2=5000.0, res=1.0, block=BLOCK)
def local_relief_model(surface, threshold_m, min_area_m2, max_area_m2, res, block) -> Found:
    scales = [c for c in surface.columns if c.startswith("lrm_")]
    if not scales:
        raise ValueError("pass local_relief_model needs at least one lrm_* column")
    # a cell counts only where every scale has a value, as an elementwise minimum with missing values would
    known = F.lit(True)
    for c in scales:
        known = known & F.col(c).isNotNull()
    least = F.least(*[F.col(c) for c in scales]) if len(scales) > 1 else F.col(scales[0])
    lab, stats = _regions(surface.withColumn("_lrm", F.when(known, least)).where(F.col("_lrm") < -threshold_m), "_lrm", block)
    area = F.col("cells") * (res * res)
    kept = stats.where((area >= min_area_m2) & (area <= max_area_m2))
    return _found("local_relief_model", lab, kept, F.least(-F.col("min_v") / 3.0, F.lit(1.0)), "cave_entrance", area, lrm_anomaly_m=-F.col("min_v"))


def _low_pass(surface, name, col, threshold, min_area_pixels, max_area_pixels, score, kind, key, res, block) -> Found:
    lab, stats = _regions(mask(surface, col, "<", threshold), col, block)
    kept = stats.where(F.col("cells") >= min_area_pixels)
    if max_area_pixels > 0:
        kept = kept.where(F.col("cells") <= max_area_pixels)
    return _found(name, lab, kept, score, kind, F.col("cells") * (res * res), **{key: F.col("min_v")})


@register_pass("tpi", ["tpi"], threshold=-1.0, min_area_pixels=4, max_area_pixels=0, res=1.0, block=BLOCK)
def tpi(surface, threshold, min_area_pixels, max_area_pixels, res, block) -> Found:
    clean = sanitise(surface, "tpi", hi=None, lo=-9000)
    return _low_pass(clean, "tpi", "tpi", threshold, min_area_pixels, max_area_pixels, saturating("min_v", 5.0), "sinkhole", "min_tpi", res, block)


@register_pass("curvature", ["profile_curvature"], threshold=-0.02, min_area_pixels=4, max_area_pixels=0, res=1.0, block=BLOCK)
def curvature(surface, threshold, min_area_pixels, max_area_pixels, res, block) -> Found:
    return _low_pass(surface, "curvature", "profile_curvature", threshold, min_area_pixels, max_area_pixels, saturating("min_v", 0.1), "depression",
                     "min_curvature", res, block)


@register_pass("sky_view_factor", ["svf"], threshold=0.75, min_area_pixels=4, max_area_pixels=0, res=1.0, block=BLOCK)
def sky_view_factor(surface, threshold, min_area_pixels, max_area_pixels, res, block) -> Found:
    score = F.least(F.greatest(1 - F.col("min_v"), F.lit(0.0)), F.lit(1.0))
    return _low_pass(normalise_svf(surface), "sky_view_factor", "svf", threshold, min_area_pixels, max_area_pixels, score, "depression", "min_svf", res, block)


@register_pass("morphometric_filter", ["z", "fill_diff"], min_depth_m=0.3, min_area_m2=25.0, max_area_m2=4000.0, min_circularity=0.15, res=1.0, block=BLOCK)
def morphometric_filter(surface, min_depth_m, min_area_m2, max_area_m2, min_circularity, res, block) -> Found:
    """Depth and volume come from the fill difference inside each region; the score is the mean of depth score and circularity."""
    clean = sanitise(surface, "fill_diff")
    lab = label(mask(clean, "fill_diff", ">", min_depth_m).select("survey_id", "row", "col"), block)
    keep = ["survey_id", "row", "col", F.col("fill_diff").alias("_d"), "z"] + (["slope"] if "slope" in surface.columns else [])
    shape = batch_morphometrics(lab, clean.select(*keep), res, block)
    depth, circ, area = F.col("depth_m"), F.col("circularity"), F.col("area_m2")
    kept = shape.where((area >= min_area_m2) & (area <= max_area_m2) & (circ >= min_circularity) & (depth >= min_depth_m))
    kept = kept.withColumns({"centroid_row": F.col("centroid_row") + 0.5, "centroid_col": F.col("centroid_col") + 0.5})
    extra = {"wall_slope_deg": F.col("wall_slope_deg")} if "slope" in surface.columns else {}
    return _found("morphometric_filter", lab, kept, (F.least(depth / 5.0, F.lit(1.0)) + circ) / 2.0, classify("depth_m", "area_m2", "circularity"), area,
                  depth_m=depth, perimeter_m=F.col("perimeter_m"), circularity=circ, k_value=F.col("k_value"), volume_m3=F.col("volume_m3"),
                  elongation=F.col("elongation_bbox"), depth_area_ratio=depth / area, **extra)


def _point_pass(grid, name, col, keep, min_cells, best, score, key, area_key, cell, block) -> Found:
    lab, stats = _regions(grid.where(keep), col, block)
    kept = stats.where(F.col("cells") >= min_cells)
    area = F.col("cells") * (cell * cell)
    return _found(name, lab, kept, score, "cave_entrance", area, **{key: F.col(best), area_key: area})


@register_pass("point_density", ["x", "y"], reads="points", cell_size_m=2.0, z_score_threshold=-2.5, block=BLOCK)
def density_voids(points, cell_size_m, z_score_threshold, block) -> Found:
    grid = point_density(points, cell_size_m)
    return _point_pass(grid, "point_density", "z_score", F.col("z_score") < z_score_threshold, 2, "min_v", saturating("min_v", 5.0), "density_z_score",
                       "void_area_m2", cell_size_m, block)


@register_pass("multi_return", ["x", "y", "classification", "number_of_returns"], reads="points", search_radius_m=5.0, min_multi_return_ratio=0.4, block=BLOCK)
def multi_return(points, search_radius_m, min_multi_return_ratio, block) -> Found:
    grid = multi_return_ratio(points, search_radius_m)
    return _point_pass(grid, "multi_return", "ratio", F.col("ratio") > min_multi_return_ratio, 2, "max_v", F.least("max_v", F.lit(1.0)), "multi_return_ratio",
                       "anomaly_area_m2", search_radius_m, block)


def georeference(cands: DataFrame, survey: DataFrame) -> DataFrame:
    """Add projected ``x, y`` from the survey's top-left corner and spacing."""
    grid = survey.select("survey_id", "x0", "y0", "dx", "dy")
    return cands.join(grid, "survey_id").withColumns(
        {"x": F.col("x0") + F.col("col") * F.col("dx"), "y": F.col("y0") - F.col("row") * F.col("dy")}).drop("x0", "y0", "dx", "dy")

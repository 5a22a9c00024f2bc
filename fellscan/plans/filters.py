"""Filters before and after fusion, context exclusion, rim slope, and the ordered chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscan.operators.joins import in_any_rect, points_in_polygons, points_in_rects, rim_cells
from fellscan.operators.quantiles import exact_quantile

# Buffers in metres around line features.
BUFFERS = {"road": 30.0, "water": 30.0, "rail": 40.0}
ORDER = ["road", "water", "rail", "landuse"]
REASONS = ["score", "area", "depth_low", "depth_high", "elongation", "circularity"]


def _m(key: str, default: float | None = None) -> Column:
    v = F.col("morphometrics")[key]
    return v if default is None else F.coalesce(v, F.lit(default))


def pre_fusion_filter(cands: DataFrame) -> DataFrame:
    """score > 0.15, area > 20 and depth (else relief anomaly, else 0) < 200."""
    return cands.where((F.col("score") > 0.15) & (_m("area_m2", 0.0) > 20) & (F.coalesce(_m("depth_m"), _m("lrm_anomaly_m", 0.0)) < 200))


def with_gate(cands: DataFrame, min_score=0.15, min_area=20.0, min_depth=0.3, max_depth=150.0, min_elong=0.4, min_circ=0.3) -> DataFrame:
    """Add ``reject_reason``: the first failed test in order, null when all pass. Bounds themselves are rejected."""
    depth = _m("depth_m", 0.0)
    deepest = F.when(depth != 0, depth).otherwise(_m("lrm_anomaly_m", 0.0))
    reason = (
        F.when(F.col("score") <= min_score, "score").when(_m("area_m2", 0.0) <= min_area, "area").when(depth <= min_depth, "depth_low")
        .when(deepest >= max_depth, "depth_high").when(_m("elongation", 1.0) <= min_elong, "elongation").when(_m("circularity", 1.0) <= min_circ, "circularity"))
    return cands.withColumn("reject_reason", reason)


def post_fuse_gate(cands: DataFrame, **bounds) -> DataFrame:
    return with_gate(cands, **bounds).where(F.col("reject_reason").isNull()).drop("reject_reason")


def gate_report(cands: DataFrame, **bounds) -> DataFrame:
    return with_gate(cands, **bounds).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def store_filter(cands: DataFrame) -> DataFrame:
    """Thresholds at the point of storing; experimental candidates pass untouched."""
    ok = (F.col("score") > 0.4) & (_m("area_m2", 0.0) > 50) & (_m("depth_m", 0.0) < 100) & (_m("circularity", 1.0) > 0.15) & (_m("elongation", 1.0) > 0.2)
    return cands.where(ok | F.coalesce(F.col("experimental"), F.lit(False))) if "experimental" in cands.columns else cands.where(ok)


def _inside(points: DataFrame, areas: DataFrame, size: float, x: str, y: str) -> DataFrame:
    """Points inside some area; a point in several polygons comes several times."""
    if "ring" in areas.columns:
        return points_in_polygons(points, areas, size, "id", x, y)
    return in_any_rect(points, areas, size, x, y)


def exclude_buildings(cands: DataFrame, buildings: DataFrame, cemeteries: DataFrame | None = None, key: str = "cand_id", size: float = 0.01) -> DataFrame:
    """Drop candidates inside a building; a building whose centroid lies in a cemetery does not count.

    Areas are rectangles (west..north) or polygons (``ring``), in the candidates' coordinates.
    """
    if cemeteries is not None:
        if "ring" in buildings.columns:
            mean = lambda f: F.aggregate(F.slice("ring", 1, F.size("ring") - 1), F.lit(0.0), lambda a, p: a + f(p)) / (F.size("ring") - 1)
            centre = buildings.select(F.col("id").alias("_b"), mean(lambda p: p.lon).alias("lon"), mean(lambda p: p.lat).alias("lat"))
        else:
            centre = buildings.select(F.col("id").alias("_b"), ((F.col("west") + F.col("east")) / 2).alias("lon"), ((F.col("south") + F.col("north")) / 2).alias("lat"))
        exempt = _inside(centre, cemeteries, size, "lon", "lat").select(F.col("_b").alias("id")).distinct()
        buildings = buildings.join(exempt, "id", "left_anti")
    hit = _inside(cands.select(key, "lon", "lat"), buildings, size, "lon", "lat").select(key).distinct()
    return cands.join(hit, key, "left_anti")


def _segment_distance() -> Column:
    c = F.col
    vx, vy = c("x2") - c("x1"), c("y2") - c("y1")
    wx, wy = c("x") - c("x1"), c("y") - c("y1")
    t = F.greatest(F.least(F.when(vx * vx + vy * vy > 0, (wx * vx + wy * vy) / (vx * vx + vy * vy)).otherwise(F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.sqrt((wx - t * vx) ** 2 + (wy - t * vy) ** 2)


def near_segments(points: DataFrame, segments: DataFrame, buffers: dict[str, float], bucket: float = 100.0) -> DataFrame:
    """Distinct (point columns, layer) for points within the layer's buffer of a segment.

    Each segment is first cut into pieces no longer than a bucket, so a long road reaches only the buckets it passes.
    """
    reach = F.element_at(F.create_map(*[x for k, v in buffers.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("layer"))
    seg = segments.where(F.col("layer").isin(list(buffers))).withColumn("_r", reach)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    parts = F.greatest(F.ceil(length / bucket), F.lit(1))
    seg = seg.withColumn("_n", parts).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    span = lambda a, b: F.sequence(
        F.floor((F.least(at(a, b, F.col("_i")), at(a, b, F.col("_i") + 1)) - F.col("_r")) / bucket),
        F.floor((F.greatest(at(a, b, F.col("_i")), at(a, b, F.col("_i") + 1)) + F.col("_r")) / bucket))
    seg = seg.withColumn("_gx", F.explode(span("x1", "x2"))).withColumn("_gy", F.explode(span("y1", "y2")))
    # whole segments are compared, so pieces of one segment sharing a bucket collapse to one row
    seg = seg.select("layer", "_r", "x1", "y1", "x2", "y2", "_gx", "_gy").distinct()
    placed = points.withColumn("_gx", F.floor(F.col("x") / bucket)).withColumn("_gy", F.floor(F.col("y") / bucket))
    return placed.join(seg, ["_gx", "_gy"]).where(_segment_distance() <= F.col("_r")).select(*points.columns, "layer").distinct()


def infrastructure_verdict(cands: DataFrame, cells: DataFrame, segments: DataFrame, areas: DataFrame | None = None, buffers: dict[str, float] = BUFFERS,
                           min_overlap: float = 0.3, key: str = "cand_id", size: float = 100.0) -> DataFrame:
    """Add ``reject_layer``: the first layer (road, water, rail, landuse) covering at least ``min_overlap`` of the candidate's
    cells, or its centre when it has none. Springs are exempt from water."""
    member = cells.select(key, "x", "y")
    bare = cands.join(member.select(key).distinct(), key, "left_anti").select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    spots = member.unionByName(bare)
    hits = near_segments(spots, segments, buffers, size)
    if areas is not None:
        land = points_in_rects(spots, areas.select("west", "south", "east", "north"), size, "x", "y").select(*spots.columns, F.lit("landuse").alias("layer"))
        hits = hits.unionByName(land.distinct())
    total = spots.groupBy(key).agg(F.count("*").alias("n"))
    share = hits.groupBy(key, "layer").agg(F.count("*").alias("k")).join(total, key).where(F.col("k") / F.col("n") >= min_overlap)
    kinds = share.join(cands.select(key, "feature_type"), key).where(~((F.col("layer") == "water") & (F.col("feature_type") == "spring")))
    first = kinds.groupBy(key).agg(F.min(F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("layer"))).alias("_o"))
    named = first.select(key, F.element_at(F.array(*[F.lit(x) for x in ORDER]), F.col("_o").cast("int")).alias("reject_layer"))
    return cands.join(named, key, "left")


def exclude_infrastructure(cands: DataFrame, cells: DataFrame, segments: DataFrame, areas: DataFrame | None = None, **kw) -> DataFrame:
    return infrastructure_verdict(cands, cells, segments, areas, **kw).where(F.col("reject_layer").isNull()).drop("reject_layer")


def rim_filter(cands: DataFrame, surface: DataFrame, ring_factor: float = 2.0, max_mean: float = 11.3, max_p90: float = 25.0, min_cells: int = 5,
               dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Drop candidates whose rim is steep on average or at its 90th percentile; thin rims and missing outlines stay.

    ``cands``: (survey_id, region_id, centroid_row, centroid_col, area_m2, ...); ``surface`` carries ``slope``.
    """
    if ring_factor <= 1:
        return cands
    sized = cands.where(F.col("area_m2") > 0).select("survey_id", "region_id", "centroid_row", "centroid_col", "area_m2")
    ring = rim_cells(sized, surface.where(F.col("slope").isNotNull()).select("survey_id", "row", "col", "slope"), ring_factor, dx, dy)
    keys = ["survey_id", "region_id"]
    stats = ring.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("slope").alias("mean_deg"))
    p90 = exact_quantile(ring, keys, "slope", 0.9, "p90_deg")
    steep = stats.join(p90, keys).where((F.col("n") >= min_cells) & ((F.col("mean_deg") > max_mean) | (F.col("p90_deg") > max_p90)))
    return cands.join(steep.select(*keys), keys, "left_anti")


def cap_per_tile(df: DataFrame, n: int = 200, tile: str = "tile_id", score: str = "score", key: str = "cand_id") -> DataFrame:
    """Best ``n`` per tile; the rank limit is applied before the exchange as well."""
    w = Window.partitionBy(tile).orderBy(F.desc(score), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def post_fuse_chain(cands: DataFrame, filters: list[Callable[[DataFrame], DataFrame]] | None = None, cap: int | None = None, tile: str = "tile_id",
                    key: str = "cand_id", **gate) -> DataFrame:
    """Gate, then each injected filter in order, then the per-tile cap last (None: all stay). Experimental candidates skip all but the cap."""
    flag = F.coalesce(F.col("experimental"), F.lit(False)) if "experimental" in cands.columns else F.lit(False)
    plain = post_fuse_gate(cands.where(~flag), **gate)
    for step in filters or []:
        plain = plain.transform(step)
    out = plain.unionByName(cands.where(flag))
    return out if cap is None else cap_per_tile(out, cap, tile, key=key)

"""Whole jobs: points to terrain, terrain to candidates, candidates to stored detections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscan.functions.geodesy import with_lonlat
from fellscan.operators.blocks import BLOCK, KEYS
from fellscan.operators.fill import fill_depressions
from fellscan.operators.focal import derive, discovery_surface, lrm
from fellscan.operators.horizon import horizon
from fellscan.operators.pointgrid import extent, grid_mean, ground_share, smrf
from fellscan.plans import discovery, passes  # noqa: F401  (declare the passes)
from fellscan.plans.filters import exclude_buildings, exclude_infrastructure, post_fuse_chain, pre_fusion_filter, rim_filter
from fellscan.plans.fusion import DISCOVERY, cluster, enrich, merge_clusters, reclassify, union_passes
from fellscan.plans.registry import get_pass
from fellscan.session import cut_lineage, hold
from fellscan.sources.presets import Preset, preset

SVF_RADIUS = 10.0


def build_terrain(points: DataFrame, res: float = 1.0, radius: float = 1.5, pre_classified: bool | None = None, block: int = BLOCK,
                  kernels: tuple[int, ...] = (50, 100, 200), svf_radius: float = SVF_RADIUS, **smrf_args) -> DataFrame:
    """Ground points gridded, filled, and derived: one row per cell with every derivative a preset may read.

    ``pre_classified``: True trusts class 2, False filters ground first; None decides for each survey by its ground share.
    The lattice starts at the top-left corner of all points, ground or not.
    """
    filtered = lambda p: smrf(p, res=res, block=block, **smrf_args).where("ground").select(*points.columns)
    if pre_classified is None:
        marked = points.join(ground_share(points).select("survey_id", F.col("pre_classified").alias("_trusted")), "survey_id")
        trusted = marked.where("_trusted AND classification = 2").select(*points.columns)
        ground = trusted.unionByName(filtered(marked.where("NOT _trusted").select(*points.columns)))
    else:
        ground = points.where("classification = 2") if pre_classified else filtered(points)
    return add_derivatives(grid_mean(ground, res, radius, bounds=extent(points)), res, kernels, svf_radius, block)


def add_derivatives(dem: DataFrame, res: float = 1.0, kernels: tuple[int, ...] = (50, 100, 200), svf_radius: float = SVF_RADIUS, block: int = BLOCK,
                    needs: set[str] | None = None) -> DataFrame:
    """The derivative columns on (survey_id, row, col, z); ``needs`` leaves out groups nobody asked for."""
    want = needs or {"fill_diff", "lrm", "svf", "focal"}
    out = dem.select(*KEYS, "z")
    if "fill_diff" in want:
        out = fill_depressions(out, block).withColumn("fill_diff", F.col("filled") - F.col("z"))
    if "lrm" in want:
        for k in kernels:
            out = lrm(out, k, block=block)
    if "svf" in want:
        keep = [c for c in out.columns if c not in (*KEYS, "z")]
        out = horizon(out, svf_radius, ("svf",), res, res, ["z", *keep], block)
    if "focal" in want:
        out = derive(out, ["slope", "hillshade", "tpi", "roughness", "profile_curvature", "plan_curvature"] if res == 1.0 else _scaled(res), block)
    return out


def _scaled(res: float) -> dict:
    from fellscan.operators.focal import product

    return {n: product(n, res, res) for n in ("slope", "hillshade", "tpi", "roughness", "profile_curvature", "plan_curvature")}


def _settings(p: Preset, name: str, res: float, block: int) -> dict:
    extra = {"block": block}
    if name in DISCOVERY:
        extra.update(dx=res, dy=res)
    elif name not in ("point_density", "multi_return"):
        extra["res"] = res
    return {**p.params.get(name, {}), **extra}


def _point_places(cands: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """x, y in metres from the surface's corner; a point grid has cells of its own and starts at the outermost points."""
    corner = extent(points).select("survey_id", "x0", "y1")
    x = F.col("x0") + F.col("col") * cell - F.floor("x0")
    y = F.ceil("y1") - (F.col("y1") - F.col("row") * cell)
    return cands.join(corner, "survey_id").withColumns({"x": x, "y": y}).drop("x0", "y1")


@dataclass
class Context:
    """What is known around the surveys. ``surveys``: (survey_id, epsg), UTM zones north (326zz) or south (327zz), or with the
    surface's top-left corner (x0, y1) where no points say it. Each other part may be left out, and its filter then is.

    ``buildings``, ``cemeteries``: (id, west, south, east, north) or (id, ring), in degrees. ``segments``: (layer, x1, y1, x2,
    y2) and ``areas``: (west, south, east, north), in metres of the surveys' system; with an ``epsg`` column they meet only
    candidates of their own system.
    """

    surveys: DataFrame
    buildings: DataFrame | None = None
    cemeteries: DataFrame | None = None
    segments: DataFrame | None = None
    areas: DataFrame | None = None
    rim: bool = True


@dataclass
class Detected:
    """Candidates after fusion, the cells of their outlines (cand_id, survey_id, row, col), and what each pass gave to a cluster."""

    candidates: DataFrame
    outlines: DataFrame | None
    members: DataFrame | None


def frames(context: Context, points: DataFrame | None) -> DataFrame:
    """survey_id, epsg, and where the surface's top-left corner lies."""
    if "x0" in context.surveys.columns:
        return context.surveys.select("survey_id", "epsg", "x0", "y1")
    if points is None:
        raise ValueError("surveys without x0 and y1 need points")
    return context.surveys.select("survey_id", "epsg").join(extent(points).select("survey_id", "x0", "y1"), "survey_id")


def georeference(cands: DataFrame) -> DataFrame:
    """Add lon, lat of (epsg, x, y), UTM metres; rows without a finite position are dropped, other systems stop the job."""
    epsg = F.col("epsg")
    known = F.when(epsg.between(32601, 32660) | epsg.between(32701, 32760), epsg).otherwise(F.raise_error(F.concat(F.lit("no UTM zone: EPSG "), epsg.cast("string"))).cast("int"))
    placed = with_lonlat(cands.withColumn("epsg", known), F.col("x"), F.col("y"), F.col("epsg") % 100, F.col("epsg") > 32700)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= 360)
    # checkpointed, so that the test is not rewritten into a second evaluation of the series
    return cut_lineage(placed).where(finite("lon") & finite("lat"))


def detect(surface: DataFrame, points: DataFrame | None, name: str | Preset, eps: float = 10.0, res: float = 1.0, block: int = BLOCK, where: DataFrame | None = None) -> Detected:
    """Every pass of the preset, pre-filter, fusion in metres, enrichment and reclassification; shape families join unfused.

    Without ``where`` (see ``frames``) each survey is fused alone, x and y being metres from its top-left corner, y downwards
    (whole metres outside all of its points, where points are given). With it x and y are eastings and northings, and
    candidates of overlapping surveys of one system are fused together; the outline's survey names the result.
    """
    p = preset(name) if isinstance(name, str) else name
    surface = hold(surface)
    plain, shape, cells = [], [], []
    forms = None
    scope = "survey_id" if where is None else "epsg"

    def on_surface(found: DataFrame) -> DataFrame:
        if where is None:
            return found.withColumns({"x": F.col("col") * res, "y": F.col("row") * res})
        return found.join(where, "survey_id").withColumns({"x": F.col("x0") + F.col("col") * res, "y": F.col("y1") - F.col("row") * res}).drop("x0", "y1")

    def on_points(found: DataFrame, cell: float) -> DataFrame:
        if where is None:
            return _point_places(found, points, cell)
        own = extent(points).select("survey_id", "x0", "y1").join(where.select("survey_id", "epsg"), "survey_id")
        return found.join(own, "survey_id").withColumns({"x": F.col("x0") + F.col("col") * cell, "y": F.col("y1") - F.col("row") * cell}).drop("x0", "y1")

    for n in p.passes:
        step = get_pass(n)
        if step.reads == "points":
            if points is None:
                continue
            used = {**step.defaults, **_settings(p, n, res, block)}
            found = step(points, **used)
            plain.append(on_points(found.candidates, used["cell_size_m"] if "cell_size_m" in used else used["search_radius_m"]))
            continue
        elif n in DISCOVERY:
            forms = hold(discovery_surface(surface.select(*KEYS, "z"), res, res, block)) if forms is None else forms
            found = step(forms, **_settings(p, n, res, block))
        else:
            found = step(surface, **_settings(p, n, res, block))
        (shape if n in DISCOVERY else plain).append(on_surface(found.candidates))
        if found.cells is not None and n not in DISCOVERY:
            cells.append(found.cells.withColumn("pass_name", F.lit(n)))
    ident = F.concat_ws(":", "survey_id", "pass_name", F.col("region_id").cast("string"))
    outlined = F.lit(False) if not cells else F.col("pass_name").isin([n for n in p.passes if get_pass(n).reads != "points"])
    place = ["survey_id", *([] if where is None else ["epsg"]), "region_id", "pass_name", "x", "y"]
    centre = [F.col("row").alias("centroid_row"), F.col("col").alias("centroid_col")]
    parts, outline, members = [], None, None
    if plain:
        cands = cut_lineage(pre_fusion_filter(union_passes(*plain)).withColumns({"cand_id": ident, "has_outline": outlined}))
        members = cut_lineage(cluster(cands, eps, "metric", scope))
        fused = cut_lineage(merge_clusters(members, p.weights, scope=scope, coords="metric").where(F.col("score") >= p.min_confidence))
        if cells:
            outline = union_passes(*cells).withColumn("outline_id", ident)
            own = outline.join(fused.select("outline_id"), "outline_id", "left_semi").withColumn("survey_id", F.col("survey_id"))
            keep = ["survey_id", "row", "col", "z"] + (["slope"] if "slope" in surface.columns else [])
            fused = enrich(fused, _apart(own), _shared(surface.select(*keep), own), res)
            outline = own.select(F.col("outline_id").alias("cand_id"), "survey_id", "row", "col")
        winner = cands.select(F.col("cand_id").alias("outline_id"), *[c for c in ("survey_id", "region_id", "pass_name") if c != scope], *centre, "has_outline")
        fused = reclassify(fused).join(winner, "outline_id")
        parts.append(fused.select(*place, F.col("outline_id").alias("cand_id"), "cluster_id", "centroid_row", "centroid_col", "has_outline", "score", "feature_type", "morphometrics", "source_passes", F.lit(False).alias("experimental")))
    if shape:
        forms_ = union_passes(*shape).where(F.col("score") >= p.min_confidence).withColumn("cand_id", ident)
        parts.append(forms_.select(*place, "cand_id", F.col("cand_id").alias("cluster_id"), *centre, F.lit(False).alias("has_outline"), "score", "feature_type", "morphometrics", F.array("pass_name").alias("source_passes"), F.lit(True).alias("experimental")))
    out = union_passes(*parts).withColumn("area_m2", F.col("morphometrics")["area_m2"])
    return Detected(out if where is None else georeference(out), outline, members)


def run_preset(surface: DataFrame, points: DataFrame | None, name: str | Preset, eps: float = 10.0, res: float = 1.0, block: int = BLOCK) -> DataFrame:
    """The candidates of ``detect``, each survey on its own."""
    return detect(surface, points, name, eps, res, block).candidates


def _apart(cells: DataFrame) -> DataFrame:
    """Outlines of different passes may overlap, so each pass gets its own copy of the lattice."""
    return cells.withColumn("survey_id", F.concat_ws("#", "survey_id", "pass_name")).drop("pass_name")


def _shared(surface: DataFrame, cells: DataFrame) -> DataFrame:
    """The surface cells under the outlines, once per pass copy."""
    want = cells.select("survey_id", "row", "col", "pass_name").distinct()
    return want.join(surface, KEYS).withColumn("survey_id", F.concat_ws("#", "survey_id", "pass_name")).drop("pass_name")


def context_filters(context: Context, found: Detected, surface: DataFrame, where: DataFrame, res: float = 1.0) -> list[Callable[[DataFrame], DataFrame]]:
    """Buildings, then infrastructure, then steep rims, for what the context holds."""
    steps: list[Callable[[DataFrame], DataFrame]] = []
    if context.buildings is not None:
        steps.append(lambda c: exclude_buildings(c, context.buildings, context.cemeteries))
    if context.segments is not None or context.areas is not None:
        apart = context.segments is not None and "epsg" in context.segments.columns or context.areas is not None and "epsg" in context.areas.columns

        def of_system(df: DataFrame, *xs: str) -> DataFrame:
            # eastings stay below 10 million metres, so systems never meet when each is moved by its own number of them
            return df.withColumns({x: F.col(x) + F.col("epsg") * 1e7 for x in xs}) if apart else df

        def infrastructure(c: DataFrame) -> DataFrame:
            spark = c.sparkSession
            segments = context.segments if context.segments is not None else spark.createDataFrame([], "layer string, epsg int, x1 double, y1 double, x2 double, y2 double")
            cells = spark.createDataFrame([], "cand_id string, epsg int, x double, y double")
            if found.outlines is not None:
                own = found.outlines.join(c.select("cand_id"), "cand_id", "left_semi").join(where, "survey_id")
                cells = own.select("cand_id", "epsg", (F.col("x0") + (F.col("col") + 0.5) * res).alias("x"), (F.col("y1") - (F.col("row") + 0.5) * res).alias("y"))
            areas = None if context.areas is None else of_system(context.areas, "west", "east")
            kept = exclude_infrastructure(of_system(c, "x"), of_system(cells, "x"), of_system(segments, "x1", "x2"), areas)
            return c.join(kept.select("cand_id"), "cand_id", "left_semi")

        steps.append(infrastructure)
    if context.rim and "slope" in surface.columns:

        def rim(c: DataFrame) -> DataFrame:
            # outlines of two passes may share a first cell, so rings are told apart by candidate
            shaped = c.where("has_outline").select("survey_id", F.col("cand_id").alias("region_id"), "centroid_row", "centroid_col", "area_m2")
            kept = rim_filter(shaped, surface, dx=res, dy=res).select(F.col("region_id").alias("cand_id"))
            return c.where("NOT has_outline").unionByName(c.where("has_outline").join(kept, "cand_id", "left_semi"))

        steps.append(rim)
    return steps


def survey_to_detections(points: DataFrame | None, name: str | Preset, filters: list[Callable[[DataFrame], DataFrame]] | None = None, res: float = 1.0, cap: int | None = None,
                         block: int = BLOCK, terrain: DataFrame | None = None, context: Context | None = None, eps: float = 10.0, tile_cells: int = 1000) -> DataFrame:
    """Points of all surveys to filtered detections in one job.

    With a ``context`` candidates are georeferenced, fused across surveys and passed through its filters, before the given
    ones. ``tile_id`` is the square of ``tile_cells`` cells a detection lies in; ``cap`` keeps the best of each, None all.
    """
    surface = cut_lineage(terrain if terrain is not None else build_terrain(points, res, block=block))
    where = None if context is None else frames(context, points)
    found = detect(surface, points, name, eps, res, block, where)
    tile = F.concat_ws(":", "survey_id", *[F.floor(F.col(c) / tile_cells).cast("string") for c in ("centroid_row", "centroid_col")])
    steps = [] if context is None else context_filters(context, found, surface, where, res)
    return post_fuse_chain(cut_lineage(found.candidates.withColumn("tile_id", tile)), [*steps, *(filters or [])], cap)


def stored_rows(detections: DataFrame) -> DataFrame:
    """Detections as they are stored: measures as columns, a depth of 0 giving way to the relief anomaly, the rest rounded."""
    m = F.col("morphometrics")
    depth = F.coalesce(F.nullif(m["depth_m"], F.lit(0.0)), m["lrm_anomaly_m"])
    return detections.select(
        "cand_id", "tile_id", "survey_id", *[c for c in ("lon", "lat") if c in detections.columns], "feature_type", F.col("score").alias("confidence"), depth.alias("depth_m"),
        *[m[c].alias(c) for c in ("area_m2", "circularity", "wall_slope_deg")], "source_passes", F.transform_values(m, lambda _, v: F.round(v, 4)).alias("morphometrics"), "experimental")


def pass_results(detections: DataFrame, members: DataFrame, scope: str = "epsg") -> DataFrame:
    """What each pass gave to a stored detection: (cand_id, pass_name, raw_score, parameters)."""
    kept = detections.where("NOT experimental").select(scope, "cluster_id", F.col("cand_id").alias("detection"))
    of = members.select(scope, "cluster_id", "pass_name", F.col("score").alias("raw_score"), F.col("morphometrics").alias("parameters"))
    return of.join(kept, [scope, "cluster_id"]).select(F.col("detection").alias("cand_id"), "pass_name", "raw_score", "parameters")


def job_summary(candidates: DataFrame, detections: DataFrame) -> DataFrame:
    """Per survey: candidates after fusion, those stored, and the mean and best confidence of these."""
    raw = candidates.groupBy("survey_id").agg(F.count("*").alias("raw_candidates"))
    stored = detections.groupBy("survey_id").agg(F.count("*").alias("stored"), F.avg("score").alias("mean_confidence"), F.max("score").alias("best_confidence"))
    return raw.join(stored, "survey_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))

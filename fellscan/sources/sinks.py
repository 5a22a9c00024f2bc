"""Detections out: stored rows, child rows, GeoJSON, CSV, vector-tile rows, tile plans, notebooks, context catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscan.functions.contracts import drop_nonfinite
from fellscan.functions.scalars import FEATURE_TYPES, tile_bounds, tile_position


def to_detections(cands: DataFrame, job_id: str, preset: str, key: str = "cand_id") -> DataFrame:
    """Stored form of fused candidates; needs lon, lat, score, feature_type, morphometrics. Ids follow from job and key."""
    m = F.col("morphometrics")
    known = F.when(F.col("feature_type").isin(FEATURE_TYPES), F.col("feature_type")).otherwise("unknown")
    return drop_nonfinite(cands, "lon", "lat").select(
        F.sha2(F.concat_ws("|", F.lit(job_id), F.col(key).cast("string")), 256).alias("id"), F.col(key), "lon", "lat", known.alias("feature_type"),
        F.col("score").alias("confidence"), F.coalesce(F.nullif(m["depth_m"], F.lit(0.0)), m["lrm_anomaly_m"]).alias("depth_m"), m["area_m2"].alias("area_m2"),
        m["circularity"].alias("circularity"), m["wall_slope_deg"].alias("wall_slope_deg"), F.transform_values(m, lambda _, v: F.round(v, 4)).alias("morphometrics"),
        F.lit(job_id).alias("job_id"), F.lit(preset).alias("preset"))


def pass_results(detections: DataFrame, members: DataFrame, key: str = "cand_id") -> DataFrame:
    """One child row per contributing candidate: (detection_id, pass_name, raw_score, parameters)."""
    return members.join(detections.select(F.col("id").alias("detection_id"), F.col(key).alias("cluster_id")), "cluster_id").select(
        "detection_id", "pass_name", F.round("score", 4).alias("raw_score"), F.transform_values("morphometrics", lambda _, v: F.round(v, 4)).alias("parameters"))


def to_geojson(df: DataFrame, limit: int | None = 100_000) -> DataFrame:
    """One GeoJSON feature per row (``value`` column, ready for ``write.text``), highest confidence first up to the export limit."""
    rows = df.orderBy(F.desc("confidence"), "id").limit(limit) if limit is not None else df
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    props = F.struct(*[c for c in df.columns if c not in ("lon", "lat")])
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value"))


CSV_COLUMNS = ["id", "feature_type", "lon", "lat", "confidence", "depth_m", "area_m2", "validated", "created_at"]


def to_csv_rows(df: DataFrame, limit: int | None = 100_000) -> DataFrame:
    """The nine export columns, highest confidence first."""
    rows = df.orderBy(F.desc("confidence"), "id").limit(limit) if limit is not None else df
    return rows.select(*CSV_COLUMNS)


def vector_tile_rows(df: DataFrame, zooms: list[int], extent: int = 4096, buffer: int = 256, cap: int = 100_000, min_confidence: float = 0.0) -> DataFrame:
    """Tile-local integer positions of every point in every zoom; a point inside a neighbour's buffer appears there too.

    The per-tile cap is the export's own limit and is ranked by confidence, applied before the exchange as well.
    """
    rows = df.where(F.col("confidence") >= min_confidence) if "confidence" in df.columns else df
    rows = rows.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    fx, fy = tile_position("lon", "lat", "z")
    pad, n = buffer / extent, F.pow(F.lit(2.0), F.col("z"))
    span = lambda f: F.sequence(F.greatest(F.floor(f - pad), F.lit(0)), F.least(F.floor(f + pad), (n - 1).cast("bigint")))
    placed = rows.withColumns({"_fx": fx, "_fy": fy}).withColumn("tx", F.explode(span(F.col("_fx")))).withColumn("ty", F.explode(span(F.col("_fy"))))
    out = placed.withColumns({"px": F.floor((F.col("_fx") - F.col("tx")) * extent).cast("int"), "py": F.floor((F.col("_fy") - F.col("ty")) * extent).cast("int")}).drop("_fx", "_fy")
    rank = F.desc("confidence") if "confidence" in df.columns else F.col("id")
    w = Window.partitionBy("z", "tx", "ty").orderBy(rank, "id")
    return out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")


def tile_plan(areas: DataFrame, zmin: int, zmax: int, max_tiles: int | None = 1500) -> DataFrame:
    """Every (area, z, x, y) needed for the areas' bounds; areas needing more than ``max_tiles`` raise."""
    zoomed = areas.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))
    x0, y0 = tile_position("west", "north", "z")
    x1, y1 = tile_position("east", "south", "z")
    spans = zoomed.withColumns({"x0": F.floor(x0), "x1": F.floor(x1), "y0": F.floor(y0), "y1": F.floor(y1)})
    if max_tiles is not None:
        total = spans.groupBy("area").agg(F.sum((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).alias("_t"))
        checked = total.where(F.when(F.col("_t") > max_tiles, F.raise_error("area needs too many tiles").cast("boolean")).otherwise(True))
        spans = spans.join(checked.select("area"), "area", "left_semi")
    return spans.select("area", "z", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("area", "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


CONTEXT_SCHEMA = """id string, name string, category string, region string, country string, date_label string, date_kind string, verified_at string, revision string,
    attribution string, source_url string, legend_url string, terms_url string, description string, limitations string, bounds array<double>, min_zoom int, max_zoom int"""


def context_catalog(df: DataFrame) -> DataFrame:
    """Sources of a catalogue document (version, sources array) with ``problem``: null, or the first rule a source breaks."""
    items = df.select("version", F.explode("sources").alias("s")).select("version", "s.*")
    b = F.col("bounds")
    w, s, e, n = (b[i] for i in range(4))
    https = lambda c: F.col(c).isNull() | F.startswith(F.col(c), F.lit("https://"))
    seen = items.groupBy("id").agg(F.count("*").alias("_n"))
    problem = (
        F.when(F.col("version") != 1, "version").when(~F.col("id").rlike("^[a-z0-9-]+$"), "id").when(F.col("_n") > 1, "duplicate")
        .when(~F.col("category").isin("historical-map", "historical-aerial", "geology", "mining"), "category")
        .when((F.size(b) != 4) | (w < -180) | (w >= e) | (e > 180) | (s < -85.051129) | (s >= n) | (n > 85.051129), "bounds")
        .when((F.col("min_zoom") > F.col("max_zoom")) | (F.col("min_zoom") < 0) | (F.col("max_zoom") > 22), "zoom")
        .when(~(https("source_url") & https("legend_url") & https("terms_url")), "link"))
    return items.join(seen, "id").withColumn("problem", problem).drop("_n").withColumns({"west": w, "south": s, "east": e, "north": n})


def context_for_tiles(tiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue sources shown on each tile (z, x, y): overlapping bounds and zoom in range.

    Sources meet tiles on the level-4 tiles they touch, so neither side is replicated whole.
    """
    def home(df: DataFrame) -> DataFrame:
        at = lambda lon, lat: tile_position(lon, F.least(F.greatest(F.col(lat), F.lit(-85.05)), F.lit(85.05)), F.lit(4))
        (x0, y0), (x1, y1) = at("west", "north"), at("east", "south")
        return df.withColumn("_hx", F.explode(F.sequence(F.floor(x0), F.floor(x1)))).withColumn("_hy", F.explode(F.sequence(F.floor(y0), F.floor(y1))))

    boxed = home(tiles.withColumns(tile_bounds("z", "x", "y")))
    cat = home(catalog.select("id", "west", "south", "east", "north", "min_zoom", "max_zoom")).select("_hx", "_hy", *[F.col(c).alias("s_" + c) for c in ("id", "west", "south", "east", "north", "min_zoom", "max_zoom")])
    hit = (F.col("east") > F.col("s_west")) & (F.col("west") < F.col("s_east")) & (F.col("north") > F.col("s_south")) & (F.col("south") < F.col("s_north"))
    zoom = (F.col("z") >= F.col("s_min_zoom")) & (F.col("z") <= F.col("s_max_zoom"))
    return boxed.join(cat, ["_hx", "_hy"]).where(hit & zoom).select("z", "x", "y", F.col("s_id").alias("source")).distinct()


def notebook_findings(df: DataFrame) -> DataFrame:
    """Findings of notebook documents (``investigations`` array of structs with ``findings``), one row each."""
    return df.select(F.explode("investigations").alias("g")).select(F.col("g.id").alias("investigation_id"), F.col("g.name").alias("investigation_name"), F.explode("g.findings").alias("f")).select(
        "investigation_id", "investigation_name", "f.*")


def findings_to_geojson(findings: DataFrame) -> DataFrame:
    """One feature per finding, its investigation id among the properties; points, lines and single-ring polygons."""
    pts = F.transform("points", lambda p: F.array(p.lon, p.lat))
    kind = F.col("geometry_type")
    coords = F.when(kind == "Point", F.to_json(F.element_at(pts, 1))).when(kind == "Polygon", F.concat(F.lit("["), F.to_json(pts), F.lit("]"))).otherwise(F.to_json(pts))
    props = F.to_json(F.struct(*[c for c in findings.columns if c not in ("points", "geometry_type")]))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct("id")), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), props, F.lit("}"))
    return findings.select(F.regexp_replace(text, r'"id":\{"id":("(?:[^"\\]|\\.)*")\}', r'"id":$1').alias("value"))


def findings_from_geojson(features: DataFrame, investigations: DataFrame) -> DataFrame:
    """Findings of exported features (id, investigation_id, ...); a feature whose investigation is unknown is an orphan."""
    known = investigations.select(F.col("id").alias("investigation_id"), F.lit(True).alias("_k"))
    return features.join(known, "investigation_id", "left").withColumn("orphan", F.col("_k").isNull()).drop("_k")

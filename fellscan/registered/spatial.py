"""Joins, queries, sinks, sources, scalar functions and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellscan.functions import contracts, geodesy
from fellscan.functions import scalars as sc
from fellscan.operators import joins, measure, reports, warp
from fellscan.plans import views
from fellscan.registered.base import rd, register, rnd, rnd_many
from fellscan.registered.fixtures import ctes, fixture, load
from fellscan.registered.terrain import DEM, KEY
from fellscan.sources import cells, feeds, sinks
from fellscan.streaming import folds

DET, SITES, TILES, CAND = ctes("detections"), ctes("sites"), ctes("tile_index"), ctes("cand")
BOX = (-79.8, 40.2, -79.3, 40.7)


def det(spark, sf):
    return fixture(spark, sf, "detections")


def tiles(spark, sf):
    return fixture(spark, sf, "tile_index")


HAV = f"(2 * {sc.EARTH_M} * asin(sqrt(least(pow(sin((radians({{b}}.lat) - radians({{a}}.lat)) / 2), 2) + cos(radians({{a}}.lat)) * cos(radians({{b}}.lat)) * pow(sin((radians({{b}}.lon) - radians({{a}}.lon)) / 2), 2), 1.0))))".format(a="a", b="b")
NEAR = "abs(a.lat - b.lat) < 0.003 AND abs(a.lon - b.lon) < 0.004"


def bucketed(a: str, b: str) -> str:
    """Join text meeting on 0.004-degree cells so the single-node side stays quick; the residual decides."""
    return f"""(SELECT *, CAST(floor(lon / 0.004) AS BIGINT) + dx AS gx, CAST(floor(lat / 0.004) AS BIGINT) + dy AS gy FROM {a}, range(-1, 2) i(dx), range(-1, 2) j(dy)) a
    JOIN (SELECT *, CAST(floor(lon / 0.004) AS BIGINT) AS gx, CAST(floor(lat / 0.004) AS BIGINT) AS gy FROM {b}) b ON a.gx = b.gx AND a.gy = b.gy"""


@register("j1_within_distance", f"WITH {DET}, {SITES} SELECT a.site_id AS a_site_id, b.id AS b_id, {rd(HAV, 4)} AS distance_m FROM {bucketed('sites', 'detections')} WHERE {HAV} <= 200")
def _j1(spark, sf):
    out = joins.within_distance(fixture(spark, sf, "sites").select("site_id", "lon", "lat"), det(spark, sf).select("id", "lon", "lat"), 200)
    return out.select("a_site_id", "b_id", rnd("distance_m", 4).alias("distance_m"))


@register("j1_count_within", f"""WITH {DET}, {SITES} SELECT s.site_id, coalesce(n, 0) AS near FROM sites s LEFT JOIN (SELECT a.site_id, count(*) AS n FROM {bucketed('sites', 'detections')}
    WHERE {HAV} <= 300 GROUP BY 1) q USING (site_id)""")
def _j1c(spark, sf):
    return joins.count_within(fixture(spark, sf, "sites"), det(spark, sf), 300, "site_id").select("site_id", "near")


@register("j2_tiles_intersecting", f"WITH {TILES} SELECT tile_id FROM tile_index WHERE west <= {BOX[2]} AND east >= {BOX[0]} AND south <= {BOX[3]} AND north >= {BOX[1]}")
def _j2(spark, sf):
    return joins.tiles_intersecting(tiles(spark, sf), BOX).select("tile_id")


@register("j3_tile_neighbours", f"""WITH {TILES}, t AS (SELECT *, CAST(floor(west / 0.05) AS BIGINT) AS gx, CAST(floor(south / 0.05) AS BIGINT) AS gy FROM tile_index),
    s AS (SELECT t.*, gx + dx AS hx, gy + dy AS hy FROM t, range(-1, 2) i(dx), range(-1, 2) j(dy))
    SELECT DISTINCT a.tile_id, b.tile_id AS neighbour_id FROM s a JOIN t b ON a.hx = b.gx AND a.hy = b.gy WHERE a.tile_id <> b.tile_id AND a.east + 100 / 111320.0 >= b.west
      AND a.west - 100 / 111320.0 <= b.east AND a.north + 100 / 111320.0 >= b.south AND a.south - 100 / 111320.0 <= b.north""")
def _j3(spark, sf):
    return joins.tile_neighbours(tiles(spark, sf))


SURVEY = ctes("survey")


@register("p14_eligibility", f"""WITH {SURVEY}, {CAND}, r AS (SELECT *, CASE WHEN epsg // 100 NOT IN (269, 326, 327) THEN 'crs' WHEN units NOT IN ('', 'm', 'metre', 'meter', 'metres', 'meters') THEN 'units'
    WHEN greatest(dx, dy) > 5 THEN 'coarse' END AS reason FROM survey), e AS (SELECT *, coalesce(reason, CASE WHEN datum IS NULL OR units = '' THEN 'undeclared' END) AS mosaic_reason FROM r)
    SELECT source_id, reason, mosaic_reason, count(cand_id) AS candidates FROM e LEFT JOIN cand ON cand_id % 25 = CAST(substr(source_id, 4) AS BIGINT) GROUP BY 1, 2, 3""")
def _p14(spark, sf):
    e = contracts.eligibility(fixture(spark, sf, "survey")).select("source_id", "reason", "mosaic_reason")
    per = fixture(spark, sf, "cand").groupBy(F.concat(F.lit("src"), F.col("cand_id") % 25).alias("source_id")).agg(F.count("*").alias("candidates"))
    return e.join(per, "source_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


@register("j4_compatible_surveys", f"""WITH {SURVEY} SELECT a.source_id AS source_a, b.source_id AS source_b, a.survey_key FROM survey a JOIN survey b ON a.survey_key = b.survey_key AND a.datum = b.datum AND a.epsg = b.epsg
    WHERE a.source_id < b.source_id AND a.dx = b.dx AND abs((b.x0 - a.x0) / a.dx - round((b.x0 - a.x0) / a.dx)) <= 1e-6""")
def _j4(spark, sf):
    return joins.compatible_surveys(fixture(spark, sf, "survey"))


MOSAIC_SRC = """ms AS (SELECT concat('k', CAST(vec_id % 3 AS VARCHAR)) AS survey_key, concat('src', CAST(vec_id % 25 AS VARCHAR)) AS source_id, vec_id // 3 % 40 AS "row", CAST(pos AS BIGINT) AS col, CAST(max(z) AS DOUBLE) AS raw
    FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(round(1000 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS z FROM embeddings) q GROUP BY 1, 2, 3, 4)"""


@register("j5_mosaic", f"""WITH {SURVEY}, {MOSAIC_SRC} SELECT survey_key, "row", col, z, source_id FROM (SELECT m.survey_key, m."row", m.col, m.raw * s.scale + s."offset" AS z, m.source_id,
    row_number() OVER (PARTITION BY m.survey_key, m."row", m.col ORDER BY s.resolution_m, s.path, m.source_id) AS k FROM ms m JOIN survey s ON s.source_id = m.source_id) q WHERE k = 1""")
def _j5(spark, sf):
    src = load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).groupBy(
        F.concat(F.lit("k"), F.col("vec_id") % 3).alias("survey_key"), F.concat(F.lit("src"), F.col("vec_id") % 25).alias("source_id"),
        F.expr("vec_id DIV 3 % 40").alias("row"), F.col("pos").cast("bigint").alias("col")).agg(F.max(F.round(1000 * F.col("v").cast("double"))).alias("raw"))
    return joins.mosaic(src, fixture(spark, sf, "survey"))


PASSES, EVENTS = ctes("pass_results"), ctes("verdicts")


@register("j8_detection_detail", f"""WITH {DET}, {PASSES}, {EVENTS}, ch AS (SELECT detection_id, 'pass' AS kind, CAST(ord AS BIGINT) AS ord, pass_name AS name, raw_score AS score FROM pass_results
    UNION ALL SELECT detection_id, 'event', CAST(seq AS BIGINT), lower(verdict), NULL FROM verdicts) SELECT d.id, kind, ord, name, score FROM detections d LEFT JOIN ch ON ch.detection_id = d.id""")
def _j8(spark, sf):
    return views.detection_detail(det(spark, sf), fixture(spark, sf, "pass_results"), fixture(spark, sf, "verdicts")).select("id", "kind", "ord", "name", "score")


@register("j11_site_recall", f"""WITH {DET}, {SITES}, q AS (SELECT a.site_id, count(*) AS n, min({HAV}) AS d FROM {bucketed('sites', 'detections')} WHERE {HAV} <= 200 GROUP BY 1)
    SELECT s.site_id, coalesce(n, 0) AS detections, {rd('d', 4)} AS nearest_m, n IS NOT NULL AS found FROM sites s LEFT JOIN q USING (site_id)""")
def _j11(spark, sf):
    return views.site_recall(fixture(spark, sf, "sites"), det(spark, sf)).select("site_id", "detections", rnd("nearest_m", 4).alias("nearest_m"), "found")


@register("j12_zonal", f"""WITH {DEM}, z AS (SELECT survey_id, "row" // 10 * 1000 + col // 8 AS region_id, z FROM dem) SELECT survey_id, region_id, count(*) AS cells, CAST(sum(z) AS BIGINT) AS sum_z FROM z GROUP BY 1, 2""")
def _j12(spark, sf):
    from fellscan.operators.regions import zonal

    d = fixture(spark, sf, "dem")
    zones = d.select("survey_id", "row", "col", (F.floor(F.col("row") / 10) * 1000 + F.floor(F.col("col") / 8)).alias("region_id"))
    return zonal(zones, d).groupBy("survey_id", "region_id").agg(F.count("*").alias("cells"), F.sum("z").alias("sum_z"))


DEMS = """dems AS (SELECT concat('dem', CAST(o_custkey AS VARCHAR)) AS dem_id, min(-80 + (o_orderkey * 17 % 2000) / 1e3) AS west, min(39 + (o_custkey * 31 % 2000) / 1e3) AS south,
    min(-80 + (o_orderkey * 17 % 2000) / 1e3) + 0.0213 AS east, min(39 + (o_custkey * 31 % 2000) / 1e3) + 0.0213 AS north FROM orders GROUP BY 1),
    ov AS (SELECT t.tile_id, d.dem_id, (least(t.east, d.east) - greatest(t.west, d.west)) * (least(t.north, d.north) - greatest(t.south, d.south)) AS overlap FROM tile_index t
      JOIN dems d ON t.east > d.west AND t.west < d.east AND t.north > d.south AND t.south < d.north),
    rk AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY overlap DESC, dem_id) AS k FROM ov)"""


def dems(spark, sf):
    o = load(spark, sf, "orders")
    west, south = F.min(-80 + F.col("o_orderkey") * 17 % 2000 / F.lit(1e3)), F.min(39 + F.col("o_custkey") * 31 % 2000 / F.lit(1e3))
    return o.groupBy(F.concat(F.lit("dem"), "o_custkey").alias("dem_id")).agg(west.alias("west"), south.alias("south")).select("dem_id", "west", "south", (F.col("west") + 0.0213).alias("east"), (F.col("south") + 0.0213).alias("north"))


@register("j14_best_dem", f"WITH {TILES}, {DEMS} SELECT tile_id, dem_id, {rd('overlap', 9)} AS overlap FROM rk WHERE k = 1")
def _j14(spark, sf):
    return joins.best_dem(tiles(spark, sf), dems(spark, sf)).withColumn("overlap", rnd("overlap", 9))


@register("j14_all_dems", f"WITH {TILES}, {DEMS} SELECT tile_id, dem_id, {rd('overlap', 9)} AS overlap, CAST(k AS INT) AS rank FROM rk")
def _j14a(spark, sf):
    return joins.all_dems(tiles(spark, sf), dems(spark, sf)).withColumn("overlap", rnd_many("overlap", 9))


def tile_sql(z: str, lon: str, lat: str) -> tuple[str, str]:
    return f"(({lon} + 180) / 360 * pow(2, {z}))", f"((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2, {z}))"


VX0, VY0 = tile_sql("12", "-79.9", "40.6")
VX1, VY1 = tile_sql("12", "-79.2", "39.9")


@register("j15_coverage_grid", f"""WITH {TILES}, g AS (SELECT x, y FROM range(CAST(floor({VX0}) AS BIGINT), CAST(floor({VX1}) AS BIGINT) + 1) a(x), range(CAST(floor({VY0}) AS BIGINT), CAST(floor({VY1}) AS BIGINT) + 1) b(y)),
    b AS (SELECT x, y, x / 4096.0 * 360 - 180 AS w, (x + 1) / 4096.0 * 360 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2 * y / 4096.0)))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 4096.0)))) AS s FROM g)
    SELECT x, y, CASE WHEN EXISTS (SELECT 1 FROM tile_index t WHERE b.e > t.west AND b.w < t.east AND b.n > t.south AND b.s < t.north) THEN 'lidar' ELSE 'fallback' END AS source FROM b""")
def _j15(spark, sf):
    return joins.coverage_grid(tiles(spark, sf), (-79.9, 39.9, -79.2, 40.6), 12)


BOXES = """bx AS (SELECT concat('area', CAST(n_nationkey AS VARCHAR)) AS name, n_nationkey AS ord, -80 + (n_nationkey % 5) * 0.2 AS west, 40 + (n_nationkey // 5) * 0.2 AS south,
    -80 + (n_nationkey % 5) * 0.2 + 0.25 AS east, 40 + (n_nationkey // 5) * 0.2 + 0.25 AS north FROM nation)"""


@register("j17_route", f"""WITH {DET}, {BOXES} SELECT id, name AS area FROM (SELECT d.id, b.name, row_number() OVER (PARTITION BY d.id ORDER BY b.ord) AS k FROM detections d
    LEFT JOIN bx b ON d.lon >= b.west AND d.lon <= b.east AND d.lat >= b.south AND d.lat <= b.north) q WHERE k = 1""")
def _j17(spark, sf):
    n = load(spark, sf, "nation")
    west, south = -80 + (F.col("n_nationkey") % 5) * F.lit(0.2), 40 + F.expr("n_nationkey DIV 5") * F.lit(0.2)
    boxes = n.select(F.concat(F.lit("area"), "n_nationkey").alias("name"), F.col("n_nationkey").alias("ord"), west.alias("west"), south.alias("south"), (west + 0.25).alias("east"), (south + 0.25).alias("north"))
    return joins.route(det(spark, sf), boxes, "id", 0.25).select("id", "area")


@register("j18_ground_truth_in", f"WITH {SITES} SELECT site_id, name FROM sites WHERE lon > {BOX[0]} AND lon < {BOX[2]} AND lat > {BOX[1]} AND lat < {BOX[3]} ORDER BY site_id LIMIT 1000")
def _j18(spark, sf):
    return views.ground_truth_in(fixture(spark, sf, "sites"), BOX).select("site_id", "name")


@register("j16_sample_nearest", f"""WITH {DEM}, {CAND}, s AS (SELECT survey_id AS source_id, min("row") AS r FROM dem GROUP BY 1), p AS (SELECT cand_id, mx % 70 AS x, my % 260 AS y FROM cand)
    SELECT cand_id, z AS elevation_m, source_id AS source FROM (SELECT p.cand_id, d.z, d.survey_id AS source_id, row_number() OVER (PARTITION BY p.cand_id ORDER BY d.survey_id NULLS LAST) AS k
      FROM p LEFT JOIN dem d ON d."row" = 250 - p.y AND d.col = p.x) q WHERE k = 1""")
def _j16(spark, sf):
    d = fixture(spark, sf, "dem")
    surface = d.withColumnRenamed("survey_id", "source_id")
    grid = surface.select("source_id").distinct().select("source_id", F.lit(26917).alias("epsg"), F.lit(0.0).alias("x0"), F.lit(250.0).alias("y0"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"), F.lit(1.0).alias("resolution_m"), F.col("source_id").alias("path"))
    pts = fixture(spark, sf, "cand").select("cand_id", (F.col("mx") % 70).cast("double").alias("x"), (F.col("my") % 260).cast("double").alias("y"), F.lit(26917).alias("epsg"))
    return joins.sample_nearest(pts, surface, grid, "cand_id").select("cand_id", "elevation_m", "source")


# ---- detection queries ---------------------------------------------------------------------------------------------

INBOX = f"lon > {BOX[0]} AND lon < {BOX[2]} AND lat > {BOX[1]} AND lat < {BOX[3]}"


@register("p1_within_bbox", f"WITH {DET} SELECT id, lon, lat FROM detections WHERE {INBOX}")
def _p1(spark, sf):
    return views.within_bbox(det(spark, sf), *BOX).select("id", "lon", "lat")


@register("p2_query_detections", f"WITH {DET} SELECT id FROM detections WHERE {INBOX} AND confidence >= 0.2 AND feature_type IN ('sinkhole', 'depression') AND source_passes LIKE '%\"tpi\"%' AND validated")
def _p2(spark, sf):
    return views.query_detections(det(spark, sf), BOX, ["Sinkhole", "depression"], "tpi", 0.2, True).select("id")


@register("s18_json_containment", f"WITH {DET} SELECT id, source_passes LIKE '%\"tpi\"%' AS has_tpi, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM detections")
def _s18(spark, sf):
    return det(spark, sf).select("id", views.json_has("source_passes", "tpi").alias("has_tpi"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("t1_page", f"WITH {DET} SELECT id, confidence FROM detections ORDER BY confidence DESC, id LIMIT 500 OFFSET 1000")
def _t1(spark, sf):
    return views.page(det(spark, sf), [F.desc("confidence")], 500, 1000).select("id", "confidence")


@register("g20_page_with_total", f"WITH {DET} SELECT id, confidence, (SELECT count(*) FROM detections) AS total_count FROM detections ORDER BY confidence DESC, id LIMIT 100")
def _g20(spark, sf):
    return views.page_with_total(det(spark, sf), 100).select("id", "confidence", "total_count")


@register("t3_nearest_first", f"WITH {TILES} SELECT tile_id, {rd('sqrt(pow((west + east) / 2 + 79.5, 2) + pow((south + north) / 2 - 40.1, 2))')} AS dist FROM tile_index ORDER BY sqrt(pow((west + east) / 2 + 79.5, 2) + pow((south + north) / 2 - 40.1, 2)), tile_id LIMIT 40")
def _t3(spark, sf):
    return views.nearest_first(tiles(spark, sf), -79.5, 40.1, 40).select("tile_id", rnd("dist").alias("dist"))


@register("t4_newest", f"WITH {DET} SELECT id FROM detections ORDER BY created_at DESC, id DESC LIMIT 500")
def _t4(spark, sf):
    return views.newest(det(spark, sf), 500).select("id")


@register("t5_tour", f"WITH {DET} SELECT id, feature_type, confidence FROM detections WHERE confidence >= 0.5 ORDER BY CASE WHEN feature_type = 'depression' THEN 1 ELSE 0 END, confidence DESC, id LIMIT 50")
def _t5(spark, sf):
    return views.tour(det(spark, sf)).select("id", "feature_type", "confidence")


@register("t8_shortlist", f"WITH {DET} SELECT id, confidence FROM detections WHERE {INBOX} AND confidence >= 0.4 ORDER BY confidence DESC, id LIMIT 100")
def _t8(spark, sf):
    return views.shortlist(det(spark, sf), BOX).select("id", "confidence")


@register("t6_first_source", f"WITH {TILES}, t AS (SELECT *, tile_id % 700 AS req FROM tile_index) SELECT tile_id, req, priority FROM t WHERE priority = (SELECT min(u.priority) FROM t u WHERE u.req = t.req)")
def _t6(spark, sf):
    return feeds.first_source(tiles(spark, sf).withColumn("req", F.col("tile_id") % 700), ["req"]).select("tile_id", "req", "priority")


@register("u2_dedup_tiles", f"WITH {TILES} SELECT url, min(tile_id) AS source_id FROM tile_index GROUP BY 1")
def _u2(spark, sf):
    t = tiles(spark, sf).select(F.col("tile_id").alias("source_id"), F.lit("f").alias("filename"), "url", "west", "south", "east", "north")
    return feeds.dedup_tiles(t, "url").select("url", "source_id")


@register("u3_duplicate_keys", f"WITH {TILES} SELECT url, count(*) AS n FROM tile_index GROUP BY 1 HAVING count(*) > 1")
def _u3(spark, sf):
    return reports.duplicate_keys(tiles(spark, sf), "url")


@register("p8_drop_legacy", f"WITH {TILES} SELECT tile_id FROM tile_index WHERE format = 'copc' OR year >= 2010")
def _p8(spark, sf):
    return feeds.drop_legacy(tiles(spark, sf).withColumnRenamed("year", "acquisition_year")).select("tile_id")


@register("p15_rect_intersects", f"WITH {TILES} SELECT tile_id, east > -79.8 AND west < -79.3 AND north > 40.2 AND south < 40.7 AS meets FROM tile_index")
def _p15(spark, sf):
    t = tiles(spark, sf).withColumns({"v_west": F.lit(BOX[0]), "v_south": F.lit(BOX[1]), "v_east": F.lit(BOX[2]), "v_north": F.lit(BOX[3])})
    return t.select("tile_id", joins.rect_intersects("", "v_").alias("meets"))


@register("p12_valid_scan", f"""WITH {TILES}, s AS (SELECT tile_id, west, south, west + (tile_id % 90) / 1e3 - 0.01 AS east, south + (tile_id % 70) / 1e3 - 0.01 AS north FROM tile_index)
    SELECT tile_id, west < east AND south < north AND (east - west) * 111.32 * cos(radians((north + south) / 2)) <= 4 AND (north - south) * 111.32 <= 4 AS valid_scan FROM s""")
def _p12(spark, sf):
    t = tiles(spark, sf)
    s = t.select("tile_id", "west", "south", (F.col("west") + (F.col("tile_id") % 90) / F.lit(1e3) - 0.01).alias("east"), (F.col("south") + (F.col("tile_id") % 70) / F.lit(1e3) - 0.01).alias("north"))
    return contracts.valid_scan(s).select("tile_id", "valid_scan")


@register("p11_drop_nonfinite", f"WITH {CAND} SELECT cand_id FROM cand WHERE cand_id % 7 <> 0")
def _p11(spark, sf):
    c = fixture(spark, sf, "cand").select("cand_id", F.when(F.col("cand_id") % 14 == 0, F.lit(float("nan"))).when(F.col("cand_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("lon")).alias("x"), F.col("lat").alias("y"))
    return contracts.drop_nonfinite(c).select("cand_id")


P13_NAMES = ("min_members", "max_spacing_cv", "flat_slope_deg", "min_area_m2", "max_area_m2", "shine", "threshold_m")


@register("p13_check_params", f"""WITH st AS (SELECT l_orderkey AS run_id, [{", ".join(f"'{n}'" for n in P13_NAMES)}][l_linenumber] AS parameter, CASE WHEN l_returnflag = 'R' AND l_quantity < 3 THEN NULL
      ELSE CASE WHEN l_linenumber = 2 THEN l_discount * 20 ELSE CAST(l_quantity AS DOUBLE) * (CASE WHEN l_linenumber = 3 THEN 2.5 ELSE 5.0 END) END END AS value, l_linenumber <> 6 AS known FROM lineitem),
    up AS (SELECT run_id, max(value) AS upper FROM st WHERE parameter = 'max_area_m2' GROUP BY 1), j AS (SELECT st.*, upper, known AND value > 0 AND value <= 100000 AS usable FROM st LEFT JOIN up USING (run_id))
    SELECT run_id, parameter, 'unknown' AS rule FROM j WHERE NOT known UNION ALL SELECT run_id, parameter, 'not a number in (0, 100000]' FROM j WHERE known AND NOT coalesce(usable, false)
    UNION ALL SELECT run_id, parameter, 'members must be whole and 3..200' FROM j WHERE usable AND parameter = 'min_members' AND (value <> floor(value) OR value < 3 OR value > 200)
    UNION ALL SELECT run_id, parameter, 'above 1' FROM j WHERE usable AND parameter = 'max_spacing_cv' AND value > 1 UNION ALL SELECT run_id, parameter, 'above 90 degrees' FROM j WHERE usable AND parameter = 'flat_slope_deg' AND value > 90
    UNION ALL SELECT run_id, parameter, 'exceeds max_area_m2' FROM j WHERE usable AND parameter = 'min_area_m2' AND value > upper""")
def _p13(spark, sf):
    """Each order is a run, each of its lines one setting."""
    from fellscan.plans.discovery import parameter_problems

    line = F.col("l_linenumber").cast("int")
    value = F.when(line == 2, F.col("l_discount") * 20).otherwise(F.col("l_quantity").cast("double") * F.when(line == 3, 2.5).otherwise(5.0))
    settings = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.element_at(F.array(*[F.lit(n) for n in P13_NAMES]), line).alias("parameter"),
        F.when(~((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 3)), value).cast("double").alias("value"), (line != 6).alias("known"))
    return parameter_problems(settings)


# ---- reports -------------------------------------------------------------------------------------------------------

TIMINGS, FILES = ctes("timings"), ctes("files")


@register("g10_stage_profile", f"""WITH {TIMINGS}, p AS (SELECT parent, stage, CAST(sum(ms) AS BIGINT) AS total_ms, count(*) AS calls FROM timings GROUP BY 1, 2)
    SELECT parent, stage, total_ms, calls, {rd('100.0 * total_ms / (SELECT sum(total_ms) FROM p)')} AS pct, CAST(row_number() OVER (PARTITION BY parent ORDER BY total_ms DESC, stage) AS INT) AS rank FROM p""")
def _g10(spark, sf):
    out = reports.stage_profile(fixture(spark, sf, "timings"), "ms")
    return out.select("parent", "stage", F.col("total_s").alias("total_ms"), "calls", rnd("pct").alias("pct"), "rank")


@register("g11_latency_summary", f"WITH {TIMINGS} SELECT stage, count(*) AS n, max(ms) AS max_ms, {rd('quantile_cont(ms, 0.5)')} AS p50, {rd('quantile_cont(ms, 0.95)')} AS p95 FROM timings GROUP BY 1")
def _g11(spark, sf):
    out = reports.latency_summary(fixture(spark, sf, "timings"), "stage")
    return out.select("stage", "n", "max_ms", rnd("p50").alias("p50"), rnd("p95").alias("p95"))


# Where a data folder keeps its files; the category follows from the place alone.
PLACES = ["raw/{k}.laz", "processed/t{k}/t{k}_dem.tif", "processed/t{k}/dem.tif", "processed/t{k}/hillshade.tif", "processed/t{k}/derivatives/svf.tif", "exports/raw/{k}.tif"]


@register("g12_storage_breakdown", f"""WITH {FILES}, k AS (SELECT size_bytes, file_id % 6 AS p FROM files),
    n AS (SELECT unnest(['raw', 'dem', 'hillshade', 'derivatives', 'other']) AS category), c AS (SELECT size_bytes, CASE p WHEN 0 THEN 'raw' WHEN 1 THEN 'dem' WHEN 2 THEN 'dem' WHEN 3 THEN 'hillshade' WHEN 4 THEN 'derivatives' ELSE 'other' END AS category FROM k)
    SELECT n.category, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, count(c.category) AS files, {rd('100.0 * coalesce(sum(size_bytes), 0) / 1e9')} AS pct_of_cap FROM n LEFT JOIN c USING (category) GROUP BY 1""")
def _g12(spark, sf):
    k = F.col("file_id")
    path = F.element_at(F.array(*[F.concat(F.lit("/data/"), F.replace(F.lit(p), F.lit("{k}"), k.cast("string"))) for p in PLACES]), (k % 6).cast("int") + 1)
    out = reports.storage_breakdown(fixture(spark, sf, "files").withColumn("path", path), 1e9, "/data")
    return out.withColumn("pct_of_cap", rnd("pct_of_cap"))


RESULTS = """res AS (SELECT concat('job', CAST(user_id AS VARCHAR)) AS job_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id % 4 AS VARCHAR) END AS error_type FROM events)"""


def results(spark, sf):
    e = load(spark, sf, "events")
    return e.select(F.concat(F.lit("job"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id") % 4)).alias("error_type"))


@register("g13_job_outcome", f"WITH {RESULTS} SELECT job_id, count(*) FILTER (error_type IS NULL) AS ok, count(error_type) AS failed, CASE WHEN count(*) FILTER (error_type IS NULL) = 0 THEN 'failed' ELSE 'completed' END AS status FROM res GROUP BY 1")
def _g13(spark, sf):
    return reports.job_outcome(results(spark, sf))


@register("g13_job_errors", f"WITH {RESULTS} SELECT job_id, error_type, count(*) AS n FROM res WHERE error_type IS NOT NULL GROUP BY 1, 2")
def _g13e(spark, sf):
    return reports.job_errors(results(spark, sf))


@register("g13_first_errors", f"WITH {RESULTS} SELECT job_id, seq, error_type FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM res WHERE error_type IS NOT NULL) q WHERE k <= 5")
def _g13f(spark, sf):
    return reports.first_errors(results(spark, sf)).select("job_id", "seq", "error_type")


@register("g14_top_types", f"WITH {DET} SELECT feature_type, count(*) AS n FROM detections GROUP BY 1 ORDER BY n DESC, feature_type LIMIT 3")
def _g14(spark, sf):
    return reports.top_types(det(spark, sf))


@register("g16_heat_grid", f"WITH {DET} SELECT CAST(floor(lon / 0.05) AS BIGINT) AS gx, CAST(floor(lat / 0.05) AS BIGINT) AS gy, {rd('sum(confidence)')} AS weight, count(*) AS n FROM detections GROUP BY 1, 2")
def _g16(spark, sf):
    return reports.heat_grid(det(spark, sf), 0.05).withColumn("weight", rnd("weight"))


@register("g17_overview", f"""WITH {DEM} SELECT survey_id, "row" // 4 AS "row", col // 4 AS col, {rd('avg(z)')} AS z FROM dem GROUP BY 1, 2, 3""")
def _g17(spark, sf):
    return cells.overview(fixture(spark, sf, "dem"), 4).withColumn("z", rnd("z"))


@register("g21_load_report", f"WITH {SITES} SELECT source, count(*) AS rows, false AS failed FROM sites GROUP BY 1 UNION ALL SELECT 'absent', 0, true")
def _g21(spark, sf):
    return feeds.load_report(fixture(spark, sf, "sites"), [f"src{i}" for i in range(10)] + ["absent"])


RETAIN = """fl AS (SELECT *, age_days > 30 AS old FROM files), tot AS (SELECT coalesce(sum(size_bytes), 0) AS t FROM fl WHERE NOT old),
    lv AS (SELECT file_id, size_bytes, sum(size_bytes) OVER (ORDER BY age_days DESC, {order} ROWS UNBOUNDED PRECEDING) - size_bytes AS before FROM fl WHERE NOT old)"""


@register("t7_retention_plan", f"""WITH {FILES}, {RETAIN.format(order='file_id')}, cap AS (SELECT CAST(sum(size_bytes) // 10 AS BIGINT) AS c FROM files)
    SELECT age_days, count(*) FILTER (old) AS age_evicted, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM fl GROUP BY 1""")
def _t7(spark, sf):
    plan = reports.retention_plan(fixture(spark, sf, "files"), 30, 1e5)
    return plan.groupBy("age_days").agg(F.count_if(F.col("evict") == "age").alias("age_evicted"), F.sum("size_bytes").alias("bytes"))


@register("t7_retention_summary", f"""WITH {FILES} SELECT count(*) AS files_scanned, CAST(sum(size_bytes) AS BIGINT) AS bytes_before, CAST(sum(CASE WHEN age_days > 20 THEN size_bytes ELSE 0 END) AS BIGINT) AS freed_bytes,
    count(*) FILTER (age_days > 20) AS deleted_files, count(*) FILTER (age_days > 20) AS age_evicted, CAST(0 AS BIGINT) AS cap_evicted FROM files""")
def _t7s(spark, sf):
    return reports.retention_summary(reports.retention_plan(fixture(spark, sf, "files"), 20, 1e15))


@register("t7_retention_order", f"""WITH {FILES}, fa AS (SELECT file_id, size_bytes, age_days + file_id / 1e7 AS age FROM files), lv AS (SELECT * FROM fa WHERE age <= 20),
    b AS (SELECT file_id, sum(size_bytes) OVER (ORDER BY age DESC ROWS UNBOUNDED PRECEDING) - size_bytes AS before FROM lv), t AS (SELECT sum(size_bytes) AS t FROM lv)
    SELECT file_id, CASE WHEN fa.age > 20 THEN 'age' WHEN b.before < t.t - 1e8 THEN 'cap' END AS evict FROM fa LEFT JOIN b USING (file_id) CROSS JOIN t""")
def _t7o(spark, sf):
    files = fixture(spark, sf, "files").withColumn("age_days", F.col("age_days") + F.col("file_id") / F.lit(1e7))
    return reports.retention_plan(files, 20, 1e8).select("file_id", "evict")


# ---- job and review state ------------------------------------------------------------------------------------------

JOBS = ctes("job_events")
FOLD = """en AS (SELECT job_id, min(CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN seq END) AS e FROM job_events GROUP BY 1),
    lv AS (SELECT j.* FROM job_events j JOIN en USING (job_id) WHERE e IS NULL OR seq <= e),
    fj AS (SELECT job_id, arg_max(status, seq) AS status, max(least(progress, 100)) AS progress, min(CASE WHEN status = 'running' THEN ts END) AS started_at,
      max(CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN ts END) AS completed_at, arg_max(stage, seq) AS stage, max(ts) AS updated_at FROM lv GROUP BY 1)"""


@register("i1_fold_jobs", f"WITH {JOBS}, {FOLD} SELECT * FROM fj")
def _i1(spark, sf):
    return folds.fold_jobs(fixture(spark, sf, "job_events")).drop("result_summary", "error_message")


@register("i1_job_summaries", f"""WITH {JOBS}, {FOLD}, ev AS (SELECT *, CASE WHEN seq % 13 = 0 THEN seq % 100 END AS found FROM lv),
    s AS (SELECT job_id, arg_max(found, seq) FILTER (found IS NOT NULL) AS found, max(seq) FILTER (found IS NOT NULL) AS g, arg_max(stage, seq) FILTER (found IS NULL AND stage <> '') AS stage,
      max(seq) FILTER (found IS NULL AND stage <> '') AS a, arg_max(concat('stopped at ', CAST(seq AS VARCHAR)), seq) FILTER (status = 'failed') AS error_message FROM ev GROUP BY 1)
    SELECT job_id, CAST(found AS VARCHAR) AS found, CASE WHEN g IS NULL OR a > g THEN stage END AS stage, error_message FROM s""")
def _i1s(spark, sf):
    seq = F.col("seq")
    found = F.when(seq % 13 == 0, F.create_map(F.lit("found"), (seq % 100).cast("string")))
    jobs = folds.fold_jobs(fixture(spark, sf, "job_events").withColumns({"summary": found, "message": F.concat(F.lit("stopped at "), seq.cast("string"))}))
    return jobs.select("job_id", F.col("result_summary")["found"].alias("found"), F.col("result_summary")["stage"].alias("stage"), "error_message")


@register("i2_live_feed", f"""WITH {JOBS}, {FOLD} SELECT job_id, status FROM fj WHERE status IN ('pending', 'running') OR completed_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAYS
    ORDER BY updated_at DESC, job_id LIMIT 50""")
def _i2(spark, sf):
    return folds.live_feed(folds.fold_jobs(fixture(spark, sf, "job_events")), "2024-01-20 00:00:00", "10 days").select("job_id", "status")


@register("i3_latest_verdict", f"WITH {EVENTS} SELECT detection_id, lower(arg_max(verdict, seq)) AS verdict, lower(arg_max(verdict, seq)) = 'confirmed' AS validated, arg_max(notes, seq) AS notes FROM verdicts GROUP BY 1")
def _i3(spark, sf):
    return folds.latest_verdict(fixture(spark, sf, "verdicts"))


@register("i4_fence", f"""WITH {JOBS}, {FOLD} SELECT j.seq FROM job_events j JOIN fj USING (job_id) WHERE fj.completed_at IS NULL OR j.ts <= fj.completed_at""")
def _i4(spark, sf):
    ev = fixture(spark, sf, "job_events")
    return folds.fence(ev, folds.fold_jobs(ev)).select("seq")


LOG = """lg AS (SELECT event_id // 2 AS request_id, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS phase, ts, CASE WHEN event_id % 2 = 1 THEN 200 + event_id % 3 * 100 END AS status FROM events)"""


@register("i5_request_rollup", f"""WITH {LOG}, p AS (SELECT request_id, min(CASE WHEN phase = 'in' THEN ts END) AS a, max(CASE WHEN phase = 'out' THEN ts END) AS b, max(status) AS status FROM lg GROUP BY 1)
    SELECT request_id, CAST(status AS INT) AS status, {rd('(epoch_us(b) - epoch_us(a)) / 1000.0', 3)} AS ms, coalesce((epoch_us(b) - epoch_us(a)) / 1000.0 >= 600000, false) AS slow FROM p""")
def _i5(spark, sf):
    e = load(spark, sf, "events")
    log = e.select(F.expr("event_id DIV 2").alias("request_id"), F.when(F.col("event_id") % 2 == 0, "in").otherwise("out").alias("phase"), "ts",
                   F.when(F.col("event_id") % 2 == 1, 200 + F.col("event_id") % 3 * 100).cast("int").alias("status"))
    return folds.request_rollup(log, 600_000).select("request_id", "status", rnd("ms", 3).alias("ms"), "slow")


# ---- scalar functions ----------------------------------------------------------------------------------------------

@register("s1_utm", f"WITH {DET} SELECT id, CAST(floor((lon * 2 + 180) / 6) + 1 AS INT) AS zone, CAST(CASE WHEN lat - 40.5 >= 0 THEN 32600 ELSE 32700 END + floor((lon * 2 + 180) / 6) + 1 AS INT) AS epsg FROM detections")
def _s1(spark, sf):
    d = det(spark, sf).select("id", (F.col("lon") * 2).alias("lon"), (F.col("lat") - 40.5).alias("lat"))
    return d.select("id", sc.utm_zone("lon").alias("zone"), sc.utm_epsg("lon", "lat").cast("int").alias("epsg"))


@register("s2_epsg_from_text", r"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unnamed' ELSE concat('NAD83 / UTM zone ', CAST(10 + o_orderkey % 9 AS VARCHAR), CASE WHEN o_custkey % 2 = 0 THEN 'N' ELSE 'S' END) END AS txt FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CASE WHEN txt LIKE '%N' THEN 26900 ELSE 32700 END + 10 + o_orderkey % 9 AS INT) END AS epsg FROM t""")
def _s2(spark, sf):
    o = load(spark, sf, "orders")
    txt = F.when(F.col("o_orderkey") % 4 == 0, "unnamed").otherwise(F.concat(F.lit("NAD83 / UTM zone "), 10 + F.col("o_orderkey") % 9, F.when(F.col("o_custkey") % 2 == 0, "N").otherwise("S")))
    return o.select("o_orderkey", sc.epsg_from_text(txt).alias("epsg"))


@register("s3_degrees_metres", f"WITH {DET} SELECT id, {rd('0.01 * 111320 * cos(radians(lat))', 5)} AS mx, {rd('0.01 * 111320', 5)} AS my, {rd('100 / (111320 * cos(radians(lat)))', 9)} AS dx FROM detections")
def _s3(spark, sf):
    mx, my = sc.degrees_to_metres("lat", F.lit(0.01), F.lit(0.01))
    dx, _ = sc.metres_to_degrees("lat", F.lit(100.0), F.lit(100.0))
    return det(spark, sf).select("id", rnd(mx, 5).alias("mx"), rnd(my, 5).alias("my"), rnd(dx, 9).alias("dx"))


TX, TY = tile_sql("14", "lon", "lat")


@register("s4_tiles", f"""WITH {DET}, t AS (SELECT id, floor({TX}) AS x, floor({TY}) AS y FROM detections) SELECT id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, {rd('x / 16384 * 360 - 180')} AS west,
    {rd('degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 16384))))')} AS south FROM t""")
def _s4(spark, sf):
    fx, fy = sc.tile_position("lon", "lat", F.lit(14))
    t = det(spark, sf).select("id", F.floor(fx).alias("x"), F.floor(fy).alias("y"))
    b = sc.tile_bounds(F.lit(14), "x", "y")
    return t.select("id", "x", "y", rnd(b["west"]).alias("west"), rnd(b["south"]).alias("south"))


@register("s5_mercator_bounds", f"""WITH {DET}, t AS (SELECT id, floor({TX}) AS x, floor({TY}) AS y FROM detections) SELECT id, {rd('-20037508.342789244 + x * 2 * 20037508.342789244 / 16384', 4)} AS west,
    {rd('20037508.342789244 - y * 2 * 20037508.342789244 / 16384', 4)} AS north FROM t""")
def _s5(spark, sf):
    fx, fy = sc.tile_position("lon", "lat", F.lit(14))
    b = sc.mercator_bounds(F.lit(14), "x", "y")
    return det(spark, sf).select("id", F.floor(fx).alias("x"), F.floor(fy).alias("y")).select("id", rnd(b["west"], 4).alias("west"), rnd(b["north"], 4).alias("north"))


@register("s6_utm_round_trip")
def _s6(spark, sf):
    zone = sc.utm_zone("lon")
    d = det(spark, sf)
    e, n = geodesy.utm_forward(F.col("lon"), F.col("lat"), zone)
    lon, lat = geodesy.utm_inverse(F.col("east"), F.col("north"), F.col("zone"))
    return d.select("id", "lon", "lat", e.alias("east"), n.alias("north"), zone.alias("zone")).select("id", rnd("east", 4).alias("east"), rnd("north", 4).alias("north"),
                                                                                                  rnd(F.abs(lon - F.col("lon")) + F.abs(lat - F.col("lat")), 9).alias("error_deg"))


@register("s7_grid_key", f"""WITH {DET}, k AS (SELECT id, printf('%.3f_%.3f_%.3f_%.3f', floor(lon / 0.05) * 0.05, floor(lat / 0.05) * 0.05, ceil((lon + 0.01) / 0.05) * 0.05, ceil((lat + 0.01) / 0.05) * 0.05) AS cell FROM detections)
    SELECT id, cell, concat('roads_', substr(md5(concat('roads_', cell)), 1, 16), '.parquet') AS cache_key FROM k""")
def _s7(spark, sf):
    k = det(spark, sf).select("id", sc.grid_cell_key("lon", "lat", F.col("lon") + 0.01, F.col("lat") + 0.01).alias("cell"))
    return k.select("id", "cell", sc.context_cache_key(F.lit("roads"), "cell").alias("cache_key"))


@register("s8_classify", f"""WITH {CAND} SELECT cand_id, CASE WHEN area_m2 * 40 > 10000 AND depth_m < 5 AND circularity < 0.3 THEN 'salt_dome_collapse' WHEN circularity < 0.2 AND depth_m > 0.5 AND area_m2 * 40 > 500 THEN 'lava_tube'
    WHEN depth_m > 3 AND area_m2 * 40 < 500 AND circularity > 0.4 THEN 'cave_entrance' WHEN circularity < 0.3 AND depth_m > 1 AND area_m2 * 40 < 1000 THEN 'mine_portal'
    WHEN area_m2 * 40 > 200 AND depth_m > 0.5 AND circularity > 0.5 THEN 'sinkhole' WHEN depth_m > 0.5 THEN 'depression' ELSE 'unknown' END AS kind FROM cand""")
def _s8(spark, sf):
    c = fixture(spark, sf, "cand").withColumn("a", F.col("area_m2") * 40)
    return c.select("cand_id", sc.classify("depth_m", "a", "circularity").alias("kind"))


@register("s9_scores", f"WITH {DEM} SELECT {KEY}, {rd('least(abs(z / 100.0) / 5.0, 1.0)')} AS score FROM dem")
def _s9(spark, sf):
    return fixture(spark, sf, "dem").select("survey_id", "row", "col", rnd(sc.saturating(F.col("z") / 100.0, 5.0)).alias("score"))


@register("s10_discovery_score", f"WITH {DEM} SELECT {KEY}, {rd('0.4 + 0.4 * (1 - exp(-abs(z / 100.0) / 1.5))')} AS score FROM dem")
def _s10(spark, sf):
    return fixture(spark, sf, "dem").select("survey_id", "row", "col", rnd(sc.discovery_score(sc.contrast_strength(F.col("z") / 100.0, 0.5))).alias("score"))


@register("s11_href", """SELECT page_id, CASE WHEN regexp_extract(html, 'href="([^"]+)"', 1) <> '' THEN regexp_extract(html, 'href="([^"]+)"', 1) END AS link FROM pages""")
def _s11(spark, sf):
    return load(spark, sf, "pages").select("page_id", sc.href("html").alias("link"))


@register("s12_text_keys", r"""SELECT p_partkey, concat(replace(replace(concat(p_name, ' County'), ' County', ''), ' ', ''), 'CoNC') AS folder, trim(regexp_replace(lower(concat(p_brand, ' / ', p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def _s12(spark, sf):
    return load(spark, sf, "part").select("p_partkey", sc.county_folder(F.concat("p_name", F.lit(" County"))).alias("folder"), sc.slug(F.concat_ws(" / ", "p_brand", "p_name")).alias("slug"))


YEAR = r"""t AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(CAST(1980 + page_id % 60 AS VARCHAR), '-05-01') END AS pub, concat('https://h/p_', CAST(1985 + page_id % 50 AS VARCHAR), '_x.laz') AS url, url AS title FROM pages),
    y AS (SELECT page_id, CASE WHEN regexp_extract(coalesce(pub, ''), '(\d{4})', 1) <> '' THEN regexp_extract(coalesce(pub, ''), '(\d{4})', 1) ELSE nullif(regexp_extract(concat(url, '/', title), '[_/](\d{4})[_/]', 1), '') END AS y FROM t)"""


@register("s13_acquisition_year", f"WITH {YEAR} SELECT page_id, CASE WHEN CAST(y AS INT) BETWEEN 1990 AND 2030 THEN CAST(y AS INT) END AS year FROM y")
def _s13(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(1980 + F.col("page_id") % 60, F.lit("-05-01"))).alias("pub"),
                                        F.concat(F.lit("https://h/p_"), 1985 + F.col("page_id") % 50, F.lit("_x.laz")).alias("link"), F.col("url").alias("title"))
    return p.select("page_id", sc.acquisition_year("pub", "link", "title").alias("year"))


@register("s14_geodesic")
def _s14(spark, sf):
    g = geodesy.geodesic(F.col("lon"), F.col("lat"), F.col("lon") + 0.05, F.col("lat") - 0.03)
    return det(spark, sf).select("id", g.alias("g")).select("id", rnd("g.distance_m", 4).alias("distance_m"), rnd("g.azimuth").alias("azimuth"))


@register("s14_haversine", f"WITH {DET}, p AS (SELECT id, lon, lat FROM detections) SELECT a.id, {rd(HAV.replace('b.lat', '(a.lat - 0.03)').replace('b.lon', '(a.lon + 0.05)'), 4)} AS distance_m FROM p a")
def _s14h(spark, sf):
    return det(spark, sf).select("id", rnd(sc.haversine_m("lon", "lat", F.col("lon") + 0.05, F.col("lat") - 0.03), 4).alias("distance_m"))


@register("s15_radius_bbox", f"WITH {DET} SELECT id, {rd('lon - 500 / (111320 * cos(radians(lat)))')} AS west, {rd('lat - 500 / 111320.0')} AS south, {rd('lon + 500 / (111320 * cos(radians(lat)))')} AS east, {rd('lat + 500 / 111320.0')} AS north FROM detections")
def _s15(spark, sf):
    return det(spark, sf).select("id", *[rnd(v).alias(k) for k, v in sc.radius_bbox("lon", "lat", F.lit(500.0)).items()])


@register("s16_terrarium", f"""WITH {DEM}, v AS (SELECT {KEY}, z / 8.0 + 32768 AS v, CAST(floor((z / 8.0 + 10000) * 10) AS BIGINT) AS q FROM dem) SELECT {KEY}, CAST(floor(v / 256) AS INT) AS r, CAST(floor(v % 256) AS INT) AS g, CAST(floor((v * 256) % 256) AS INT) AS b,
    CAST(q // 65536 AS INT) AS tr, CAST(q % 65536 // 256 AS INT) AS tg, CAST(q % 256 AS INT) AS tb, v - 32768 AS back FROM v""")
def _s16(spark, sf):
    d = fixture(spark, sf, "dem").select("survey_id", "row", "col", (F.col("z") / 8.0).alias("z"))
    t, q = sc.terrarium("z"), sc.terrain_rgb("z")
    return d.select("survey_id", "row", "col", *[v.alias(k) for k, v in t.items()], *[v.alias("t" + k) for k, v in q.items()], sc.terrarium_decode(t["r"], t["g"], t["b"]).alias("back"))


@register("s17_colours", f"""WITH {DEM}, v AS (SELECT {KEY}, z / 100.0 AS v FROM dem), t AS (SELECT *, least(greatest(v / 2, -1.0), 1.0) AS t FROM v) SELECT {KEY},
    CAST(floor(244 + abs(t) * ((CASE WHEN t < 0 THEN 44 ELSE 194 END) - 244)) AS INT) AS r, CAST(floor(240 + abs(t) * ((CASE WHEN t < 0 THEN 112 ELSE 87 END) - 240)) AS INT) AS g,
    CAST(floor(226 + abs(t) * ((CASE WHEN t < 0 THEN 168 ELSE 35 END) - 226)) AS INT) AS b, 255 AS a FROM t""")
def _s17(spark, sf):
    return fixture(spark, sf, "dem").select("survey_id", "row", "col", *[v.alias(k) for k, v in sc.colourise(F.col("z") / 100.0, "local-relief").items()])


@register("s17_hypsometric", f"""WITH {DEM}, v AS (SELECT {KEY}, least(greatest(CAST(z * 10 AS DOUBLE), 0.0), 3500.0) AS v FROM dem) SELECT {KEY}, CAST(floor(CASE """ + " ".join(
    f"WHEN v <= {hi[0]} THEN {lo[1]} + (v - {lo[0]}) / ({hi[0]} - {lo[0]}) * ({hi[1]} - {lo[1]})" for lo, hi in zip(sc.HYPSOMETRIC, sc.HYPSOMETRIC[1:])) + " END) AS INT) AS r FROM v")
def _s17h(spark, sf):
    return fixture(spark, sf, "dem").select("survey_id", "row", "col", sc.hypsometric(F.col("z") * 10)["r"].alias("r"))


# ---- sources and sinks ---------------------------------------------------------------------------------------------

@register("a1_dem_cells", f"WITH {DEM} SELECT {KEY}, CAST(z * 0.5 + 10 AS DOUBLE) AS z FROM dem WHERE z <> 0")
def _a1(spark, sf):
    return cells.dem_cells(fixture(spark, sf, "dem"), 0, 0.5, 10.0)


@register("a2_raster_profile", f"""WITH {ctes('dem', 'holes')} SELECT survey_id, max("row") - min("row") + 1 AS height, max(col) - min(col) + 1 AS width, count(z) AS cells,
    (max("row") - min("row") + 1) * (max(col) - min(col) + 1) - count(z) AS nodata_cells, min(z) AS min_z, max(z) AS max_z, 'bigint' AS dtype FROM holes GROUP BY 1""")
def _a2(spark, sf):
    return cells.raster_profile(fixture(spark, sf, "holes"))


@register("a3_point_cloud", f"WITH {ctes('points')} SELECT classification, number_of_returns, count(*) AS n, {rd('sum(z)', 3)} AS sum_z FROM points GROUP BY 1, 2")
def _a3(spark, sf):
    return cells.point_cloud(fixture(spark, sf, "points")).groupBy("classification", "number_of_returns").agg(F.count("*").alias("n"), rnd(F.sum("z"), 3).alias("sum_z"))


def digest_sql(row: str, src: str, by: str = "") -> str:
    words = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) % 4294967296 AS BIGINT) AS w{i}" for i in range(8))
    group = f"{by}, " if by else ""
    tail = " GROUP BY 1" if by else ""
    return f"(SELECT {group}sha256(concat_ws('|', n, {', '.join(f'w{i}' for i in range(8))})) AS digest FROM (SELECT {group}count(*) AS n, {words} FROM (SELECT {group}sha256({row}) AS h FROM {src}){tail}))"


@register("a4_dem_inventory", f"""WITH {DEM} SELECT survey_id, 26917 AS epsg, count(*) AS cells, CAST(500000 + min(col) AS DOUBLE) AS west, CAST(4480000 - max("row") - 1 AS DOUBLE) AS south, CAST(500000 + max(col) + 1 AS DOUBLE) AS east,
    CAST(4480000 - min("row") AS DOUBLE) AS north, CAST(1 AS DOUBLE) AS resolution_m, any_value(digest) AS revision FROM dem JOIN {digest_sql('''concat_ws('|', CAST("row" AS VARCHAR), CAST(col AS VARCHAR), CAST(z AS VARCHAR))''', 'dem', 'survey_id')} g USING (survey_id) GROUP BY 1""")
def _a4(spark, sf):
    d = fixture(spark, sf, "dem")
    survey = d.select("survey_id").distinct().select("survey_id", F.lit(26917).alias("epsg"), F.lit(500000.0).alias("x0"), F.lit(4480000.0).alias("y0"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"))
    return cells.dem_inventory(d, survey)


@register("g1_fingerprint", f"""SELECT digest FROM {digest_sql("concat_ws('|', CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR))", 'events')} g""")
def _g1(spark, sf):
    return cells.fingerprint(load(spark, sf, "events"), "event_id", "event_type", "user_id")


def tile_feed_rows(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    props = F.create_map(
        F.lit("Name"), F.concat(F.lit("T"), k % 4000), F.lit("TILE"), F.lit("x"), F.lit("URL"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("https://h/"), k % 4000, F.when(k % 2 == 0, ".copc.laz").otherwise(".laz"))),
        F.lit("downloadURL"), F.concat(F.lit("https://h/d_"), F.year("o_orderdate"), F.lit("_/"), k % 3000, F.lit(".laz")), F.lit("publicationDate"), F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(""),
        F.lit("PointCloudDownload"), F.concat(F.lit('<a href="https://va/'), k, F.lit('">get</a>')), F.lit("phase2_aws_url"), F.when(k % 3 == 0, F.concat(F.lit("https://ky/"), k, F.lit(".copc.laz"))),
        F.lit("phase1_aws_url"), F.concat(F.lit("https://ky1/"), k, F.lit(".laz")))
    west = F.when(k % 11 != 0, -80 + k * 17 % 2000 / F.lit(1e3))
    return o.select(props.alias("props"), west.alias("west"), F.lit(39.0).alias("south"), (west + 0.01).alias("east"), F.lit(39.01).alias("north"), (F.lit("s") + k % 2).cast("string").alias("service"), k.alias("k"))


@register("a5_tile_index_feeds", """WITH o AS (SELECT o_orderkey AS k, o_orderdate, year(o_orderdate) AS y FROM orders), f AS (
    SELECT 'wv' AS feed, concat('wv_T', CAST(k % 4000 AS VARCHAR), '.laz') AS filename, 26917 AS crs, 'laz' AS format, NULL AS acquisition_year FROM o WHERE k % 9 <> 0 AND k % 11 <> 0
    UNION ALL SELECT 'md', concat('md_T', CAST(k % 4000 AS VARCHAR), '.laz'), 26985, 'laz', NULL FROM o WHERE k % 9 <> 0 AND k % 11 <> 0
    UNION ALL SELECT 'va', concat('va_T', CAST(k % 4000 AS VARCHAR), '.laz'), 26917, 'laz', NULL FROM o WHERE k % 11 <> 0
    UNION ALL SELECT 'ky', concat('ky_T', CAST(k % 4000 AS VARCHAR), '.laz'), 3089, CASE WHEN k % 3 = 0 THEN 'copc.laz' ELSE 'laz' END, NULL FROM o WHERE k % 11 <> 0
    UNION ALL SELECT 'pasda', concat('T', CAST(k % 4000 AS VARCHAR), '.laz'), 2272, 'laz', NULL FROM o)
    SELECT feed, crs, format, count(*) AS n, count(DISTINCT filename) AS files, count(acquisition_year) AS dated FROM f GROUP BY 1, 2, 3""")
def _a5(spark, sf):
    rows = tile_feed_rows(spark, sf)
    out = None
    for feed in ("wv", "md", "va", "ky", "pasda"):
        part = feeds.normalise_tile_index(rows, feed)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("feed", "crs", "format").agg(F.count("*").alias("n"), F.countDistinct("filename").alias("files"), F.count("acquisition_year").alias("dated"))


@register("a5_tnm_feed", """WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderdate, concat('https://h/d_', CAST(year(o_orderdate) AS VARCHAR), '_/', CAST(o_orderkey % 3000 AS VARCHAR), '.laz') AS url FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT url, concat('tnm_', CAST(any_value(k % 3000) AS VARCHAR), '.laz') AS filename, CAST(any_value(y) AS INT) AS acquisition_year FROM o GROUP BY 1""")
def _a5t(spark, sf):
    return feeds.normalise_tile_index(tile_feed_rows(spark, sf), "tnm").select("url", "filename", "acquisition_year")


@register("a6_ground_truth_feeds", """WITH c AS (SELECT c_custkey AS k, c_name AS nm, CASE c_custkey % 5 WHEN 0 THEN 'Coal, surface' WHEN 1 THEN 'limestone' WHEN 2 THEN 'Gold' WHEN 3 THEN 'brine' ELSE '' END AS com, CASE WHEN c_custkey % 7 = 0 THEN 'Cave site' ELSE 'Prospect' END AS st FROM customer),
    f AS (SELECT 'md_karst_survey' AS source, CASE WHEN k % 5 = 0 THEN 'mine_portal' WHEN k % 7 = 0 THEN 'cave_entrance' WHEN k % 5 = 1 THEN 'sinkhole' ELSE 'mine_portal' END AS ft, CASE WHEN k % 3 = 0 THEN concat('MD-', CAST(k AS VARCHAR)) ELSE nm END AS name, com FROM c
    UNION ALL SELECT 'la_subsidence', CASE WHEN k % 5 = 3 THEN 'salt_dome_collapse' ELSE 'mine_portal' END, CASE WHEN k % 3 = 0 THEN concat('LA-', CAST(k AS VARCHAR)) ELSE nm END, com FROM c
    UNION ALL SELECT 'nc_cave_survey', CASE WHEN k % 5 = 2 THEN 'mine_portal' WHEN k % 7 = 0 THEN 'cave_entrance' ELSE 'mine_portal' END, CASE WHEN k % 3 = 0 THEN concat('NC-', CAST(k AS VARCHAR)) ELSE nm END, com FROM c
    UNION ALL SELECT 'ma_usgs_mines', CASE WHEN k % 5 = 1 THEN 'cave_entrance' ELSE 'mine_portal' END, CASE WHEN k % 3 = 0 THEN concat('MA-', CAST(k AS VARCHAR)) ELSE nm END, com FROM c)
    SELECT source, name, ft AS feature_type, upper(com) AS commodity FROM f""")
def _a6(spark, sf):
    k = F.col("c_custkey")
    com = F.when(k % 5 == 0, "Coal, surface").when(k % 5 == 1, "limestone").when(k % 5 == 2, "Gold").when(k % 5 == 3, "brine").otherwise("")
    props = F.create_map(F.lit("site_name"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")), F.lit("commod1"), com, F.lit("site_type"), F.when(k % 7 == 0, "Cave site").otherwise("Prospect"))
    rows = load(spark, sf, "customer").select(k.alias("row_id"), props.alias("props"), F.array(F.struct(F.lit(-80.0).alias("lon"), F.lit(40.0).alias("lat"))).alias("points"))
    out = None
    for feed in ("md_karst_survey", "la_subsidence", "nc_cave_survey", "ma_usgs_mines"):
        part = feeds.normalise_ground_truth(rows, feed)
        out = part if out is None else out.unionByName(part)
    return out.select("source", "name", "feature_type", F.col("metadata")["commodity"].alias("commodity"))


@register("a8_osm_layer", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'roads' ELSE 'landuse' END AS layer FROM part WHERE (p_size % 4 = 0 AND p_type IN ('ECONOMY', 'SMALL')) OR (p_size % 4 = 1 AND p_type IN ('LARGE', 'PROMO'))""")
def _a8(spark, sf):
    road = F.create_map(F.lit("highway"), F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "residential").otherwise("footway"))
    land = F.create_map(F.lit("landuse"), F.when(F.col("p_type").isin("LARGE", "PROMO"), "quarry").otherwise("meadow"))
    none = F.create_map(F.lit("name"), F.col("p_name"))
    f = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, road).when(F.col("p_size") % 4 == 1, land).otherwise(none).alias("tags"))
    return feeds.osm_layer(f, "roads").select("id", F.lit("roads").alias("layer")).unionByName(feeds.osm_layer(f, "landuse").select("id", F.lit("landuse").alias("layer")))


@register("a9_seed_if_absent", f"WITH {SITES} SELECT site_id FROM sites WHERE source = 'src3'")
def _a9(spark, sf):
    s = fixture(spark, sf, "sites")
    new = s.where("source = 'src3'")
    return feeds.seed_if_absent(new, s).unionByName(feeds.seed_if_absent(new, s, "src4")).select("site_id")


@register("a10_to_detections", f"""WITH {CAND} SELECT sha256(concat('j1|', CAST(cand_id AS VARCHAR))) AS id, CASE WHEN depth_m = 0 THEN 2.5 ELSE depth_m END AS depth_m, area_m2, round(circularity, 4) AS circularity, score AS confidence, 'j1' AS job_id FROM cand""")
def _a10(spark, sf):
    from fellscan.registered.detect import cand

    c = cand(spark, sf).withColumn("morphometrics", F.map_concat("morphometrics", F.create_map(F.lit("lrm_anomaly_m"), F.lit(2.5))))
    return sinks.to_detections(c, "j1", "sinkhole_survey").select("id", "depth_m", "area_m2", F.col("morphometrics")["circularity"].alias("circularity"), "confidence", "job_id")


@register("a10_pass_results", f"""WITH {CAND} SELECT sha256(concat('j1|', CAST(cand_id AS VARCHAR))) AS detection_id, pass_name, round(score, 4) AS raw_score FROM cand""")
def _a10p(spark, sf):
    from fellscan.registered.detect import cand

    c = cand(spark, sf)
    return sinks.pass_results(sinks.to_detections(c, "j1", "p"), c.withColumn("cluster_id", F.col("cand_id"))).select("detection_id", "pass_name", "raw_score")


@register("a11_to_geojson", f"""WITH {DET} SELECT concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', CAST(id AS VARCHAR), ',', CAST(id + 1 AS VARCHAR), ']}},"properties":{{"id":', CAST(id AS VARCHAR), ',"feature_type":"', feature_type, '"}}}}') AS value FROM detections WHERE {INBOX}""")
def _a11(spark, sf):
    d = views.query_detections(det(spark, sf), BOX).select("id", "feature_type", F.col("id").alias("lon"), (F.col("id") + 1).alias("lat"))
    return sinks.to_geojson(d, None)


@register("a12_to_csv_rows", f"WITH {DET} SELECT id, feature_type, lon, lat, confidence, depth_m, area_m2, validated, created_at FROM detections ORDER BY confidence DESC, id LIMIT 100000")
def _a12(spark, sf):
    return sinks.to_csv_rows(det(spark, sf))


VT = tile_sql("z", "lon", "lat")


@register("a13_vector_tile_rows", f"""WITH {DET}, f AS (SELECT id, z, {VT[0]} AS fx, {VT[1]} AS fy FROM detections, (VALUES (10), (13)) v(z)),
    t AS (SELECT id, z, fx, fy, CAST(floor(fx) AS BIGINT) + dx AS tx, CAST(floor(fy) AS BIGINT) + dy AS ty FROM f, range(-1, 2) a(dx), range(-1, 2) b(dy))
    SELECT id, z, tx, ty, CAST(floor((fx - tx) * 4096) AS INT) AS px, CAST(floor((fy - ty) * 4096) AS INT) AS py FROM t WHERE tx BETWEEN floor(fx - 0.0625) AND floor(fx + 0.0625) AND ty BETWEEN floor(fy - 0.0625) AND floor(fy + 0.0625)""")
def _a13(spark, sf):
    return sinks.vector_tile_rows(det(spark, sf), [10, 13]).select("id", "z", "tx", "ty", "px", "py")


AP = [tile_sql("z", "west", "north"), tile_sql("z", "east", "south")]


@register("a14_tile_plan", f"""WITH {BOXES}, s AS (SELECT name AS area, z, CAST(floor({AP[0][0]}) AS BIGINT) AS x0, CAST(floor({AP[1][0]}) AS BIGINT) AS x1, CAST(floor({AP[0][1]}) AS BIGINT) AS y0, CAST(floor({AP[1][1]}) AS BIGINT) AS y1 FROM bx, range(10, 14) r(z))
    SELECT area, CAST(z AS INT) AS z, x, y FROM s, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)""")
def _a14(spark, sf):
    n = load(spark, sf, "nation")
    west, south = -80 + (F.col("n_nationkey") % 5) * F.lit(0.2), 40 + F.expr("n_nationkey DIV 5") * F.lit(0.2)
    areas = n.select(F.concat(F.lit("area"), "n_nationkey").alias("area"), west.alias("west"), south.alias("south"), (west + 0.25).alias("east"), (south + 0.25).alias("north"))
    return sinks.tile_plan(areas, 10, 13)


CATALOG = """ct AS (SELECT c_custkey AS k, concat('src-', CAST(c_custkey % 1400 AS VARCHAR)) AS id, -80 + (c_custkey % 50) / 1e2 AS west, 40.0 AS south, -80 + (c_custkey % 50) / 1e2 + (CASE WHEN c_custkey % 13 = 0 THEN -0.1 ELSE 0.1 END) AS east, 40.3 AS north, CAST(c_custkey % 12 AS INT) AS min_zoom FROM customer)"""


def catalog_doc(spark, sf):
    k = F.col("c_custkey")
    west = -80 + k % 50 / F.lit(1e2)
    s = load(spark, sf, "customer").select(k, F.struct(
        F.concat(F.lit("src-"), k % 1400).alias("id"), F.lit("geology").alias("category"), F.array(west, F.lit(40.0), west + F.when(k % 13 == 0, -0.1).otherwise(0.1), F.lit(40.3)).alias("bounds"),
        (k % 12).cast("int").alias("min_zoom"), F.lit(14).alias("max_zoom"), F.lit("https://x").alias("source_url"), F.lit(None).cast("string").alias("legend_url"), F.lit(None).cast("string").alias("terms_url")).alias("s"))
    return s.select(F.lit(1).alias("version"), F.array("s").alias("sources"))


@register("a15_context_catalog", f"""WITH {CATALOG} SELECT id, CASE WHEN n > 1 THEN 'duplicate' WHEN west >= east THEN 'bounds' END AS problem FROM ct JOIN (SELECT id, count(*) AS n FROM ct GROUP BY 1) d USING (id)""")
def _a15(spark, sf):
    return sinks.context_catalog(catalog_doc(spark, sf)).select("id", "problem")


@register("j22_context_for_tiles", f"""WITH {CATALOG}, {DET}, g AS (SELECT DISTINCT 11 AS z, CAST(floor({tile_sql('11', 'lon', 'lat')[0]}) AS BIGINT) AS x, CAST(floor({tile_sql('11', 'lon', 'lat')[1]}) AS BIGINT) AS y FROM detections),
    b AS (SELECT *, x / 2048.0 * 360 - 180 AS w, (x + 1) / 2048.0 * 360 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2 * y / 2048.0)))) AS n, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 2048.0)))) AS s FROM g)
    SELECT DISTINCT z, x, y, id AS source FROM b JOIN ct ON e > west AND w < east AND n > south AND s < north AND min_zoom <= 11 WHERE west < east""")
def _j22(spark, sf):
    fx, fy = sc.tile_position("lon", "lat", F.lit(11))
    grid = det(spark, sf).select(F.lit(11).alias("z"), F.floor(fx).alias("x"), F.floor(fy).alias("y")).distinct()
    good = sinks.context_catalog(catalog_doc(spark, sf)).where("problem IS NULL OR problem <> 'bounds'")
    return sinks.context_for_tiles(grid, good)


FIND = """fd AS (SELECT conv_id AS g, turn, role, text, conv_id * 1000 + turn AS id FROM conversations)"""


def findings(spark, sf):
    c = load(spark, sf, "conversations")
    bad = F.col("turn") % 5 == 4
    pts = F.when(bad, F.array(F.struct(F.lit(200.0).alias("lon"), F.lit(10.0).alias("lat")))).otherwise(F.array(F.struct(F.lit(-80.0).alias("lon"), F.lit(40.0).alias("lat"))))
    return c.select(F.col("conv_id").cast("string").alias("investigation_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.col("role").alias("title"), F.col("text").alias("notes"),
                    F.lit("").alias("evidence"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"), F.when(F.col("turn") % 3 == 2, "odd").otherwise("interesting").alias("review"),
                    F.lit("Point").alias("geometry_type"), pts.alias("points"))


@register("p16_notebook_violations", f"""WITH {FIND} SELECT CAST(g AS VARCHAR) AS investigation_id, CAST(id AS VARCHAR) AS id, 'review' AS rule FROM fd WHERE turn % 3 = 2
    UNION ALL SELECT CAST(g AS VARCHAR), CAST(id AS VARCHAR), 'coordinates' FROM fd WHERE turn % 5 = 4 UNION ALL SELECT CAST(g AS VARCHAR), CAST(id AS VARCHAR), 'text_notes' FROM fd WHERE length(text) > 100000""")
def _p16(spark, sf):
    return contracts.notebook_violations(findings(spark, sf))


@register("a16_notebook_round_trip", f"""WITH {FIND} SELECT CAST(g AS VARCHAR) AS investigation_id, count(*) AS n, min(CAST(id AS VARCHAR)) AS first_id, count(*) FILTER (g % 7 = 0) AS orphans FROM fd GROUP BY 1""")
def _a16(spark, sf):
    f = findings(spark, sf).drop("notes")
    text = sinks.findings_to_geojson(f)
    back = text.select(F.from_json("value", "id string, geometry struct<type:string>, properties struct<investigation_id:string>").alias("j")).select("j.id", F.col("j.properties.investigation_id").alias("investigation_id"))
    known = f.select(F.col("investigation_id").alias("id")).distinct().where("CAST(id AS BIGINT) % 7 <> 0")
    out = sinks.findings_from_geojson(back, known)
    return out.groupBy("investigation_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.count_if("orphan").alias("orphans"))


LINES = f"""ln AS (SELECT id, lon, lat, lon + (id % 40) / 1e3 AS lon2, lat + (id % 30) / 1e3 AS lat2 FROM detections)"""


@register("p17_measurement_violations", f"""WITH {DET}, {LINES}, d AS (SELECT id, {HAV.replace('a.lat', 'lat').replace('a.lon', 'lon').replace('b.lat', 'lat2').replace('b.lon', 'lon2')} AS m FROM ln) SELECT id, 'length' AS rule FROM d WHERE m > 4000 OR m <= 0""")
def _p17(spark, sf):
    d = det(spark, sf)
    pts = F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + F.col("id") % 40 / F.lit(1e3)).alias("lon"), (F.col("lat") + F.col("id") % 30 / F.lit(1e3)).alias("lat")))
    return contracts.measurement_violations(d.select("id", F.lit("LineString").alias("geometry_type"), pts.alias("points")), 4000)


@register("t11_profile_points")
def _t11(spark, sf):
    d = det(spark, sf)
    pts = F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 0.02).alias("lon"), (F.col("lat") + 0.01).alias("lat")), F.struct((F.col("lon") + 0.02).alias("lon"), (F.col("lat") + 0.03).alias("lat")))
    out = measure.profile_points(d.select(F.col("id").alias("line_id"), pts.alias("points")), 11)
    return out.select("line_id", "i", *[rnd(c).alias(c) for c in ("distance_m", "lon", "lat")])


@register("a18_register_area", """SELECT 'new' AS slug, count(*) AS n FROM (SELECT 1) UNION ALL SELECT concat('area', CAST(n_nationkey AS VARCHAR)), 1 FROM nation""")
def _a18(spark, sf):
    n = load(spark, sf, "nation")
    areas = n.select(F.concat(F.lit("area"), "n_nationkey").alias("slug"), F.col("n_name").alias("name"), F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(1.0).alias("east"), F.lit(1.0).alias("north"), F.lit(1.0).alias("resolution_m"))
    inv = tiles(spark, sf).select("west", "south", "east", "north", F.lit(1.0).alias("resolution_m"))
    return cells.register_area(inv, areas, "new", "New area").groupBy("slug").agg(F.count("*").alias("n"))


# ---- resampling ----------------------------------------------------------------------------------------------------

@register("r17_feather", f"""WITH {ctes('dem', 'holes')}, e AS (SELECT h.survey_id, h."row", h.col, h.z, min(CASE WHEN d.z IS NULL THEN sqrt(dr * dr + dc * dc) END) AS d FROM holes h, range(-3, 4) a(dr), range(-3, 4) b(dc)
      LEFT JOIN holes d ON d.survey_id = h.survey_id AND d."row" = h."row" + dr AND d.col = h.col + dc GROUP BY 1, 2, 3, 4)
    SELECT {KEY}, {rd('least(coalesce(d, 3) / 3, 1.0)')} AS weight, {rd('z * least(coalesce(d, 3) / 3, 1.0) + 100 * (1 - least(coalesce(d, 3) / 3, 1.0))')} AS value FROM e""")
def _r17(spark, sf):
    from fellscan.operators.focal import feather

    h = fixture(spark, sf, "holes").select("survey_id", "row", "col", F.col("z").cast("double").alias("value"))
    out = feather(h, h.withColumn("value", F.lit(100.0)), 3)
    return out.select("survey_id", "row", "col", rnd("weight").alias("weight"), rnd("value").alias("value"))


@register("r18_fill_gaps", f"""WITH {ctes('dem', 'holes')}, g AS (SELECT d.survey_id, d."row", d.col FROM dem d WHERE ("row" * 31 + col * 17) % 97 = 0), c AS (SELECT g.survey_id, g."row", g.col, h.z, row_number() OVER (PARTITION BY g.survey_id, g."row", g.col
      ORDER BY dr * dr + dc * dc, h."row", h.col) AS k FROM g, range(-4, 5) a(dr), range(-4, 5) b(dc) JOIN holes h ON h.survey_id = g.survey_id AND h."row" = g."row" + dr AND h.col = g.col + dc WHERE dr * dr + dc * dc <= 16)
    SELECT {KEY}, z FROM holes UNION ALL SELECT {KEY}, z FROM c WHERE k = 1""")
def _r18(spark, sf):
    return warp.fill_gaps(fixture(spark, sf, "holes"), 4)


@register("r26_patches", f"""WITH {DEM}, p AS (SELECT survey_id, z, pr * 12 AS patch_row, pc * 12 AS patch_col FROM dem, range(0, 30) a(pr), range(0, 10) b(pc) WHERE "row" >= pr * 12 AND "row" < pr * 12 + 16 AND col >= pc * 12 AND col < pc * 12 + 16)
    SELECT survey_id, patch_row, patch_col, count(*) AS cells, CAST(sum(z) AS BIGINT) AS sum_z FROM p GROUP BY 1, 2, 3""")
def _r26(spark, sf):
    return warp.patches(fixture(spark, sf, "dem"), 16, 4).groupBy("survey_id", "patch_row", "patch_col").agg(F.count("*").alias("cells"), F.sum("z").alias("sum_z"))


@register("r26_stitch", f"""WITH {DEM} SELECT {KEY}, CAST(z AS DOUBLE) AS z FROM dem""")
def _r26s(spark, sf):
    return warp.stitch(warp.patches(fixture(spark, sf, "dem"), 16, 4), "z")


def utm_survey(d):
    return d.select("survey_id").distinct().select("survey_id", F.lit(32617).alias("epsg"), F.lit(500000.0).alias("x0"), F.lit(4480000.0).alias("y0"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"), F.lit(1.0).alias("resolution_m"))


@register("r21_to_mercator")
def _r21(spark, sf):
    d = fixture(spark, sf, "dem")
    return warp.to_mercator(d, utm_survey(d), 16).withColumn("value", rnd("value"))


@register("e5_profiles")
def _e5(spark, sf):
    d = fixture(spark, sf, "dem")
    grid = utm_survey(d).withColumnRenamed("survey_id", "source_id").withColumn("path", F.col("source_id"))
    lon0, lat0 = geodesy.utm_inverse(F.lit(500002.0) + F.col("row") % 40, F.lit(4479990.0) - F.col("row"), F.lit(17))
    lon1, lat1 = geodesy.utm_inverse(F.lit(500060.0), F.lit(4479800.0), F.lit(17))
    lines = d.groupBy("survey_id", "row").agg(F.count("*").alias("n")).select(F.concat_ws(":", "survey_id", "row").alias("line_id"), F.array(F.struct(lon0.alias("lon"), lat0.alias("lat")), F.struct(lon1.alias("lon"), lat1.alias("lat"))).alias("points"))
    out = measure.profiles(lines, d.withColumnRenamed("survey_id", "source_id"), grid, 21)
    return out.select("line_id", "i", rnd("distance_m", 4).alias("distance_m"), "elevation_m", "source")



"""Point grids, detection passes, fusion and filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fellscan.operators import components as comp
from fellscan.operators import fill, focal, horizon, pointgrid, regions
from fellscan.operators.quantiles import exact_quantile
from fellscan.plans import discovery, filters, fusion
from fellscan.plans.registry import get_pass
from fellscan.plans import passes  # noqa: F401  (declares the passes)
from fellscan.plans.passes import mask, normalise_svf, sanitise
from fellscan.registered.base import rd, register, rnd
from fellscan.registered.fixtures import components, ctes, fixture, nine
from fellscan.registered.terrain import BLOCK, DEM, FILL, FULL, KEY, LAB, PERIM, SMOOTH, horizon_sql, smooth
from fellscan.sources.presets import PRESETS, preset_weights

PTS = ctes("points")
CAND = ctes("cand")


def points(spark, sf):
    return fixture(spark, sf, "points")


def cand(spark, sf):
    c = fixture(spark, sf, "cand")
    morph = F.create_map(*[x for k in ("depth_m", "area_m2", "circularity", "elongation") for x in (F.lit(k), F.col(k).cast("double"))])
    return c.withColumns({"morphometrics": morph, "score": F.col("score").cast("double"), "lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double"),
                          "x": F.col("mx"), "y": F.col("my")})


# ---- point grids ---------------------------------------------------------------------------------------------------

BOUNDS = """bd AS (SELECT survey_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY 1)"""


def binned(cell: float, where: str = "") -> str:
    return f"""bn AS (SELECT p.survey_id, CAST(greatest(least(floor((y1 - y) / {cell}), greatest(ceil((y1 - y0) / {cell}), 1) - 1), 0) AS BIGINT) AS "row",
      CAST(greatest(least(floor((x - x0) / {cell}), greatest(ceil((x1 - x0) / {cell}), 1) - 1), 0) AS BIGINT) AS col, p.number_of_returns FROM points p JOIN bd USING (survey_id) {where}),
    lat AS (SELECT survey_id, r AS "row", c AS col FROM bd, unnest(range(0, CAST(greatest(ceil((y1 - y0) / {cell}), 1) AS BIGINT))) a(r),
      unnest(range(0, CAST(greatest(ceil((x1 - x0) / {cell}), 1) AS BIGINT))) b(c))"""


DENSITY = f"""WITH {PTS}, {BOUNDS}, {binned(4)}, ct AS (SELECT survey_id, "row", col, count(*) AS n FROM bn GROUP BY 1, 2, 3),
    st AS (SELECT survey_id, avg(n) AS m, CASE WHEN stddev_pop(n) < 1e-10 THEN 1.0 ELSE stddev_pop(n) END AS s FROM ct GROUP BY 1),
    dz AS MATERIALIZED (SELECT l.survey_id, l."row", l.col, coalesce(n, 0) AS density, (coalesce(n, 0) - m) / s AS z_score FROM lat l
      LEFT JOIN ct c ON c.survey_id = l.survey_id AND c."row" = l."row" AND c.col = l.col JOIN st ON st.survey_id = l.survey_id)"""


@register("g6_point_density", f"{DENSITY} SELECT {KEY}, density, {rd('z_score')} AS z_score FROM dz")
def _density(spark, sf):
    return pointgrid.point_density(points(spark, sf), 4.0).withColumn("z_score", rnd("z_score"))


RATIO = f"""WITH {PTS}, {BOUNDS}, {binned(5, 'WHERE classification NOT IN (3, 4, 5)')},
    ct AS (SELECT survey_id, "row", col, avg(CASE WHEN number_of_returns > 1 THEN 1.0 ELSE 0.0 END) AS ratio FROM bn GROUP BY 1, 2, 3),
    mr AS MATERIALIZED (SELECT l.survey_id, l."row", l.col, coalesce(ratio, 0.0) AS ratio FROM lat l LEFT JOIN ct c ON c.survey_id = l.survey_id AND c."row" = l."row" AND c.col = l.col)"""


@register("g7_multi_return_ratio", f"{RATIO} SELECT {KEY}, {rd('ratio')} AS ratio FROM mr")
def _ratio(spark, sf):
    return pointgrid.multi_return_ratio(points(spark, sf), 5.0).withColumn("ratio", rnd("ratio"))


@register("p10_exclude_vegetation", f"WITH {PTS} SELECT classification, count(*) AS n FROM points WHERE classification NOT IN (3, 4, 5) GROUP BY 1")
def _veg(spark, sf):
    return pointgrid.exclude_vegetation(points(spark, sf)).groupBy("classification").agg(F.count("*").alias("n"))


@register("g15_ground_share", f"""WITH {PTS} SELECT survey_id, {rd('avg(CASE WHEN classification = 2 THEN 1.0 ELSE 0.0 END)')} AS ground_share,
    avg(CASE WHEN classification = 2 THEN 1.0 ELSE 0.0 END) > 0.1 AS pre_classified FROM points GROUP BY 1""")
def _ground(spark, sf):
    return pointgrid.ground_share(points(spark, sf)).withColumn("ground_share", rnd("ground_share"))


TOP = "bd AS (SELECT survey_id, floor(min(x)) AS x0, ceil(max(y)) AS y1 FROM points GROUP BY 1)"


def covered(res: float, radius: float, where: str = "") -> str:
    k = math.ceil(radius / res)
    return f"""uv AS (SELECT p.survey_id, (x - x0) / {res} AS u, (y1 - y) / {res} AS v, z FROM points p JOIN bd USING (survey_id) {where}),
    cv AS (SELECT survey_id, CAST(floor(v) AS BIGINT) + dr AS "row", CAST(floor(u) AS BIGINT) + dc AS col, z,
      sqrt(((floor(u) + dc + 0.5 - u) * {res}) * ((floor(u) + dc + 0.5 - u) * {res}) + ((floor(v) + dr + 0.5 - v) * {res}) * ((floor(v) + dr + 0.5 - v) * {res})) AS d
      FROM uv, range({-k}, {k + 1}) a(dr), range({-k}, {k + 1}) b(dc))"""


@register("g18_grid_mean", f"""WITH {PTS}, {TOP}, {covered(4, 4.5)}, g AS (SELECT survey_id, "row", col, avg(z) AS z FROM cv WHERE d <= 4.5 GROUP BY 1, 2, 3),
    f AS (SELECT survey_id, "row" + dr AS "row", col + dc AS col, sum(z / sqrt(dr * dr + dc * dc)) / sum(1 / sqrt(dr * dr + dc * dc)) AS z
      FROM g, range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE dr <> 0 OR dc <> 0 GROUP BY 1, 2, 3)
    SELECT {KEY}, {rd('z')} AS z FROM g UNION ALL
    SELECT {KEY}, {rd('z')} AS z FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.survey_id = f.survey_id AND g."row" = f."row" AND g.col = f.col)""")
def _grid_mean(spark, sf):
    return pointgrid.grid_mean(points(spark, sf), 4.0, 4.5).withColumn("z", rnd("z"))


IDW = """SELECT survey_id, "row", col, coalesce(avg(CASE WHEN d < 1e-9 THEN z END), sum(z / greatest(d, 1e-9)) / sum(1 / greatest(d, 1e-9))) AS z FROM cv WHERE d <= {r} GROUP BY 1, 2, 3"""


@register("g19_grid_idw", f"WITH {PTS}, {TOP}, {covered(4, 4)}, g AS ({IDW.format(r=4)}) SELECT {KEY}, {rd('z')} AS z FROM g")
def _idw(spark, sf):
    return pointgrid.grid_idw(points(spark, sf), 4.0, 1.0, 4.0).withColumn("z", rnd("z"))


@register("r24_full_return", f"""WITH {PTS}, {TOP}, {covered(4, 4 * math.sqrt(2), 'WHERE classification IN (1, 2, 7)').replace("bd USING", "(SELECT survey_id, floor(min(x)) AS x0, ceil(max(y)) AS y1 FROM points WHERE classification IN (1, 2, 7) GROUP BY 1) bd USING")},
    g AS ({IDW.format(r=repr(4 * math.sqrt(2)))}) SELECT {KEY}, {rd('z')} AS z FROM g""")
def _full(spark, sf):
    return pointgrid.full_return(points(spark, sf), 4.0).withColumn("z", rnd("z"))


@register("r23_smrf")
def _smrf(spark, sf):
    return pointgrid.smrf(points(spark, sf), window=6, block=BLOCK).groupBy("survey_id", "ground").agg(F.count("*").alias("n"))


# ---- predicates on surfaces ----------------------------------------------------------------------------------------

@register("p3_sanitise", f"""WITH {DEM} SELECT {KEY}, CASE WHEN z < 150 AND z > -150 THEN CAST(z AS DOUBLE) ELSE 0.0 END AS z FROM dem""")
def _sanitise(spark, sf):
    return sanitise(fixture(spark, sf, "dem"), "z", 150, -150)


@register("p4_mask", f"WITH {SMOOTH} SELECT {KEY}, z FROM smooth WHERE z < -900")
def _mask(spark, sf):
    return mask(smooth(spark, sf), "z", "<", -900)


@register("p9_normalise_svf", f"""WITH {DEM}, v AS (SELECT survey_id, "row", col, z / 100.0 AS svf FROM dem)
    SELECT v.survey_id, v."row", v.col, CASE WHEN top > 1.5 THEN {rd('svf / top')} ELSE {rd('svf')} END AS svf FROM v JOIN (SELECT survey_id, max(svf) AS top FROM v GROUP BY 1) t USING (survey_id)""")
def _svf(spark, sf):
    d = fixture(spark, sf, "dem").select("survey_id", "row", "col", (F.col("z") / 100.0).alias("svf"))
    return normalise_svf(d).withColumn("svf", rnd("svf"))


# ---- passes --------------------------------------------------------------------------------------------------------




def shown(found, **keys):
    c = found.candidates
    return c.select("survey_id", "region_id", *[rnd(k).alias(k) for k in ("row", "col", "score", "area_m2")], "feature_type",
                    *[rnd(F.col("morphometrics")[k]).alias(v) for k, v in keys.items()])


def pass_sql(with_: str, mask_cte: str, score: str, kind: str, having: str, value: str, out: str, rec: bool = True) -> str:
    return f"""{with_}, m AS MATERIALIZED ({mask_cte}), {components('m')}
    SELECT survey_id, region_id, {rd('avg("row") + 0.5')} AS "row", {rd('avg(col) + 0.5')} AS col, {rd(score)} AS score, CAST(count(*) AS DOUBLE) AS area_m2,
      '{kind}' AS feature_type, {rd(value)} AS {out} FROM lab GROUP BY 1, 2 HAVING {having}"""


REC_DEM = f"WITH RECURSIVE {DEM}"


@register("d1_fill_difference", pass_sql(f"{REC_DEM}, {nine('dem')}, {FILL}", """SELECT d.survey_id, d."row", d.col, (w.lvl - d.z) / 100.0 AS v FROM dem d
    JOIN w ON w.survey_id = d.survey_id AND w.r = d."row" AND w.c = d.col WHERE (w.lvl - d.z) / 100.0 > 0.5""", "least(max(v) / 5.0, 1.0)", "depression",
    "count(*) BETWEEN 4 AND 5000", "max(v)", "depth_m"))
def _d1(spark, sf):
    s = fill.fill_difference(fixture(spark, sf, "dem"), BLOCK).withColumn("fill_diff", F.col("fill_diff") / 100.0)
    return shown(get_pass("fill_difference")(s, min_area_m2=4, block=BLOCK), depth_m="depth_m")


@register("d2_local_relief_model", pass_sql(f"""{REC_DEM}, b AS (SELECT a.survey_id, a."row", a.col, a.z - CAST(sum(b.z) AS DOUBLE) / count(*) AS l7,
      a.z - CAST(sum(CASE WHEN abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 THEN b.z END) AS DOUBLE) / sum(CASE WHEN abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 THEN 1 END) AS l3
      FROM dem a JOIN dem b ON a.survey_id = b.survey_id AND b."row" BETWEEN a."row" - 3 AND a."row" + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY a.survey_id, a."row", a.col, a.z)""",
    """SELECT survey_id, "row", col, least(l7, l3) AS v FROM b WHERE least(l7, l3) < -90""", "least(-min(v) / 3.0, 1.0)", "cave_entrance", "count(*) BETWEEN 3 AND 5000", "-min(v)", "lrm_anomaly_m"))
def _d2(spark, sf):
    d = fixture(spark, sf, "dem")
    s = focal.lrm(focal.lrm(d, 3, block=BLOCK), 7, block=BLOCK)
    return shown(get_pass("local_relief_model")(s, threshold_m=90, min_area_m2=3, block=BLOCK), lrm_anomaly_m="lrm_anomaly_m")


NB = f"{REC_DEM}, {nine('dem')}"


@register("d3_tpi", pass_sql(NB, f"""SELECT survey_id, "row", col, (ne-(na+nb+nc+nd+nf+ng+nh+ni)/8)/100 AS v FROM nb WHERE {FULL} AND (ne-(na+nb+nc+nd+nf+ng+nh+ni)/8)/100 < -1.0""",
    "least(abs(min(v)) / 5.0, 1.0)", "sinkhole", "count(*) >= 2", "min(v)", "min_tpi"))
def _d3(spark, sf):
    s = focal.tpi(fixture(spark, sf, "dem"), BLOCK).withColumn("tpi", F.col("tpi") / 100).where("tpi IS NOT NULL")
    return shown(get_pass("tpi")(s, min_area_pixels=2, block=BLOCK), min_tpi="min_tpi")


@register("d4_curvature", pass_sql(f"""{NB}, t AS (SELECT *, ((nd+nf)/2-ne)/1000 AS td, ((nb+nh)/2-ne)/1000 AS te, (-na+nc+ng-ni)/4000 AS tf, (-nd+nf)/2000 AS tg, (nb-nh)/2000 AS th FROM nb)""",
    f"""SELECT * FROM (SELECT survey_id, "row", col, CASE WHEN tg*tg+th*th=0 THEN 0.0 ELSE -2*(td*tg*tg+te*th*th+tf*tg*th)/(tg*tg+th*th) END AS v FROM t WHERE {FULL}) q WHERE v < -0.10037""",
    "least(abs(min(v)) / 0.1, 1.0)", "depression", "count(*) >= 4", "min(v)", "min_curvature"))
def _d4(spark, sf):
    s = focal.profile_curvature(fixture(spark, sf, "dem").withColumn("z", F.col("z") / 1000.0), block=BLOCK)
    return shown(get_pass("curvature")(s, threshold=-0.10037, block=BLOCK), min_curvature="min_curvature")


@register("d5_sky_view_factor", pass_sql(horizon_sql(3, "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip(), "SELECT survey_id, \"row\", col, svf AS v FROM views WHERE svf < 0.45",
    "least(greatest(1 - min(v), 0.0), 1.0)", "depression", "count(*) >= 2", "min(v)", "min_svf"))
def _d5(spark, sf):
    s = horizon.horizon(fixture(spark, sf, "dem").withColumn("z", F.col("z") / 50.0), 3, ("svf",), block=BLOCK).where("svf IS NOT NULL")
    return shown(get_pass("sky_view_factor")(s, threshold=0.45, min_area_pixels=2, block=BLOCK), min_svf="min_svf")


CLASSIFY = """CASE WHEN {a} > 10000 AND {d} < 5 AND {c} < 0.3 THEN 'salt_dome_collapse' WHEN {c} < 0.2 AND {d} > 0.5 AND {a} > 500 THEN 'lava_tube'
    WHEN {d} > 3 AND {a} < 500 AND {c} > 0.4 THEN 'cave_entrance' WHEN {c} < 0.3 AND {d} > 1 AND {a} < 1000 THEN 'mine_portal'
    WHEN {a} > 200 AND {d} > 0.5 AND {c} > 0.5 THEN 'sinkhole' WHEN {d} > 0.5 THEN 'depression' ELSE 'unknown' END"""


@register("d6_morphometric_filter", f"""{REC_DEM}, {nine('dem')}, {FILL}, m AS MATERIALIZED (SELECT d.survey_id, d."row", d.col, d.z, (w.lvl - d.z) / 100.0 AS v FROM dem d
    JOIN w ON w.survey_id = d.survey_id AND w.r = d."row" AND w.c = d.col WHERE (w.lvl - d.z) / 100.0 > 0.3), {components('m')}, {PERIM},
    g AS (SELECT survey_id, region_id, CAST(count(*) AS DOUBLE) AS a, (max(z) - min(z)) / 100.0 AS d, sum(CASE WHEN n4 < 4 THEN 1 ELSE 0 END) AS p, avg("row") + 0.5 AS r, avg(col) + 0.5 AS c0 FROM fl GROUP BY 1, 2),
    h AS (SELECT *, 4 * pi() * a / (p * p) AS c FROM g)
    SELECT survey_id, region_id, {rd('r')} AS "row", {rd('c0')} AS col, {rd('(least(d / 5.0, 1.0) + c) / 2')} AS score, a AS area_m2, {CLASSIFY.format(a='a', d='d', c='c')} AS feature_type,
      {rd('d')} AS depth_m, {rd('c')} AS circularity FROM h WHERE a BETWEEN 4 AND 4000 AND c >= 0.15 AND d >= 0.3""")
def _d6(spark, sf):
    s = fill.fill_difference(fixture(spark, sf, "dem"), BLOCK).withColumns({"fill_diff": F.col("fill_diff") / 100.0, "z": F.col("z") / 100.0})
    return shown(get_pass("morphometric_filter")(s, min_area_m2=4, block=BLOCK), depth_m="depth_m", circularity="circularity")


@register("d7_point_density", pass_sql(DENSITY.replace("WITH ", "WITH RECURSIVE ", 1), 'SELECT survey_id, "row", col, z_score AS v FROM dz WHERE z_score < -1.2', "least(abs(min(v)) / 5.0, 1.0)",
    "cave_entrance", "count(*) >= 2", "min(v)", "density_z_score").replace("CAST(count(*) AS DOUBLE) AS area_m2", "CAST(count(*) * 16 AS DOUBLE) AS area_m2"))
def _d7(spark, sf):
    return shown(get_pass("point_density")(points(spark, sf), cell_size_m=4.0, z_score_threshold=-1.2, block=BLOCK), density_z_score="density_z_score")


@register("d8_multi_return", pass_sql(RATIO.replace("WITH ", "WITH RECURSIVE ", 1), 'SELECT survey_id, "row", col, ratio AS v FROM mr WHERE ratio > 0.6', "least(max(v), 1.0)",
    "cave_entrance", "count(*) >= 2", "max(v)", "multi_return_ratio").replace("CAST(count(*) AS DOUBLE) AS area_m2", "CAST(count(*) * 25 AS DOUBLE) AS area_m2"))
def _d8(spark, sf):
    return shown(get_pass("multi_return")(points(spark, sf), search_radius_m=5.0, min_multi_return_ratio=0.6, block=BLOCK), multi_return_ratio="multi_return_ratio")


# ---- fusion --------------------------------------------------------------------------------------------------------

def cluster_sql(eps: float, x: str, y: str, name: str = "cl", src: str = "cand", scope: str = "'all'") -> str:
    """Chain points closer than eps by recursion over the pair graph, which meets on eps-sized buckets."""
    return f"""pt AS MATERIALIZED (SELECT *, {scope} AS sc, {x} AS px, {y} AS py FROM {src}),
    bu AS MATERIALIZED (SELECT sc, cand_id, px, py, CAST(floor(px / {eps}) AS BIGINT) AS gx, CAST(floor(py / {eps}) AS BIGINT) AS gy FROM pt),
    pr AS MATERIALIZED (SELECT a.cand_id AS u, b.cand_id AS v FROM (SELECT bu.*, gx + dx AS hx, gy + dy AS hy FROM bu, range(-1, 2) i(dx), range(-1, 2) j(dy)) a
      JOIN bu b ON b.sc = a.sc AND b.gx = a.hx AND b.gy = a.hy WHERE a.cand_id <> b.cand_id AND sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) <= {eps}),
    cc(u, root) USING KEY (u) AS (SELECT cand_id, cand_id FROM pt UNION SELECT pr.v, min(cc.root) FROM cc JOIN pr ON pr.u = cc.u JOIN recurring.cc old ON old.u = pr.v
      WHERE cc.root < old.root GROUP BY pr.v),
    {name} AS MATERIALIZED (SELECT pt.*, cc.root AS cluster_id FROM pt JOIN cc ON cc.u = pt.cand_id)"""


@register("c8_eps_clusters", f"WITH RECURSIVE {CAND}, {cluster_sql(60, 'CAST(mx AS DOUBLE)', 'CAST(my AS DOUBLE)')} SELECT cand_id, cluster_id FROM cl")
def _c8(spark, sf):
    return comp.eps_clusters(cand(spark, sf), 60.0, "x", "y", "cand_id").select("cand_id", "cluster_id")


WEIGHTS = PRESETS["sinkhole_survey"].weights
W_SQL = "CASE pass_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END"
def exact(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(28,12))) AS DOUBLE) / count({column})"


MERGE = f"""b AS (SELECT cluster_id, CAST(sum(CAST({W_SQL} * score AS DECIMAL(28,12))) AS DOUBLE) AS ws, CAST(sum(CAST({W_SQL} AS DECIMAL(28,12))) AS DOUBLE) AS sw, count(DISTINCT pass_name) AS np, count(*) AS members, {exact('px0')} AS ax, {exact('py0')} AS ay,
      {exact('depth_m')} AS depth_m, {exact('area_m2')} AS area_m2, {exact('circularity')} AS circularity, {exact('elongation')} AS elongation, string_agg(DISTINCT pass_name, ',' ORDER BY pass_name) AS passes FROM cl GROUP BY 1),
    vt AS (SELECT cluster_id, feature_type, round(sum({W_SQL} * score), 9) AS v, CASE feature_type WHEN 'sinkhole' THEN 1 WHEN 'cave_entrance' THEN 2 ELSE 4 END AS o FROM cl GROUP BY 1, 2),
    tp AS (SELECT cluster_id, feature_type FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY v DESC, o) AS k FROM vt) q WHERE k = 1),
    ol AS (SELECT cluster_id, cand_id AS outline_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY area_m2 DESC, cand_id) AS k FROM cl) q WHERE k = 1),
    fu AS (SELECT *, least(CASE WHEN np >= 3 THEN 1.2 ELSE 1 END * (CASE WHEN sw > 0 THEN ws / sw ELSE 0 END), 1.0) AS conf FROM b JOIN tp USING (cluster_id) JOIN ol USING (cluster_id))"""


@register("g8_merge_clusters", f"""WITH RECURSIVE {CAND}, {cluster_sql(60, 'CAST(mx AS DOUBLE)', 'CAST(my AS DOUBLE)').replace('pt AS MATERIALIZED (SELECT *,', 'pt AS MATERIALIZED (SELECT *, mx AS px0, my AS py0,')}, {MERGE}
    SELECT cluster_id, {rd('conf')} AS score, feature_type, members, np AS num_passes, {rd('ax')} AS x, {rd('ay')} AS y, {rd('depth_m')} AS depth_m, {rd('area_m2')} AS area_m2,
      {rd('circularity')} AS circularity, passes, outline_id FROM fu""")
def _g8(spark, sf):
    cl = fusion.cluster(cand(spark, sf), 60.0, "metric")
    out = fusion.merge_clusters(cl, WEIGHTS, coords="metric")
    m = F.col("morphometrics")
    return out.select("cluster_id", rnd("score").alias("score"), "feature_type", "members", F.col("num_passes").cast("bigint").alias("num_passes"), rnd("x").alias("x"), rnd("y").alias("y"),
                      *[rnd(m[k]).alias(k) for k in ("depth_m", "area_m2", "circularity")], F.concat_ws(",", "source_passes").alias("passes"), "outline_id")


LONLAT = cluster_sql(15, "lon * 111320.0 * cos(radians(lat0))", "lat * 111320.0", src="c2").replace("pt AS MATERIALIZED (SELECT *,", "pt AS MATERIALIZED (SELECT *, lon AS px0, lat AS py0,")


@register("f1_fuse_lonlat", f"""WITH RECURSIVE {CAND}, c2 AS (SELECT cand.*, (SELECT avg(lat) FROM cand) AS lat0 FROM cand), {LONLAT}, {MERGE}
    SELECT cluster_id, {rd('conf')} AS score, feature_type, members, {rd('ax')} AS lon, {rd('ay')} AS lat FROM fu WHERE conf >= 0.3""")
def _f1(spark, sf):
    out = fusion.fuse(cand(spark, sf), WEIGHTS, 15.0)
    return out.select("cluster_id", rnd("score").alias("score"), "feature_type", "members", rnd("lon").alias("lon"), rnd("lat").alias("lat"))


@register("f1_fuse_per_tile", f"""WITH RECURSIVE {CAND}, {cluster_sql(60, 'CAST(mx AS DOUBLE)', 'CAST(my AS DOUBLE)', scope='tile_id').replace('pt AS MATERIALIZED (SELECT *,', 'pt AS MATERIALIZED (SELECT *, mx AS px0, my AS py0,')}, {MERGE}
    SELECT cluster_id, {rd('conf')} AS score, members FROM fu WHERE conf >= 0.3""")
def _f1t(spark, sf):
    return fusion.fuse(cand(spark, sf), WEIGHTS, 60.0, coords="metric", scope="tile_id").select("cluster_id", rnd("score").alias("score"), "members")


@register("f2_split_families", f"""WITH {CAND} SELECT CASE WHEN pass_name IN ('curvature', 'tpi') THEN 'shape' ELSE 'depression' END AS side, count(*) AS n FROM cand GROUP BY 1""")
def _f2(spark, sf):
    renamed = cand(spark, sf).withColumn("pass_name", F.when(F.col("pass_name") == "curvature", "enclosures").when(F.col("pass_name") == "tpi", "linear_features").otherwise(F.col("pass_name")))
    plain, shape = fusion.split_families(renamed)
    both = plain.withColumn("side", F.lit("depression")).unionByName(shape.withColumn("side", F.lit("shape")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@register("f4_reclassify", f"""WITH {CAND}, k AS (SELECT cand_id, {CLASSIFY.format(a='area_m2', d='depth_m', c='circularity')} AS kind, feature_type FROM cand)
    SELECT cand_id, kind AS feature_type, kind <> feature_type AS retyped FROM k""")
def _f4(spark, sf):
    return fusion.reclassify(cand(spark, sf)).select("cand_id", "feature_type", "retyped")


@register("f3_enrich", f"""{LAB}, {PERIM}, g AS (SELECT survey_id, region_id, count(*) AS n, max(z) - min(z) AS d, sum(CASE WHEN n4 < 4 THEN 1 ELSE 0 END) AS p FROM fl GROUP BY 1, 2)
    SELECT concat(survey_id, ':', CAST(region_id AS VARCHAR)) AS outline_id, CAST(d AS DOUBLE) AS depth_m, CAST(n AS DOUBLE) AS area_m2, {rd('4 * pi() * n / (p * p)')} AS circularity, 7.0 AS lrm_anomaly_m FROM g""")
def _f3(spark, sf):
    lab = comp.label(smooth(spark, sf).where("z > 600").select("survey_id", "row", "col"), BLOCK)
    ids = F.concat_ws(":", "survey_id", F.col("region_id").cast("string"))
    fused = lab.select(ids.alias("outline_id")).distinct().withColumn("morphometrics", F.create_map(F.lit("depth_m"), F.lit(1.0), F.lit("lrm_anomaly_m"), F.lit(7.0)))
    out = fusion.enrich(fused, lab.withColumn("outline_id", ids), smooth(spark, sf))
    m = F.col("morphometrics")
    return out.select("outline_id", m["depth_m"].alias("depth_m"), m["area_m2"].alias("area_m2"), rnd(m["circularity"]).alias("circularity"), m["lrm_anomaly_m"].alias("lrm_anomaly_m"))


@register("u1_union_passes", f"""WITH {CAND} SELECT pass_name, count(*) AS n FROM cand GROUP BY 1""")
def _u1(spark, sf):
    c = cand(spark, sf)
    names = ["fill_difference", "local_relief_model", "tpi", "curvature", "sky_view_factor", "point_density", "morphometric_filter"]
    return fusion.union_passes(*[c.where(F.col("pass_name") == n) for n in names]).groupBy("pass_name").agg(F.count("*").alias("n"))


@register("u5_source_passes", f"WITH {CAND} SELECT tile_id, string_agg(DISTINCT pass_name, ',' ORDER BY pass_name) AS passes FROM cand GROUP BY 1")
def _u5(spark, sf):
    return fusion.source_passes(cand(spark, sf), ["tile_id"]).select("tile_id", F.concat_ws(",", "source_passes").alias("passes"))


@register("a17_preset_weights", "SELECT * FROM (VALUES " + ", ".join(
    f"('{p.name}', {i}, '{n}', CAST({p.weights.get(n, 1.0)} AS DOUBLE))" for p in PRESETS.values() for i, n in enumerate(p.passes)) + """) t(preset, ord, pass_name, weight)
    JOIN (SELECT CASE l_linenumber WHEN 1 THEN 'fill_difference' WHEN 2 THEN 'local_relief_model' WHEN 3 THEN 'tpi' WHEN 4 THEN 'curvature' WHEN 5 THEN 'sky_view_factor'
      WHEN 6 THEN 'point_density' ELSE 'morphometric_filter' END AS pass_name, count(*) AS candidates FROM lineitem GROUP BY 1) c USING (pass_name)""")
def _a17(spark, sf):
    from fellscan.registered.fixtures import load

    names = F.array(*[F.lit(n) for n in ("fill_difference", "local_relief_model", "tpi", "curvature", "sky_view_factor", "point_density", "morphometric_filter")])
    per = load(spark, sf, "lineitem").groupBy(F.element_at(names, F.least("l_linenumber", F.lit(7))).alias("pass_name")).agg(F.count("*").alias("candidates"))
    return preset_weights(spark).join(per, "pass_name")


# ---- gates and filters ---------------------------------------------------------------------------------------------

@register("p5_pre_fusion_filter", f"WITH {CAND} SELECT cand_id FROM cand WHERE score > 0.15 AND area_m2 > 20 AND depth_m < 200")
def _p5(spark, sf):
    return filters.pre_fusion_filter(cand(spark, sf)).select("cand_id")


GATE = """CASE WHEN score <= 0.15 THEN 'score' WHEN area_m2 <= 20 THEN 'area' WHEN depth_m <= 0.3 THEN 'depth_low' WHEN depth_m >= 150 THEN 'depth_high'
    WHEN elongation <= 0.4 THEN 'elongation' WHEN circularity <= 0.3 THEN 'circularity' END"""


@register("p6_post_fuse_gate", f"WITH {CAND} SELECT cand_id FROM cand WHERE {GATE} IS NULL")
def _p6(spark, sf):
    return filters.post_fuse_gate(cand(spark, sf)).select("cand_id")


@register("p6_gate_report", f"WITH {CAND} SELECT coalesce({GATE}, 'kept') AS reason, count(*) AS n FROM cand GROUP BY 1")
def _p6r(spark, sf):
    return filters.gate_report(cand(spark, sf))


@register("p7_store_filter", f"WITH {CAND} SELECT cand_id FROM cand WHERE score > 0.4 AND area_m2 > 50 AND depth_m < 100 AND circularity > 0.15 AND elongation > 0.2")
def _p7(spark, sf):
    return filters.store_filter(cand(spark, sf)).select("cand_id")


FOOT = ctes("footprints")
BUILDING = """bd AS (SELECT * FROM footprints WHERE kind = 'building'), ce AS (SELECT * FROM footprints WHERE kind = 'cemetery'),
    ok AS (SELECT * FROM bd b WHERE NOT EXISTS (SELECT 1 FROM ce c WHERE (b.west + b.east) / 2 > c.west AND (b.west + b.east) / 2 < c.east AND (b.south + b.north) / 2 > c.south AND (b.south + b.north) / 2 < c.north))"""


@register("j6_exclude_buildings", f"""WITH {CAND}, {FOOT}, {BUILDING} SELECT cand_id FROM cand WHERE cand_id NOT IN
    (SELECT c.cand_id FROM cand c JOIN ok o ON c.lon > o.west AND c.lon < o.east AND c.lat > o.south AND c.lat < o.north)""")
def _j6(spark, sf):
    f = fixture(spark, sf, "footprints").select("id", "kind", *[F.col(c).cast("double").alias(c) for c in ("west", "south", "east", "north")])
    return filters.exclude_buildings(cand(spark, sf), f.where("kind = 'building'"), f.where("kind = 'cemetery'")).select("cand_id")


SEG_D = """sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1)))"""
T_SQL = "greatest(least(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 1.0), 0.0)"
INFRA = f"""ce AS MATERIALIZED (SELECT concat(survey_id, ':', CAST(region_id AS VARCHAR)) AS cid, col + 0.5 AS x, 250 - "row" - 0.5 AS y FROM lab),
    ln AS (SELECT DISTINCT cid, x, y, layer FROM (SELECT ce.*, s.*, {T_SQL} AS t FROM ce, segments s WHERE layer <> 'landuse') q WHERE {SEG_D} <= CASE layer WHEN 'rail' THEN 4 ELSE 3 END),
    la AS (SELECT DISTINCT cid, x, y, layer FROM ce JOIN segments s ON layer = 'landuse' AND x > x1 AND x < x2 AND y > y1 AND y < y2),
    tot AS (SELECT cid, count(*) AS n FROM ce GROUP BY 1),
    sh AS (SELECT cid, layer FROM (SELECT * FROM ln UNION ALL SELECT * FROM la) h JOIN tot USING (cid) GROUP BY cid, layer, n HAVING CAST(count(*) AS DOUBLE) / n >= 0.3),
    ty AS (SELECT DISTINCT cid, CASE WHEN CAST(split_part(cid, ':', 2) AS BIGINT) % 3 = 0 THEN 'spring' ELSE 'depression' END AS ft FROM ce),
    fr AS (SELECT cid, min(CASE layer WHEN 'road' THEN 1 WHEN 'water' THEN 2 WHEN 'rail' THEN 3 ELSE 4 END) AS o FROM sh JOIN ty USING (cid) WHERE NOT (layer = 'water' AND ft = 'spring') GROUP BY 1)"""


@register("j7_exclude_infrastructure", f"""{LAB}, {ctes('segments')}, {INFRA} SELECT cid AS cand_id, CASE o WHEN 1 THEN 'road' WHEN 2 THEN 'water' WHEN 3 THEN 'rail' WHEN 4 THEN 'landuse' END AS reject_layer
    FROM ty LEFT JOIN fr USING (cid)""")
def _j7(spark, sf):
    lab = comp.label(smooth(spark, sf).where("z > 600").select("survey_id", "row", "col"), BLOCK)
    cid = F.concat_ws(":", "survey_id", F.col("region_id").cast("string"))
    cells = lab.select(cid.alias("cand_id"), (F.col("col") + 0.5).alias("x"), (250 - F.col("row") - 0.5).alias("y"), "region_id")
    cands = cells.groupBy("cand_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.first("region_id").alias("r"))
    cands = cands.withColumn("feature_type", F.when(F.col("r") % 3 == 0, "spring").otherwise("depression"))
    seg = fixture(spark, sf, "segments")
    areas = seg.where("layer = 'landuse'").select(F.col("x1").alias("west"), F.col("y1").alias("south"), F.col("x2").alias("east"), F.col("y2").alias("north"))
    out = filters.infrastructure_verdict(cands, cells, seg, areas, {"road": 3.0, "water": 3.0, "rail": 4.0}, size=20.0)
    return out.select("cand_id", "reject_layer")


RIM = f"""{LAB}, {nine('smooth', 'nb2').replace('nb2 AS', 'nb2 AS')}, sl AS MATERIALIZED (SELECT survey_id, "row", col, degrees(atan(sqrt((nf-nd)/200*(nf-nd)/200+(nh-nb)/200*(nh-nb)/200))) AS slope FROM nb2 WHERE {FULL}),
    rg AS (SELECT survey_id, region_id, avg("row") + 0.5 AS cr, avg(col) + 0.5 AS cc, sqrt(count(*) / pi()) AS r FROM lab GROUP BY 1, 2),
    rc AS MATERIALIZED (SELECT * FROM (SELECT rg.survey_id, region_id, r, slope, sqrt(("row" + 0.5 - cr) * ("row" + 0.5 - cr) + (col + 0.5 - cc) * (col + 0.5 - cc)) AS d FROM rg JOIN sl ON sl.survey_id = rg.survey_id
      AND "row" BETWEEN cr - 2 * r - 1 AND cr + 2 * r + 1 AND col BETWEEN cc - 2 * r - 1 AND cc + 2 * r + 1) q WHERE d > r AND d <= 2 * r)"""


def rim_inputs(spark, sf):
    lab = comp.label(smooth(spark, sf).where("z > 600").select("survey_id", "row", "col"), BLOCK)
    cands = lab.groupBy("survey_id", "region_id").agg((F.avg("row") + 0.5).alias("centroid_row"), (F.avg("col") + 0.5).alias("centroid_col"), F.count("*").cast("double").alias("area_m2"))
    s = focal.slope_gradient(smooth(spark, sf).withColumn("z", F.col("z") / 100.0), block=BLOCK).withColumnRenamed("slope_gradient", "slope")
    return cands, s


@register("j13_rim_cells", f"{RIM} SELECT survey_id, region_id, count(*) AS n, {rd('avg(slope)', 5)} AS mean_deg, {rd('quantile_cont(slope, 0.9)', 5)} AS p90_deg FROM rc GROUP BY 1, 2")
def _j13(spark, sf):
    from fellscan.operators.joins import rim_cells

    cands, s = rim_inputs(spark, sf)
    ring = rim_cells(cands, s.where("slope IS NOT NULL"))
    keys = ["survey_id", "region_id"]
    out = ring.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("slope").alias("mean_deg")).join(exact_quantile(ring, keys, "slope", 0.9, "p90_deg"), keys)
    return out.withColumns({"mean_deg": rnd("mean_deg", 5), "p90_deg": rnd("p90_deg", 5)})


@register("f5_rim_filter", f"""{RIM}, bad AS (SELECT survey_id, region_id FROM rc GROUP BY 1, 2 HAVING count(*) >= 5 AND (avg(slope) > 72 OR quantile_cont(slope, 0.9) > 80))
    SELECT survey_id, region_id FROM rg WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.survey_id = rg.survey_id AND bad.region_id = rg.region_id)""")
def _f5(spark, sf):
    cands, s = rim_inputs(spark, sf)
    return filters.rim_filter(cands, s, max_mean=72, max_p90=80).select("survey_id", "region_id")


@register("f6_post_fuse_chain", f"""WITH {CAND}, {FOOT}, {BUILDING}, g AS (SELECT * FROM cand WHERE {GATE} IS NULL AND cand_id NOT IN
      (SELECT c.cand_id FROM cand c JOIN ok o ON c.lon > o.west AND c.lon < o.east AND c.lat > o.south AND c.lat < o.north)),
    k AS (SELECT cand_id, tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, cand_id) AS k FROM g) SELECT cand_id, tile_id FROM k WHERE k <= 200""")
def _f6(spark, sf):
    f = fixture(spark, sf, "footprints").select("id", "kind", *[F.col(c).cast("double").alias(c) for c in ("west", "south", "east", "north")])
    step = lambda d: filters.exclude_buildings(d, f.where("kind = 'building'"), f.where("kind = 'cemetery'"))
    return filters.post_fuse_chain(cand(spark, sf), [step], cap=200).select("cand_id", "tile_id")


@register("t2_cap_per_tile", f"""WITH {CAND} SELECT cand_id, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, cand_id) AS k FROM cand) q WHERE k <= 200""")
def _t2(spark, sf):
    return filters.cap_per_tile(cand(spark, sf)).select("cand_id", "tile_id")


# ---- shape families ------------------------------------------------------------------------------------------------

def rect_sql(src: str = "lab") -> str:
    """Minimum rotated rectangle per region over every direction between two of its line-end corners."""
    return f"""le AS (SELECT survey_id, region_id, "row" AS r, min(col) AS a, max(col) + 1 AS b FROM {src} GROUP BY 1, 2, 3),
    co AS MATERIALIZED (SELECT DISTINCT survey_id, region_id, x, y FROM (SELECT survey_id, region_id, a AS x, r AS y FROM le UNION ALL SELECT survey_id, region_id, b, r FROM le
      UNION ALL SELECT survey_id, region_id, a, r + 1 FROM le UNION ALL SELECT survey_id, region_id, b, r + 1 FROM le) q),
    di AS MATERIALIZED (SELECT DISTINCT p.survey_id, p.region_id, (q.x - p.x) // gcd(abs(q.x - p.x), abs(q.y - p.y)) AS ux, (q.y - p.y) // gcd(abs(q.x - p.x), abs(q.y - p.y)) AS uy
      FROM co p JOIN co q ON p.survey_id = q.survey_id AND p.region_id = q.region_id AND (q.x > p.x OR (q.x = p.x AND q.y > p.y))),
    ex AS (SELECT d.survey_id, d.region_id, (max(x * ux + y * uy) - min(x * ux + y * uy)) / sqrt(ux * ux + uy * uy) AS l, (max(y * ux - x * uy) - min(y * ux - x * uy)) / sqrt(ux * ux + uy * uy) AS w
      FROM di d JOIN co USING (survey_id, region_id) GROUP BY d.survey_id, d.region_id, ux, uy),
    rc AS MATERIALIZED (SELECT survey_id, region_id, round(greatest(l, w), 9) AS length_m, round(least(l, w), 9) AS width_m FROM (SELECT *, row_number() OVER (PARTITION BY survey_id, region_id
      ORDER BY round(l * w, 6), round(greatest(l, w), 6)) AS k FROM ex) q WHERE k = 1),
    tp AS MATERIALIZED (SELECT l.survey_id, l.region_id, count(*) AS n, 4 * count(*) - 2 * count(e.col) - 2 * count(s.col) AS outline_m,
      1 - (count(*) - count(e.col) - count(s.col) + count(CASE WHEN e.col IS NOT NULL AND s.col IS NOT NULL AND x.col IS NOT NULL THEN 1 END)) AS holes FROM {src} l
      LEFT JOIN {src} e ON e.survey_id = l.survey_id AND e.region_id = l.region_id AND e."row" = l."row" AND e.col = l.col + 1
      LEFT JOIN {src} s ON s.survey_id = l.survey_id AND s.region_id = l.region_id AND s."row" = l."row" + 1 AND s.col = l.col
      LEFT JOIN {src} x ON x.survey_id = l.survey_id AND x.region_id = l.region_id AND x."row" = l."row" + 1 AND x.col = l.col + 1 GROUP BY 1, 2)"""


@register("c6_shape_metrics", f"""{LAB}, {rect_sql()} SELECT survey_id, region_id, CAST(n AS DOUBLE) AS area_m2, {rd('length_m')} AS length_m, {rd('width_m')} AS width_m,
    {rd('length_m / greatest(width_m, 1e-9)')} AS aspect_ratio, {rd('n / (length_m * width_m)')} AS rectangularity, {rd('least(4 * pi() * n / (outline_m * outline_m), 1.0)')} AS circularity, holes
    FROM tp JOIN rc USING (survey_id, region_id)""")
def _c6(spark, sf):
    out = regions.shape_metrics(comp.label(smooth(spark, sf).where("z > 600"), BLOCK), block=BLOCK)
    return out.select("survey_id", "region_id", "area_m2", *[rnd(c).alias(c) for c in ("length_m", "width_m", "aspect_ratio", "rectangularity", "circularity")], "holes")


def relief_sql(radius: int, name: str, scale: int, src: str = "smooth") -> str:
    n = (2 * radius + 1) ** 2
    return f"""{name}_h AS MATERIALIZED (SELECT survey_id, "row", col, z, sum(z) OVER w AS s, count(*) OVER w AS c FROM {src}
      WINDOW w AS (PARTITION BY survey_id, "row" ORDER BY col RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
    {name} AS MATERIALIZED (SELECT survey_id, "row", col, (z - CAST(s2 AS DOUBLE) / {n}) / {scale} AS v FROM (SELECT *, sum(s) OVER w AS s2, sum(c) OVER w AS c2 FROM {name}_h
      WINDOW w AS (PARTITION BY survey_id, col ORDER BY "row" RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)) q WHERE c2 = {n})"""


def supported_sql(src: str, threshold: float, sign: int, tag: str) -> str:
    """Interior cells beyond the threshold, labelled, minus regions beside non-interior ground."""
    return f"""in_{tag} AS MATERIALIZED (SELECT a.survey_id, a."row", a.col, a.v FROM {src} a JOIN {src} b ON a.survey_id = b.survey_id AND ((a."row" = b."row" AND abs(a.col - b.col) = 1)
      OR (a.col = b.col AND abs(a."row" - b."row") = 1)) GROUP BY 1, 2, 3, 4 HAVING count(*) = 4),
    m_{tag} AS MATERIALIZED (SELECT * FROM in_{tag} WHERE v * {sign} >= {threshold}), {components(f'm_{tag}', f'l_{tag}')},
    ok_{tag} AS (SELECT a.survey_id, a."row", a.col FROM in_{tag} a JOIN in_{tag} b ON a.survey_id = b.survey_id AND ((a."row" = b."row" AND abs(a.col - b.col) = 1)
      OR (a.col = b.col AND abs(a."row" - b."row") = 1)) GROUP BY 1, 2, 3 HAVING count(*) = 4),
    bad_{tag} AS (SELECT DISTINCT l.survey_id, l.region_id FROM l_{tag} l WHERE NOT EXISTS (SELECT 1 FROM ok_{tag} o WHERE o.survey_id = l.survey_id AND o."row" = l."row" AND o.col = l.col)),
    s_{tag} AS MATERIALIZED (SELECT * FROM l_{tag} l WHERE NOT EXISTS (SELECT 1 FROM bad_{tag} b WHERE b.survey_id = l.survey_id AND b.region_id = l.region_id))"""


REC_SMOOTH = f"WITH RECURSIVE {SMOOTH}"


def family_surface(spark, sf):
    s = smooth(spark, sf)
    out = focal.discovery_surface(s.withColumn("z", F.col("z")), block=BLOCK)
    # whole centimetres: relief and slope are scaled alike, so the integer box sums stay exact
    return out.withColumns({"relief_10": F.col("relief_10") / 1000, "relief_25": F.col("relief_25") / 1000})


@register("r20_discovery_surface", f"""{REC_SMOOTH.replace('RECURSIVE ', '')}, {relief_sql(10, 'r10', 1000)}, {relief_sql(25, 'r25', 1000)}, {nine('smooth')}
    SELECT s.survey_id, s."row", s.col, {rd('r10.v')} AS relief_10, {rd('r25.v')} AS relief_25, CASE WHEN {FULL} THEN {rd('degrees(atan(sqrt((nf-nd)/2*(nf-nd)/2+(nh-nb)/2*(nh-nb)/2)))')} END AS slope
    FROM nb s LEFT JOIN r10 USING (survey_id, "row", col) LEFT JOIN r25 USING (survey_id, "row", col)""")
def _r20(spark, sf):
    return family_surface(spark, sf).select("survey_id", "row", "col", *[rnd(c).alias(c) for c in ("relief_10", "relief_25", "slope")])


@register("r22_supported_mask", f"""{REC_SMOOTH}, {relief_sql(10, 'r10', 1000)}, {supported_sql('r10', 0.5, 1, 'a')} SELECT survey_id, "row", col, region_id FROM s_a""")
def _r22(spark, sf):
    return regions.supported_mask(family_surface(spark, sf), "relief_10", 0.5, 1, BLOCK).select("survey_id", "row", "col", "region_id")


def chosen_sql(tag: str, lo: float, hi: float) -> str:
    """Regions inside the area window, clear of the survey edge, with rectangles and topology."""
    return f"""z_{tag} AS (SELECT survey_id, region_id, count(*) AS n, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM s_{tag} GROUP BY 1, 2 HAVING count(*) BETWEEN {lo} AND {hi}),
    y_{tag} AS (SELECT q.survey_id, region_id FROM (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY n DESC, region_id) AS k FROM z_{tag}) q
      JOIN (SELECT survey_id, min("row") AS a, max("row") AS b, min(col) AS c, max(col) AS d FROM smooth GROUP BY 1) e ON e.survey_id = q.survey_id WHERE r0 > a AND r1 < b AND c0 > c AND c1 < d),
    lab AS MATERIALIZED (SELECT s.* FROM s_{tag} s JOIN y_{tag} y ON y.survey_id = s.survey_id AND y.region_id = s.region_id), {rect_sql('lab')}"""


@register("d9_raised_features", f"""{REC_SMOOTH}, {relief_sql(10, 'r10', 1000)}, {supported_sql('r10', 0.5, 1, 'a')}, {chosen_sql('a', 6, 10000)}, {PERIM}, {nine('smooth')},
    sl AS MATERIALIZED (SELECT survey_id, "row", col, degrees(atan(sqrt((nf-nd)/2*(nf-nd)/2+(nh-nb)/2*(nh-nb)/2))) AS slope FROM nb WHERE {FULL}),
    st AS (SELECT survey_id, region_id, max(v) AS h, coalesce(avg(CASE WHEN n4 = 4 THEN CASE WHEN slope <= 89 THEN 1.0 ELSE 0.0 END END), avg(CASE WHEN slope <= 89 THEN 1.0 ELSE 0.0 END)) AS flat
      FROM fl JOIN sl USING (survey_id, "row", col) GROUP BY 1, 2)
    SELECT survey_id, region_id, {rd('0.4 + 0.4 * (1 - exp(-h / 1.5))')} AS score, CASE WHEN flat >= 0.65 AND n / (length_m * width_m) >= 0.65 THEN 'platform' ELSE 'mound' END AS feature_type,
      CAST(n AS DOUBLE) AS area_m2, {rd('length_m')} AS length_m, {rd('h')} AS height_residual_m, {rd('flat')} AS summit_flat_fraction
    FROM tp JOIN rc USING (survey_id, region_id) JOIN st USING (survey_id, region_id) WHERE holes = 0 AND length_m / greatest(width_m, 1e-9) <= 3""")
def _d9(spark, sf):
    f = get_pass("raised_features")(family_surface(spark, sf), min_area_m2=6, flat_slope_deg=89, block=BLOCK)
    m = F.col("morphometrics")
    return f.candidates.select("survey_id", "region_id", rnd("score").alias("score"), "feature_type", rnd("area_m2").alias("area_m2"),
                               *[rnd(m[k]).alias(k) for k in ("length_m", "height_residual_m", "summit_flat_fraction")])


def linear_sql(sign: int, tag: str, kind: str) -> str:
    return f"""{REC_SMOOTH}, {relief_sql(10, 'r10', 1000)}, {supported_sql('r10', 0.4, sign, tag)}, {chosen_sql(tag, 6, 20000)},
    md AS (SELECT survey_id, region_id, quantile_cont(v, 0.5) AS sg FROM lab GROUP BY 1, 2)
    SELECT survey_id, region_id, {rd('0.4 + 0.4 * (1 - exp(-abs(sg) / 1.2))')} AS score, '{kind}' AS feature_type, CAST(n AS DOUBLE) AS area_m2, {rd('sg')} AS signed_relief_m
    FROM tp JOIN rc USING (survey_id, region_id) JOIN md USING (survey_id, region_id) WHERE holes = 0 AND length_m >= 5 AND width_m <= 15 AND length_m / greatest(width_m, 1e-9) >= 2"""


@register("d10_linear_features", f"SELECT * FROM ({linear_sql(1, 'a', 'linear_bank')}) UNION ALL SELECT * FROM ({linear_sql(-1, 'b', 'linear_ditch')})")
def _d10(spark, sf):
    f = get_pass("linear_features")(family_surface(spark, sf), min_area_m2=6, min_length_m=5, min_aspect_ratio=2, block=BLOCK)
    return f.candidates.select("survey_id", "region_id", rnd("score").alias("score"), "feature_type", rnd("area_m2").alias("area_m2"),
                               rnd(F.col("morphometrics")["signed_relief_m"]).alias("signed_relief_m"))


def holes_sql(lab: str, tag: str) -> str:
    """Cells cut off from the corner of each region's grown bounding box, moving in eight directions outside the region."""
    return f"""bb_{tag} AS (SELECT survey_id, region_id, min("row") - 1 AS r0, max("row") + 1 AS r1, min(col) - 1 AS c0, max(col) + 1 AS c1 FROM {lab} GROUP BY 1, 2),
    fr_{tag} AS MATERIALIZED (SELECT b.survey_id, b.region_id, r, c FROM bb_{tag} b, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS r), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c)
      WHERE NOT EXISTS (SELECT 1 FROM {lab} l WHERE l.survey_id = b.survey_id AND l.region_id = b.region_id AND l."row" = r AND l.col = c)),
    rc_{tag}(survey_id, region_id, r, c) AS (SELECT survey_id, region_id, r0, c0 FROM bb_{tag} UNION SELECT f.survey_id, f.region_id, f.r, f.c
      FROM rc_{tag} p, (SELECT unnest([-1, 0, 1]) AS i) o, (SELECT unnest([-1, 0, 1]) AS j) q JOIN fr_{tag} f ON f.survey_id = p.survey_id AND f.region_id = p.region_id AND f.r = p.r + o.i AND f.c = p.c + q.j),
    ho_{tag} AS MATERIALIZED (SELECT f.* FROM fr_{tag} f WHERE NOT EXISTS (SELECT 1 FROM rc_{tag} p WHERE p.survey_id = f.survey_id AND p.region_id = f.region_id AND p.r = f.r AND p.c = f.c))"""


@register("c7_interiors", f"""{LAB.replace('z > 600', 'z > 200')}, sz AS (SELECT survey_id, region_id FROM lab GROUP BY 1, 2 HAVING count(*) >= 8),
    la AS MATERIALIZED (SELECT lab.* FROM lab JOIN sz USING (survey_id, region_id)), {holes_sql('la', 'h')} SELECT survey_id, region_id, count(*) AS hole_cells FROM ho_h GROUP BY 1, 2""")
def _c7(spark, sf):
    lab = comp.drop_small(comp.label(smooth(spark, sf).where("z > 200").select("survey_id", "row", "col"), BLOCK), 8)
    return regions.interiors(lab).groupBy("survey_id", "region_id").agg(F.count("*").alias("hole_cells"))


def enclosure_sql(sign: int, tag: str) -> str:
    return f"""{REC_SMOOTH}, {relief_sql(10, 'r10', 1000)}, {supported_sql('r10', 0.1, sign, tag)}, {chosen_sql(tag, 20, 20000)}, {holes_sql('lab', 'h')},
    ok AS (SELECT h.survey_id, h.region_id, count(*) AS hc, count(k.v) AS kc FROM ho_h h LEFT JOIN r10 k ON k.survey_id = h.survey_id AND k."row" = h.r AND k.col = h.c GROUP BY 1, 2 HAVING count(*) = count(k.v))
    SELECT survey_id, region_id, {rd('0.4 + 0.4 * least(hc / 4.0, 1.0)')} AS score, 'enclosure' AS feature_type, CAST(n + hc AS DOUBLE) AS area_m2 FROM ok JOIN tp USING (survey_id, region_id)"""


@register("d11_enclosures", f"SELECT * FROM ({enclosure_sql(1, 'a')}) UNION ALL SELECT * FROM ({enclosure_sql(-1, 'b')})")
def _d11(spark, sf):
    f = get_pass("enclosures")(family_surface(spark, sf), threshold_m=0.1, min_interior_m2=1, block=BLOCK)
    return f.candidates.select("survey_id", "region_id", rnd("score").alias("score"), "feature_type", rnd("area_m2").alias("area_m2"))


def coarse_surface(spark, sf):
    """The same relief read as 2.5 m cells, so both radii fit between the survey's edges."""
    out = focal.discovery_surface(smooth(spark, sf), 2.5, 2.5, BLOCK)
    return out.withColumns({"relief_10": F.col("relief_10") / 1000, "relief_25": F.col("relief_25") / 1000})


@register("d12_repeated_patterns")
def _d12(spark, sf):
    f = get_pass("repeated_patterns")(coarse_surface(spark, sf), threshold_m=0.9, max_spacing_m=40, max_spacing_cv=0.5, dx=2.5, dy=2.5, block=BLOCK)
    return f.candidates.select("survey_id", "region_id", rnd("score").alias("score"), "feature_type", rnd("area_m2").alias("area_m2"))


def form_sql(sign: int, tag: str, kind: str) -> str:
    return f"""{REC_SMOOTH}, {relief_sql(10, 'r25', 1000)}, {supported_sql('r25', 0.5, sign, tag)}, {chosen_sql(tag, 8, 8000)}, md AS (SELECT survey_id, region_id, quantile_cont(v, 0.5) AS sg FROM lab GROUP BY 1, 2)
    SELECT survey_id, region_id, {rd('0.4 + 0.4 * (1 - exp(-abs(sg) / 1.5))')} AS score, '{kind}' AS feature_type, n * 6.25 AS area_m2 FROM tp JOIN rc USING (survey_id, region_id) JOIN md USING (survey_id, region_id)
    WHERE holes = 0 AND length_m / greatest(width_m, 1e-9) >= 3"""


SCARP = f"""{REC_SMOOTH}, {relief_sql(10, 'r25', 1000)}, {nine('smooth')}, sp AS MATERIALIZED (SELECT nb.survey_id, nb."row", nb.col, CASE WHEN {FULL} THEN degrees(atan(sqrt((nf-nd)/5*(nf-nd)/5+(nh-nb.nb)/5*(nh-nb.nb)/5))) END AS v FROM nb JOIN r25 USING (survey_id, "row", col)),
    sq AS MATERIALIZED (SELECT * FROM sp WHERE v IS NOT NULL), {supported_sql('sq', 89.6, 1, 'c')}, {chosen_sql('c', 8, 8000)}, md AS (SELECT survey_id, region_id, avg(v) AS sg FROM lab GROUP BY 1, 2)
    SELECT survey_id, -region_id - 1 AS region_id, {rd('0.4 + 0.4 * least(sg / 90, 1.0)')} AS score, 'scarp' AS feature_type, n * 6.25 AS area_m2 FROM tp JOIN md USING (survey_id, region_id)
    WHERE outline_m * 2.5 / 2 >= 20 AND 2 * n * 6.25 / (outline_m * 2.5) <= 15"""


@register("d13_geological_forms", f"SELECT * FROM ({form_sql(1, 'a', 'ridge')}) UNION ALL SELECT * FROM ({form_sql(-1, 'b', 'hollow')}) UNION ALL SELECT * FROM ({SCARP})")
def _d13(spark, sf):
    f = get_pass("geological_forms")(coarse_surface(spark, sf), threshold_m=0.5, min_area_m2=50, min_scarp_slope_deg=89.6, dx=2.5, dy=2.5, block=BLOCK)
    return f.candidates.select("survey_id", "region_id", rnd("score").alias("score"), "feature_type", rnd("area_m2").alias("area_m2"))


SPACING = f"""WITH RECURSIVE {SMOOTH}, m AS MATERIALIZED (SELECT survey_id, "row", col, z FROM smooth WHERE z > 900), {components('m')},
    rg AS MATERIALIZED (SELECT survey_id, region_id, avg(col) AS x, avg("row") AS y, CAST(count(*) AS DOUBLE) AS area_m2 FROM lab GROUP BY 1, 2),
    pr AS MATERIALIZED (SELECT a.survey_id, a.region_id AS u, b.region_id AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM rg a JOIN rg b ON a.survey_id = b.survey_id
      AND a.region_id <> b.region_id AND abs(a.x - b.x) <= 7 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 7)"""


@register("t10_nn_distance", f"{SPACING} SELECT survey_id, u AS region_id, {rd('min(d)')} AS nn_m FROM pr GROUP BY 1, 2")
def _t10(spark, sf):
    from fellscan.operators.joins import nn_distance

    rg = comp.label(smooth(spark, sf).where("z > 900"), BLOCK).groupBy("survey_id", "region_id").agg(F.avg("col").alias("x"), F.avg("row").alias("y"))
    return nn_distance(rg, ["survey_id"], 7.0, "region_id").withColumn("nn_m", rnd("nn_m"))


@register("c9_spacing_groups", f"""{SPACING}, gr(survey_id, u, root) USING KEY (survey_id, u) AS (SELECT survey_id, region_id, region_id FROM rg UNION
      SELECT pr.survey_id, pr.v, min(gr.root) FROM gr JOIN pr ON pr.survey_id = gr.survey_id AND pr.u = gr.u JOIN recurring.gr old ON old.survey_id = pr.survey_id AND old.u = pr.v
      WHERE gr.root < old.root GROUP BY 1, 2),
    nn AS (SELECT survey_id, u, min(d) AS nn FROM pr GROUP BY 1, 2)
    SELECT gr.survey_id, gr.root AS group_id, count(*) AS member_count, {rd('avg(nn)')} AS mean_spacing_m, {rd('stddev_pop(nn) / avg(nn)')} AS spacing_cv FROM gr
      JOIN nn ON nn.survey_id = gr.survey_id AND nn.u = gr.u JOIN rg ON rg.survey_id = gr.survey_id AND rg.region_id = gr.u GROUP BY 1, 2
    HAVING count(*) >= 3 AND stddev_pop(nn) / avg(nn) <= 0.4 AND max(area_m2) / min(area_m2) <= 2""")
def _c9(spark, sf):
    rg = comp.label(smooth(spark, sf).where("z > 900"), BLOCK).groupBy("survey_id", "region_id").agg(
        F.avg("col").alias("x"), F.avg("row").alias("y"), F.count("*").cast("double").alias("area_m2"))
    out = discovery.spacing_groups(rg, 7.0, 3, 0.4)
    return out.select("survey_id", "group_id", "member_count", rnd("mean_spacing_m").alias("mean_spacing_m"), rnd("spacing_cv").alias("spacing_cv"))



"""Neighbourhood derivatives, components and region measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fellscan.operators import components as comp
from fellscan.operators import fill, focal, horizon, regions
from fellscan.registered.base import rd, register, rnd
from fellscan.registered.fixtures import components, ctes, fixture, nine

BLOCK = 128
KEY = 'survey_id, "row", col'
FULL = " AND ".join(f"n{k} IS NOT NULL" for k in "abcdefghi")
DEM = ctes("dem")
SMOOTH = ctes("dem", "smooth")


def dem(spark, sf):
    return fixture(spark, sf, "dem")


def smooth(spark, sf):
    return fixture(spark, sf, "smooth")


def keyed(df, *cols):
    return df.select("survey_id", "row", "col", *cols)


def focal_sql(expr: str, name: str, src: str = "dem") -> str:
    return f"WITH {DEM if src == 'dem' else SMOOTH}, {nine(src)} SELECT {KEY}, CASE WHEN {FULL} THEN {rd(expr)} END AS {name} FROM nb"


P, Q = "((nc+2*nf+ni)-(na+2*nd+ng))/8", "((ng+2*nh+ni)-(na+2*nb+nc))/8"
GX, GY = "(nf-nd)/2", "(nh-nb)/2"


def lambert(gx: str, gy: str, az: float, alt: float) -> str:
    a, e = math.radians(az), math.radians(alt)
    inner = f"(-({gx})*{math.sin(a) * math.cos(e)!r} + ({gy})*{math.cos(a) * math.cos(e)!r} + {math.sin(e)!r})/sqrt(1+({gx})*({gx})+({gy})*({gy}))"
    return f"least(greatest({inner}, 0.0), 1.0)"


def slope_sql(gx: str, gy: str) -> str:
    return f"degrees(atan(sqrt(({gx})*({gx})+({gy})*({gy}))))"


MDOW = "+".join(
    f"{w}*least(greatest(({math.cos(math.radians(45))!r}*s*cos({math.radians(a)!r}-asp)+{math.sin(math.radians(45))!r})/(1+s),0.0),1.0)" for a, w in focal.MDOW_LIGHTS
)
RELIEF = "least(greatest(0.30+0.84*(" + "+".join(f"{w}*{lambert('gx', 'gy', a, 40)}" for a, w in focal.RELIEF_LIGHTS) + "),0.0),1.0)"
TERMS = """SELECT *, (nd+nf)/2-ne AS td, (nb+nh)/2-ne AS te, (-na+nc+ng-ni)/4 AS tf, (-nd+nf)/2 AS tg, (nb-nh)/2 AS th FROM nb"""
PROFILE = "CASE WHEN tg*tg+th*th=0 THEN 0.0 ELSE -2*(td*tg*tg+te*th*th+tf*tg*th)/(tg*tg+th*th) END"
PLAN = "CASE WHEN tg*tg+th*th=0 THEN 0.0 ELSE 2*(td*th*th+te*tg*tg-tf*tg*th)/(tg*tg+th*th) END"

NAMES = ", ".join(f"n{k}" for k in "abcdefghi")
SIMPLE = {
    "r01_hillshade_horn": ("hillshade", lambert(P, Q, 315, 45), lambda s: focal.hillshade_horn(s, block=BLOCK)),
    "r02_slope_horn": ("slope", slope_sql(P, Q), lambda s: focal.slope_horn(s, block=BLOCK)),
    "r03_tpi": ("tpi", "ne-(na+nb+nc+nd+nf+ng+nh+ni)/8", lambda s: focal.tpi(s, BLOCK)),
    "r04_roughness": ("roughness", f"greatest({NAMES})-least({NAMES})", lambda s: focal.roughness(s, BLOCK)),
    "r08_slope_gradient": ("slope_gradient", slope_sql(GX, GY), lambda s: focal.slope_gradient(s, block=BLOCK)),
    "r09_hillshade_gradient": ("hillshade_gradient", lambert(GX, GY, 225, 45), lambda s: focal.hillshade_gradient(s, 225, block=BLOCK)),
}


def _simple(name, out, expr, fn):
    register(name, focal_sql(expr, out))(lambda spark, sf: keyed(fn(dem(spark, sf)), rnd(out).alias(out)))


for _name, (_out, _expr, _fn) in SIMPLE.items():
    _simple(_name, _out, _expr, _fn)


def _curve(name, out, expr, fn):
    sql = f"WITH {DEM}, {nine('dem')}, t AS ({TERMS}) SELECT {KEY}, CASE WHEN {FULL} THEN {rd(expr)} END AS {out} FROM t"
    register(name, sql)(lambda spark, sf: keyed(fn(dem(spark, sf), block=BLOCK), rnd(out).alias(out)))


_curve("r06_profile_curvature", "profile_curvature", PROFILE, focal.profile_curvature)
_curve("r07_plan_curvature", "plan_curvature", PLAN, focal.plan_curvature)


@register("r05_lrm", f"""WITH {ctes('dem', 'holes')} SELECT a.survey_id, a."row", a.col, {rd('a.z - CAST(sum(b.z) AS DOUBLE) / count(*)')} AS lrm_7
    FROM holes a JOIN holes b ON a.survey_id = b.survey_id AND b."row" BETWEEN a."row" - 3 AND a."row" + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3
    GROUP BY a.survey_id, a."row", a.col, a.z""")
def _lrm(spark, sf):
    return keyed(focal.lrm(fixture(spark, sf, "holes"), 7, block=BLOCK), rnd("lrm_7").alias("lrm_7"))


@register("r12_local_relief", f"""WITH {ctes('dem', 'holes')} SELECT a.survey_id, a."row", a.col,
    CASE WHEN count(*) = 25 THEN {rd('a.z - CAST(sum(b.z) AS DOUBLE) / 25')} END AS local_relief
    FROM holes a JOIN holes b ON a.survey_id = b.survey_id AND b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2
    GROUP BY a.survey_id, a."row", a.col, a.z""")
def _relief(spark, sf):
    return keyed(focal.local_relief(fixture(spark, sf, "holes"), 2, block=BLOCK), rnd("local_relief").alias("local_relief"))


@register("r15_mdow", f"""WITH {DEM}, {nine('dem')}, g AS (SELECT *, sqrt(({GX})*({GX})+({GY})*({GY})) AS s, atan2(-({GY}), {GX}) AS asp FROM nb)
    SELECT {KEY}, CASE WHEN {FULL} THEN {rd(MDOW)} END AS mdow FROM g""")
def _mdow(spark, sf):
    return keyed(focal.mdow_hillshade(dem(spark, sf), block=BLOCK), rnd("mdow").alias("mdow"))


@register("r16_shaded_relief", f"""WITH {DEM}, {nine('dem')}, g AS (SELECT *, {GX} AS gx, {GY} AS gy FROM nb)
    SELECT {KEY}, CASE WHEN {FULL} THEN {rd(RELIEF)} END AS intensity FROM g""")
def _shaded(spark, sf):
    return keyed(focal.shaded_relief(dem(spark, sf), block=BLOCK), rnd("intensity").alias("intensity"))


def offsets_sql(radius: float) -> str:
    rows = [f"({i},{r},{c},{float(d)!r})" for i, r, c, d in horizon.ray_table(1.0, 1.0, radius).itertuples(index=False)]
    return f"off(ray, dr, dc, dist) AS (VALUES {','.join(rows)})"


def horizon_sql(radius: int, select: str, extra: str = "") -> str:
    """Rays by joining every cell to its offsets; support by counting the box."""
    rx, ry = horizon.reach_of(horizon.ray_table(1.0, 1.0, radius))
    return f"""WITH {DEM}, d AS MATERIALIZED (SELECT survey_id, "row", col, z / 50.0 AS z FROM dem), {offsets_sql(radius)},
    full_box AS (SELECT a.survey_id, a."row", a.col FROM d a JOIN d b ON a.survey_id = b.survey_id AND b."row" BETWEEN a."row" - {ry} AND a."row" + {ry}
      AND b.col BETWEEN a.col - {rx} AND a.col + {rx} GROUP BY 1, 2, 3 HAVING count(*) = {(2 * rx + 1) * (2 * ry + 1)}),
    ray AS (SELECT a.survey_id, a."row", a.col, o.ray, max((b.z - a.z) / o.dist) AS up, min((b.z - a.z) / o.dist) AS down
      FROM d a CROSS JOIN off o JOIN d b ON b.survey_id = a.survey_id AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc GROUP BY 1, 2, 3, 4),
    views AS (SELECT survey_id, "row", col, sum(1 - sin(greatest(atan(up), 0.0))) / 16 AS svf, 90 - degrees(sum(atan(up)) / 16) AS op,
      90 - degrees(sum(atan(-down)) / 16) AS onx FROM ray JOIN full_box USING (survey_id, "row", col) GROUP BY 1, 2, 3){extra}
    {select}"""


@register("r13_horizon", horizon_sql(3, f"""SELECT d.survey_id, d."row", d.col, {rd('svf')} AS svf, {rd('op')} AS openness_positive, {rd('onx')} AS openness_negative
    FROM d LEFT JOIN views v ON v.survey_id = d.survey_id AND v."row" = d."row" AND v.col = d.col"""))
def _horizon(spark, sf):
    s = dem(spark, sf).withColumn("z", F.col("z") / 50.0)
    out = horizon.horizon(s, 3, block=BLOCK)
    return keyed(out, *[rnd(p).alias(p) for p in horizon.PRODUCTS])


@register("r14_vat", horizon_sql(3, f"""SELECT d.survey_id, d."row", d.col, {rd('b2 * (0.75 + 0.25 * v)')} AS vat FROM d
      LEFT JOIN w2 w ON w.survey_id = d.survey_id AND w."row" = d."row" AND w.col = d.col""", f""",
    {nine('d')}, w0 AS (SELECT nb.survey_id, nb."row", nb.col, 1 - least(greatest({slope_sql(GX, GY)} / 50, 0.0), 1.0) AS s, {lambert(GX, GY, 315, 35)} AS h,
      least(greatest((op - 68) / 25, 0.0), 1.0) AS o, least(greatest((svf - 0.7) / 0.3, 0.0), 1.0) AS v
      FROM nb JOIN views USING (survey_id, "row", col)),
    w1 AS (SELECT *, 0.5 * h + 0.5 * s AS b FROM w0),
    w2 AS (SELECT *, 0.5 * b + 0.5 * (CASE WHEN b <= 0.5 THEN 2 * b * o ELSE 1 - 2 * (1 - b) * (1 - o) END) AS b2 FROM w1)"""))
def _vat(spark, sf):
    s = dem(spark, sf).withColumn("z", F.col("z") / 50.0)
    return keyed(horizon.vat(s, 3, block=BLOCK), rnd("vat").alias("vat"))


FILL = """start AS (SELECT survey_id, "row", col, z, (na IS NULL OR nb IS NULL OR nc IS NULL OR nd IS NULL OR nf IS NULL OR ng IS NULL OR nh IS NULL OR ni IS NULL) AS rim FROM nb),
    step AS MATERIALIZED (SELECT a.survey_id, a."row" AS r, a.col AS c, b."row" AS r2, b.col AS c2, b.z AS z2 FROM dem a JOIN dem b ON a.survey_id = b.survey_id
      AND b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND NOT (a."row" = b."row" AND a.col = b.col)),
    w(survey_id, r, c, lvl) USING KEY (survey_id, r, c) AS (SELECT survey_id, "row", col, CASE WHEN rim THEN z ELSE 1000000 END FROM start
      UNION SELECT s.survey_id, s.r2, s.c2, min(greatest(w.lvl, s.z2)) FROM w JOIN step s ON s.survey_id = w.survey_id AND s.r = w.r AND s.c = w.c
        JOIN recurring.w old ON old.survey_id = s.survey_id AND old.r = s.r2 AND old.c = s.c2 WHERE greatest(w.lvl, s.z2) < old.lvl GROUP BY 1, 2, 3)"""


@register("r10_fill_depressions", f"""WITH RECURSIVE {DEM}, {nine('dem')}, {FILL} SELECT d.survey_id, d."row", d.col, CAST(w.lvl AS DOUBLE) AS filled FROM dem d
    JOIN w ON w.survey_id = d.survey_id AND w.r = d."row" AND w.c = d.col""")
def _fill(spark, sf):
    return keyed(fill.fill_depressions(dem(spark, sf), 32), "filled")


@register("r11_fill_difference", f"""WITH RECURSIVE {DEM}, {nine('dem')}, {FILL} SELECT d.survey_id, d."row", d.col, CAST(w.lvl - d.z AS DOUBLE) AS fill_diff FROM dem d
    JOIN w ON w.survey_id = d.survey_id AND w.r = d."row" AND w.c = d.col""")
def _filldiff(spark, sf):
    return keyed(fill.fill_difference(dem(spark, sf), BLOCK), "fill_diff")


MASK = 'm AS MATERIALIZED (SELECT survey_id, "row", col, z FROM smooth WHERE z > 600)'


def labelled(spark, sf, cut=600):
    return comp.label(smooth(spark, sf).where(F.col("z") > cut), BLOCK)


@register("c1_components", f"WITH RECURSIVE {SMOOTH}, {MASK}, {components('m')} SELECT {KEY}, region_id FROM lab")
def _components(spark, sf):
    return keyed(comp.label(smooth(spark, sf).where("z > 600"), 32), "region_id")


LAB = f"WITH RECURSIVE {SMOOTH}, {MASK}, {components('m')}"


@register("c2_drop_small", f"""{LAB} SELECT survey_id, "row", col, region_id, cells FROM (SELECT *, count(*) OVER (PARTITION BY survey_id, region_id) AS cells FROM lab) q
    WHERE cells >= 8""")
def _small(spark, sf):
    return comp.drop_small(labelled(spark, sf), 8).select("survey_id", "row", "col", "region_id", "cells")


@register("g2_region_stats", f"""{LAB} SELECT survey_id, region_id, count(*) AS cells, min(z) AS min_v, max(z) AS max_v, CAST(sum(z) AS BIGINT) AS sum_v,
    {rd('avg(z)')} AS mean_v, {rd('avg("row") + 0.5')} AS centroid_row, {rd('avg(col) + 0.5')} AS centroid_col FROM lab GROUP BY 1, 2""")
def _stats(spark, sf):
    out = regions.region_stats(labelled(spark, sf))
    return out.withColumns({c: rnd(c) for c in ("mean_v", "centroid_row", "centroid_col")})


PERIM = """fl AS MATERIALIZED (SELECT l.*, (SELECT count(*) FROM lab k WHERE k.survey_id = l.survey_id AND ((k."row" = l."row" AND abs(k.col - l.col) = 1)
    OR (k.col = l.col AND abs(k."row" - l."row") = 1))) AS n4 FROM lab l)"""


@register("g3_batch_morphometrics", f"""{LAB}, {PERIM}, g AS (SELECT survey_id, region_id, count(*) AS n, min(z) AS lo, max(z) AS hi, sum(z) AS s,
      sum(CASE WHEN n4 < 4 THEN 1 ELSE 0 END) AS p, max("row") - min("row") + 1 AS h, max(col) - min(col) + 1 AS w FROM fl GROUP BY 1, 2)
    SELECT survey_id, region_id, n AS cells, CAST(n AS DOUBLE) AS area_m2, CAST(hi - lo AS DOUBLE) AS depth_m, CAST(greatest(hi * n - s, 0) AS DOUBLE) AS volume_m3,
      CAST(p AS DOUBLE) AS perimeter_m, {rd('4 * pi() * n / (p * p)')} AS circularity,
      CASE WHEN hi * n - s > 0 THEN {rd('CAST(n * (hi - lo) AS DOUBLE) / (hi * n - s)')} ELSE 0.0 END AS k_value,
      {rd('CAST(least(h, w) AS DOUBLE) / greatest(h, w)')} AS elongation_bbox FROM g""")
def _morph(spark, sf):
    lab = labelled(spark, sf)
    out = regions.batch_morphometrics(lab.select("survey_id", "row", "col", "region_id"), smooth(spark, sf), block=BLOCK)
    return out.select("survey_id", "region_id", "cells", "area_m2", "depth_m", "volume_m3", "perimeter_m", *[rnd(c).alias(c) for c in ("circularity", "k_value", "elongation_bbox")])


PCA = """pm AS (SELECT survey_id, region_id, count(*) AS n, var_samp("row") AS vr, var_samp(col) AS vc, covar_samp("row", col) AS cv FROM lab GROUP BY 1, 2),
    pe AS (SELECT *, (vr + vc) / 2 AS mid, sqrt(((vr - vc) / 2) * ((vr - vc) / 2) + cv * cv) AS sp FROM pm)"""
PCA_VALUE = "CASE WHEN n < 3 OR mid + sp <= 0 THEN 1.0 ELSE sqrt(greatest(mid - sp, 0.0) / (mid + sp)) END"


@register("g5_pca_elongation", f"{LAB}, {PCA} SELECT survey_id, region_id, {rd(PCA_VALUE, 5)} AS elongation_pca FROM pe")
def _pca(spark, sf):
    return regions.pca_elongation(labelled(spark, sf)).withColumn("elongation_pca", rnd("elongation_pca", 5))


@register("g4_region_metrics", f"""{LAB}, {PERIM}, {PCA}, g AS (SELECT survey_id, region_id, count(*) AS n, min(z) AS lo, max(z) AS hi,
      sum(CASE WHEN n4 < 4 THEN 1 ELSE 0 END) AS p FROM fl GROUP BY 1, 2)
    SELECT g.survey_id, g.region_id, CAST(g.n AS DOUBLE) AS area_m2, CAST(hi - lo AS DOUBLE) AS depth_m, {rd('4 * pi() * g.n / (p * p)')} AS circularity,
      {rd(PCA_VALUE.replace('n < 3', 'pe.n < 3'), 5)} AS elongation_pca FROM g JOIN pe ON g.survey_id = pe.survey_id AND g.region_id = pe.region_id""")
def _single(spark, sf):
    out = regions.region_metrics(labelled(spark, sf).select("survey_id", "row", "col", "region_id"), smooth(spark, sf), block=BLOCK)
    return out.select("survey_id", "region_id", "area_m2", "depth_m", rnd("circularity").alias("circularity"), rnd("elongation_pca", 5).alias("elongation_pca"))


@register("c3_label_candidates", f"""{LAB} SELECT survey_id, region_id, count(*) AS cells, {rd('avg("row")')} AS centroid_row, {rd('avg(col)')} AS centroid_col,
    max(z) AS rim_z, min(z) AS floor_z, max(z) - min(z) AS depth_m, {rd('least((max(z) - min(z)) / 3.0, 1.0)')} AS score FROM lab GROUP BY 1, 2""")
def _cands(spark, sf):
    out = regions.label_candidates(labelled(spark, sf).drop("z"), smooth(spark, sf))
    return out.withColumns({c: rnd(c) for c in ("centroid_row", "centroid_col", "score")})


SIZES = """sz AS (SELECT survey_id, region_id, count(*) AS cells, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM lab GROUP BY 1, 2 HAVING count(*) BETWEEN 5 AND 60),
    rk AS (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY cells DESC, region_id) AS k FROM sz),
    sv AS (SELECT survey_id, min("row") AS s0, max("row") AS s1, min(col) AS t0, max(col) AS t1 FROM smooth GROUP BY 1)"""


@register("c4_select_regions", f"""{LAB}, {SIZES} SELECT survey_id, region_id, cells FROM rk JOIN sv USING (survey_id) WHERE r0 > s0 AND r1 < s1 AND c0 > t0 AND c1 < t1""")
def _select(spark, sf):
    return regions.select_regions(labelled(spark, sf), smooth(spark, sf), 5, 60).select("survey_id", "region_id", "cells")


@register("c5_outline_edges", f"""{LAB}, sides AS (SELECT survey_id, region_id, 'n' AS side, "row" AS r, col AS c, "row" - 1 AS nr, col AS nc FROM lab UNION ALL
      SELECT survey_id, region_id, 'e', "row", col, "row", col + 1 FROM lab UNION ALL SELECT survey_id, region_id, 's', "row", col, "row" + 1, col FROM lab UNION ALL
      SELECT survey_id, region_id, 'w', "row", col, "row", col - 1 FROM lab)
    SELECT survey_id, region_id, side, CASE WHEN side IN ('n', 'e') THEN r ELSE r + 1 END AS r0, CASE WHEN side IN ('n', 'w') THEN c ELSE c + 1 END AS c0,
      CASE WHEN side IN ('n', 'w') THEN r ELSE r + 1 END AS r1, CASE WHEN side IN ('n', 'e') THEN c + 1 ELSE c END AS c1
    FROM sides s WHERE NOT EXISTS (SELECT 1 FROM lab k WHERE k.survey_id = s.survey_id AND k.region_id = s.region_id AND k."row" = s.nr AND k.col = s.nc)""")
def _outline(spark, sf):
    return regions.outline_edges(labelled(spark, sf))


@register("c10_representative", f"""{LAB}, md AS (SELECT survey_id, region_id, avg("row") AS mr, avg(col) AS mc FROM lab GROUP BY 1, 2)
    SELECT survey_id, region_id, "row", col FROM (SELECT l.survey_id, l.region_id, l."row", l.col, row_number() OVER (PARTITION BY l.survey_id, l.region_id
      ORDER BY round((l."row" - mr) * (l."row" - mr) + (l.col - mc) * (l.col - mc), 9), l."row", l.col) AS k FROM lab l JOIN md USING (survey_id, region_id)) q WHERE k = 1""")
def _representative(spark, sf):
    return regions.representative_cell(labelled(spark, sf))


@register("r19_erode", f"""{LAB}, {PERIM} SELECT survey_id, "row", col FROM fl WHERE n4 = 4""")
def _erode(spark, sf):
    return focal.erode(keyed(smooth(spark, sf).where("z > 600")), block=BLOCK)


@register("r19_dilate", f"""WITH {SMOOTH}, {MASK} SELECT DISTINCT survey_id, "row" + dr AS "row", col + dc AS col FROM m, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dr, dc)""")
def _dilate(spark, sf):
    return focal.dilate(smooth(spark, sf).where("z > 600"))


@register("r25_normalise_channels", f"""WITH {DEM}, st AS (SELECT survey_id, min(z) AS lo, max(z) AS hi FROM dem GROUP BY 1)
    SELECT survey_id, "row", col, CASE WHEN hi > lo THEN {rd('CAST(z - lo AS DOUBLE) / (hi - lo)')} ELSE 0.0 END AS z_norm FROM dem JOIN st USING (survey_id)""")
def _norm(spark, sf):
    return keyed(focal.normalise_channels(dem(spark, sf), ["z"]), rnd("z_norm").alias("z_norm"))


RELIEF_CTE = """rel AS MATERIALIZED (SELECT a.survey_id, a."row", a.col, a.z - CAST(sum(b.z) AS DOUBLE) / 25 AS relief FROM dem a JOIN dem b ON a.survey_id = b.survey_id
    AND b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY a.survey_id, a."row", a.col, a.z HAVING count(*) = 25)"""


@register("relief_candidates", f"""WITH RECURSIVE {DEM}, {RELIEF_CTE}, m AS MATERIALIZED (SELECT survey_id, "row", col, relief FROM rel WHERE relief < -60), {components('m')}
    SELECT survey_id, region_id, count(*) AS cells, {rd('min(relief)')} AS min_relief, {rd('avg("row")')} AS centroid_row, {rd('avg(col)')} AS centroid_col,
      {rd('least(-min(relief) / 300, 1.0)')} AS score FROM lab GROUP BY 1, 2 HAVING count(*) >= 4""")
def _flagship(spark, sf):
    relief = focal.local_relief(dem(spark, sf), 2, out="relief", block=BLOCK)
    lab = comp.label(relief.where("relief < -60"), BLOCK)
    out = lab.groupBy("survey_id", "region_id").agg(
        F.count("*").alias("cells"), F.min("relief").alias("min_relief"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"),
        F.least(-F.min("relief") / 300, F.lit(1.0)).alias("score")).where("cells >= 4")
    return out.withColumns({c: rnd(c) for c in ("min_relief", "centroid_row", "centroid_col", "score")}).orderBy(F.desc("score"), "survey_id", "region_id")

import math
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from helpers import filled, flood_labels, grid, surface
from pyspark.sql import functions as F

from fellscan.operators import fill, focal, horizon, joins, regions, warp
from fellscan.operators.components import connected_components, eps_clusters, label
from fellscan.operators.quantiles import exact_quantile

RNG = np.random.default_rng(7)


def test_plane_has_its_slope_and_no_relief(spark):
    rows, cols = np.indices((20, 24))
    s = surface(spark, 100 + 0.1 * rows + 0.2 * cols)
    out = focal.derive(s, ["slope", "slope_gradient", "tpi", "profile_curvature"], block=7)
    inner = out.where("slope IS NOT NULL").agg(*[F.max(c) for c in ("slope", "slope_gradient", "tpi", "profile_curvature")]).first()
    want = math.degrees(math.atan(math.hypot(0.1, 0.2)))
    assert abs(inner[0] - want) < 1e-9 and abs(inner[1] - want) < 1e-9 and abs(inner[2]) < 1e-9 and abs(inner[3]) < 1e-9
    relief = focal.local_relief(s, 3, block=7).where("local_relief IS NOT NULL").agg(F.max(F.abs("local_relief"))).first()[0]
    assert relief < 1e-9


def test_block_size_and_row_order_do_not_matter(spark):
    z = RNG.integers(-50, 50, (30, 33))
    hole = RNG.random(z.shape) < 0.03
    s = surface(spark, z, drop=hole)
    for fn in (lambda d, b: focal.local_relief(d, 3, block=b).select("row", "col", "local_relief"), lambda d, b: focal.lrm(d, 6, block=b).select("row", "col", "lrm_6"),
               lambda d, b: horizon.horizon(d, 3, ("svf",), block=b).select("row", "col", "svf"), lambda d, b: fill.fill_depressions(d, b).select("row", "col", "filled"),
               lambda d, b: focal.discovery_surface(d, 5, 5, b).select("row", "col", "relief_10", "slope")):
        a = sorted((tuple(None if x is None else round(x, 9) for x in r) for r in fn(s, 8).collect()), key=repr)
        b = sorted((tuple(None if x is None else round(x, 9) for x in r) for r in fn(s.orderBy(F.rand(3)), 64).collect()), key=repr)
        assert a == b


def test_local_relief_matches_numpy(spark):
    z = RNG.integers(-500, 500, (18, 21)).astype(float)
    got = grid(focal.local_relief(surface(spark, z), 2, block=6), "local_relief", z.shape)
    for i in range(2, 16):
        for j in range(2, 19):
            assert abs(got[i, j] - (z[i, j] - z[i - 2:i + 3, j - 2:j + 3].mean())) < 1e-9
    assert np.isnan(got[0]).all() and np.isnan(got[:, 1]).all()


def test_flat_ground_sees_the_whole_sky(spark):
    out = horizon.vat(surface(spark, np.full((24, 24), 5.0)), 4, block=10).where("svf IS NOT NULL")
    row = out.agg(F.min("svf"), F.max("openness_positive"), F.min("openness_positive"), F.count("*")).first()
    assert row[0] == 1.0 and abs(row[1] - 90) < 1e-9 and abs(row[2] - 90) < 1e-9 and row[3] > 0


def test_fill_matches_priority_flood(spark):
    for n in range(3):
        z = np.random.default_rng(n).integers(0, 30, (23, 26)).astype(float)
        s = surface(spark, z)
        assert (grid(fill.fill_depressions(s, 6), "filled", z.shape) == filled(z)).all()
    # the contracted rim graph gives the same levels as the one finished in a task
    assert (grid(fill.fill_depressions(s, 6, finish_edges=5), "filled", z.shape) == filled(z)).all()


def test_fill_of_surveys_side_by_side(spark):
    """A flat survey, a bowl and a winding channel; only the larger ones' rim graphs are contracted."""
    r, c = np.mgrid[0:21, 0:21]
    channel = np.where((r % 4 == 1) | ((r % 4 != 1) & (c == np.where(r // 4 % 2, 1, 19))), 3.0 + (r * 21 + c) % 5, 50.0)
    scenes = {1: np.full((4, 5), 7.0), 2: np.hypot(r - 10, c - 10).round(), 3: channel}
    s = reduce(lambda x, y: x.unionByName(y), [surface(spark, z).withColumn("survey_id", F.lit(k).cast("string")) for k, z in scenes.items()])
    for block, finish in ((5, 30), (16, 1_000_000)):
        out = fill.fill_depressions(s, block, finish_edges=finish).persist()
        for k, z in scenes.items():
            assert (grid(out.where(F.col("survey_id") == str(k)), "filled", z.shape) == filled(z)).all()


def test_labels_match_flood_fill_whatever_the_block(spark):
    for seed, share in ((1, 0.5), (2, 0.62), (3, 0.35)):
        mask = np.random.default_rng(seed).random((25, 29)) < share
        s = surface(spark, mask.astype(float), drop=~mask)
        want = flood_labels(mask)
        for block, finish in ((5, 10**6), (64, 10**6), (5, 3)):
            got = {(r["row"], r["col"]): r["region_id"] for r in label(s, block, finish_edges=finish).collect()}
            assert got == want


def test_components_by_contraction_equal_direct(spark):
    rng = np.random.default_rng(5)
    rows = [("a", int(u), int(v)) for u, v in rng.integers(0, 200, (180, 2))] + [("b", i, i + 1) for i in range(60)]
    edges = spark.createDataFrame(rows, "scope string, u bigint, v bigint")
    direct = {(r.scope, r.id): r.root for r in connected_components(edges).collect()}
    by_rounds = {(r.scope, r.id): r.root for r in connected_components(edges, finish_edges=0).collect()}
    assert direct == by_rounds and direct[("b", 60)] == 0


def test_crowded_places_cluster_exactly(spark):
    rng = np.random.default_rng(9)
    hot = np.concatenate([rng.normal((0, 0), 0.5, (150, 2)), rng.normal((7.2, 0), 0.4, (150, 2)), np.tile([[50.0, 50.0]], (40, 1)), rng.uniform(0, 200, (60, 2))])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(hot)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if math.hypot(hot[i, 0] - hot[j, 0], hot[i, 1] - hot[j, 1]) <= 6.0:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {i: find(i) for i in range(len(rows))}
    for brute in (4096, 16):
        got = {r.id: r.cluster_id for r in eps_clusters(df, 6.0, brute=brute).collect()}
        assert got == want


def test_quantiles_of_large_groups_equal_the_direct_ones(spark):
    rng = np.random.default_rng(3)
    vals = {"a": rng.normal(size=801), "b": np.repeat(rng.integers(0, 5, 50), 3).astype(float), "c": np.array([2.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in vals.items() for v in vs], "k string, v double")
    for q in (0.0, 0.37, 0.5, 0.9, 1.0):
        for direct in (100_000, 0):
            got = {r.k: r.out for r in exact_quantile(df, ["k"], "v", q, "out", direct=direct).collect()}
            assert all(abs(got[k] - np.quantile(v, q)) < 1e-12 for k, v in vals.items())


def test_cylinder_and_cone_k(spark):
    rows, cols = np.indices((41, 41))
    d = np.hypot(rows - 20, cols - 20)
    for z, want, tol in ((np.where(d <= 12, 5.0, 10.0), 1.0, 0.05), (np.where(d <= 15, d / 3, 5.0), 3.0, 0.25)):
        inside = (d <= 12) if want == 1.0 else (d <= 15)
        z = z.copy()
        if want == 1.0:  # one rim cell gives the region its rim height
            z[20, 33], inside[20, 33] = 10.0, True
        lab = surface(spark, z, drop=~inside).withColumn("region_id", F.lit(1).cast("bigint")).drop("z")
        k = regions.batch_morphometrics(lab, surface(spark, z)).first()["k_value"]
        assert abs(k - want) < tol


def test_rotated_square_and_holes(spark):
    rows, cols = np.indices((40, 40))
    diamond = np.abs(rows - 20) + np.abs(cols - 20) <= 10
    lab = surface(spark, diamond.astype(float), drop=~diamond).withColumn("region_id", F.lit(3).cast("bigint"))
    m = regions.shape_metrics(lab, block=16).first()
    assert m["holes"] == 0 and abs(m["length_m"] - m["width_m"]) < 2 and m["length_m"] * m["width_m"] < 21 * 21
    ring = diamond & (np.abs(rows - 20) + np.abs(cols - 20) >= 5)
    lab = surface(spark, ring.astype(float), drop=~ring).withColumn("region_id", F.lit(3).cast("bigint"))
    assert regions.topology(lab, block=16).first()["holes"] == 1
    assert regions.interiors(lab).count() == int((diamond & ~ring).sum())


def enclosed_by_flood(mask: np.ndarray) -> set:
    """Cells of a mask's complement that eight-way moves from outside its grown box do not reach."""
    free = np.pad(~mask, 1, constant_values=True)
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        for a in (i - 1, i, i + 1):
            for b in (j - 1, j, j + 1):
                if 0 <= a < free.shape[0] and 0 <= b < free.shape[1] and free[a, b] and (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
    return {(int(i) - 1, int(j) - 1) for i, j in zip(*np.nonzero(free)) if (i, j) not in seen}


@pytest.mark.parametrize("width,finish", [(64, 1_000_000), (2, 1_000_000), (3, 4)])
def test_interiors_match_a_flood_fill(spark, width, finish):
    masks = [np.random.default_rng(k).random((23, 19)) < p for k, p in enumerate((0.55, 0.7, 0.85))]
    rings = np.zeros((23, 19), bool)  # a ring in a ring, a cut ring, and one that is shut at corners only
    rings[0:11, 0:11] = True
    rings[1:10, 1:10] = False
    rings[3:8, 3:8] = True
    rings[4:7, 4:7] = False
    rings[12:18, 0:6] = True
    rings[13:17, 1:5] = False
    rings[17, 3] = False
    for i, j in ((14, 12), (13, 13), (14, 14), (15, 13)):
        rings[i, j] = True
    masks.append(rings)
    pdf = pd.concat([pd.DataFrame({"survey_id": f"a:{k % 2}", "region_id": k, "row": r - 5, "col": c - 7}) for k, m in enumerate(masks) for r, c in [np.nonzero(m)]])
    got = regions.interiors(spark.createDataFrame(pdf), width, finish).toPandas()
    assert not got.duplicated().any()
    for k, m in enumerate(masks):
        mine = got[got["region_id"] == k]
        assert set(zip(mine["row"] + 5, mine["col"] + 7)) == enclosed_by_flood(m)
        assert (mine["survey_id"] == f"a:{k % 2}").all()
    assert regions.interiors(spark.createDataFrame(pdf).where("row > 1000")).count() == 0


def test_interior_of_a_long_diagonal_ring(spark):
    """A band of 20 000 cells whose bounding box would hold 50 million: only its gaps are built."""
    n = 5_000
    i = np.arange(n)
    band = np.concatenate([np.stack([i, i + d], axis=1) for d in (0, 1, 3, 4)] + [np.array([[0, 2], [n - 1, n + 1], [0, 0]])])
    pdf = pd.DataFrame(np.unique(band, axis=0), columns=["row", "col"]).assign(survey_id="s", region_id=1)
    lab = spark.createDataFrame(pdf)
    assert regions.interiors(lab).count() == n - 2


def test_gap_fill_takes_the_nearest_value(spark):
    z = RNG.integers(0, 1000, (14, 15)).astype(float)
    hole = np.zeros(z.shape, bool)
    hole[4:9, 5:10] = True
    got = grid(warp.fill_gaps(surface(spark, z, drop=hole), 3), "z", z.shape)
    for i in range(14):
        for j in range(15):
            if not hole[i, j]:
                assert got[i, j] == z[i, j]
                continue
            near = sorted(((a - i) ** 2 + (b - j) ** 2, a, b) for a in range(14) for b in range(15) if not hole[a, b])[0]
            assert got[i, j] == z[near[1], near[2]] if near[0] <= 9 else np.isnan(got[i, j])


def test_mercator_plane_is_a_plane(spark):
    rows, cols = np.indices((40, 40))
    s = surface(spark, 0.5 * cols - 0.25 * rows, "u")
    survey = spark.createDataFrame([("u", 32617, 500000.0, 4480000.0, 1.0, 1.0, 1.0)], "survey_id string, epsg int, x0 double, y0 double, dx double, dy double, resolution_m double")
    out = warp.to_mercator(s, survey, 17, 256)
    from fellscan.functions.geodesy import utm_forward

    lon = ((F.col("x") * 256 + F.col("px")) + 0.5) / (2.0**17 * 256) * 360 - 180
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * ((F.col("y") * 256 + F.col("py")) + 0.5) / (2.0**17 * 256)))))
    e, n = utm_forward(lon, lat, F.lit(17))
    want = 0.5 * (e - 500000 - 0.5) - 0.25 * (4480000 - n - 0.5)
    r = out.select(F.max(F.abs(F.col("value") - want)), F.count("*")).first()
    assert r[1] > 500 and r[0] < 1e-6
    assert out.count() == out.select("x", "y", "px", "py").distinct().count()


def test_sampling_meets_only_sources_that_reach_a_point(spark, capsys):
    """Sources of very different sizes and spacings, overlapping; the finest that holds a cell there wins."""
    rng = np.random.default_rng(5)
    grids = [(f"s{k}", 26910 + k % 2, float(rng.integers(-300, 300)), float(rng.integers(-300, 300)), d, d, d, f"p{k}") for k, d in enumerate([1.0, 1.0, 4.0, 0.5, 32.0, 2.0])]
    survey = spark.createDataFrame(grids, "source_id string, epsg int, x0 double, y0 double, dx double, dy double, resolution_m double, path string")
    cells = {(g[0], r, c): float(rng.integers(0, 99)) for g in grids for r in range(12) for c in range(9) if rng.random() > 0.1}
    surface_ = spark.createDataFrame([(*k, z) for k, z in cells.items()] + [("s0", 0, 99, None)], "source_id string, row long, col long, z double")
    spots = [(i, float(g[2] + rng.random() * 12 * g[4]), float(g[3] - rng.random() * 13 * g[5]), g[1]) for i, g in enumerate(grids * 40)] + [(900, None, 0.0, 26910), (901, 1e9, 1e9, 26911)]
    out = joins.sample_nearest(spark.createDataFrame(spots, "id int, x double, y double, epsg int"), surface_, survey, "id")
    for row in out.collect():
        want = None
        for s, epsg, x0, y0, dx, dy, res, path in sorted(grids, key=lambda g: (g[6], g[7])):
            if want is None and row.x is not None and epsg == row.epsg:
                want = (z, s) if (z := cells.get((s, math.floor((y0 - row.y) / dy), math.floor((row.x - x0) / dx)))) is not None else None
        assert (row.elevation_m, row.source) == (want or (None, None))
    assert out.count() == len(spots)
    assert joins.sample_nearest(spark.createDataFrame(spots, "id int, x double, y double, epsg int"), surface_.limit(0), survey, "id").where("elevation_m IS NOT NULL").count() == 0
    capsys.readouterr()
    out.explain()
    keyed = [line for line in capsys.readouterr().out.splitlines() if "Join" in line and "epsg" in line]
    assert keyed and all("_gx" in line and "_level" in line for line in keyed)

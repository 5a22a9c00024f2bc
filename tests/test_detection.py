import numpy as np
import pytest
from helpers import surface
from pyspark.sql import functions as F

from fellscan.operators import focal
from fellscan.plans import discovery, filters, fusion, passes  # noqa: F401
from fellscan.plans.registry import Found, get_pass, register_pass


def forms(spark, z, step=1.0, drop=None):
    return focal.discovery_surface(surface(spark, z, drop=drop), step, step, 64)


def kinds(found):
    return sorted(r["feature_type"] for r in found.candidates.select("feature_type").collect())


def test_mound_on_a_slope_and_platform(spark):
    y, x = np.indices((100, 100)) * 2.0
    plane = 100 + 0.05 * x
    mound = plane + 3 * np.exp(-((x - 100) ** 2 + (y - 100) ** 2) / (2 * 6**2))
    assert kinds(get_pass("raised_features")(forms(spark, mound, 2.0), dx=2.0, dy=2.0)) == ["mound"]
    flat = plane + np.where((abs(x - 100) <= 7) & (abs(y - 100) <= 7), 2.0, 0.0)
    assert kinds(get_pass("raised_features")(forms(spark, flat, 2.0), dx=2.0, dy=2.0, flat_slope_deg=20)) == ["platform"]
    assert kinds(get_pass("raised_features")(forms(spark, plane, 2.0), dx=2.0, dy=2.0)) == []


def test_bank_and_ditch(spark):
    y, x = np.indices((120, 120)).astype(float)
    bar = (abs(y - 60) <= 3) & (abs(x - 60) <= 30)
    assert "linear_bank" in kinds(get_pass("linear_features")(forms(spark, 50 + 2.0 * bar)))
    assert "linear_ditch" in kinds(get_pass("linear_features")(forms(spark, 50 - 2.0 * bar)))


def test_closed_ring_is_an_enclosure_and_a_cut_one_is_not(spark):
    y, x = np.indices((120, 120)).astype(float)
    far = np.maximum(abs(x - 60), abs(y - 60))
    ring = (far >= 18) & (far <= 21)
    got = get_pass("enclosures")(forms(spark, 10 + 2.0 * ring)).candidates.collect()
    outer = [r for r in got if r["morphometrics"]["polarity"] == 1.0]
    assert len(outer) == 1 and outer[0]["morphometrics"]["interior_area_m2"] >= 1200
    cut = ring & ~((x > 60) & (abs(y - 60) < 4))
    assert not [r for r in get_pass("enclosures")(forms(spark, 10 + 2.0 * cut)).candidates.collect() if r["morphometrics"]["polarity"] == 1.0]


def test_ring_round_missing_ground_is_not_an_enclosure(spark):
    y, x = np.indices((120, 120)).astype(float)
    far = np.maximum(abs(x - 60), abs(y - 60))
    hole = far <= 3
    got = get_pass("enclosures")(forms(spark, 10 + 2.0 * ((far >= 18) & (far <= 21)), drop=hole)).candidates.collect()
    assert not [r for r in got if r["morphometrics"]["polarity"] == 1.0]


def test_regular_mounds_form_a_pattern(spark):
    y, x = np.indices((120, 180)).astype(float)
    z = sum(3 * np.exp(-((x - c) ** 2 + (y - 60) ** 2) / 18) for c in (50, 85, 120))
    got = get_pass("repeated_patterns")(forms(spark, 10 + z)).candidates.collect()
    assert len(got) == 1 and got[0]["morphometrics"]["member_count"] == 3
    z = sum(3 * np.exp(-((x - c) ** 2 + (y - 60) ** 2) / 18) for c in (40, 62, 130))
    assert get_pass("repeated_patterns")(forms(spark, 10 + z)).candidates.count() == 0


def test_ridge_hollow_and_scarp(spark):
    y, x = np.indices((120, 200)).astype(float)
    ridge = 8 * np.exp(-((y - 60) ** 2) / 50) * (abs(x - 100) < 50)
    assert "ridge" in kinds(get_pass("geological_forms")(forms(spark, 10 + ridge)))
    assert "hollow" in kinds(get_pass("geological_forms")(forms(spark, 10 - ridge)))
    # a 45 degree face that fades out sideways: a cut-off plateau would have steep sides running off the survey
    face = np.clip(y - 57.0, 0, 6) * np.clip((70 - abs(x - 100)) / 30, 0, 1)
    assert "scarp" in kinds(get_pass("geological_forms")(forms(spark, 10 + face)))


def test_parameters_are_checked(spark):
    assert discovery.check_params(spark, {"min_members": 2}, {"min_members": 3}).count() == 1
    with pytest.raises(ValueError):
        get_pass("raised_features")(forms(spark, np.zeros((60, 60))), threshold_m=-1)
    with pytest.raises(ValueError):
        get_pass("tpi")(surface(spark, np.zeros((5, 5))))


def test_own_pass_can_be_registered(spark):
    @register_pass("steep_cells", ["slope"], limit=10.0)
    def steep(table, limit):
        return Found(table.where(F.col("slope") > limit))

    s = surface(spark, np.zeros((3, 3))).withColumn("slope", F.col("row") * 10.0)
    assert get_pass("steep_cells")(s, limit=5.0, other=1).candidates.count() == 6 and get_pass("steep_cells").unused == ["other"]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "cand_id bigint, pass_name string, lon double, lat double, score double, feature_type string, area_m2 double, morphometrics map<string,double>")


def test_fusion_merges_by_distance_and_rewards_agreement(spark):
    m = {"area_m2": 50.0, "depth_m": 1.0}
    near = [(1, "a", -80.0, 40.0, 0.6, "sinkhole", 50.0, m), (2, "b", -80.00005, 40.00005, 0.6, "sinkhole", 60.0, {"depth_m": 3.0}), (3, "c", -80.0, 40.00004, 0.6, "depression", 70.0, m)]
    apart = [(4, "a", -80.0, 41.0, 0.5, "cave_entrance", 10.0, m)]
    out = {r.cluster_id: r for r in fusion.fuse(candidates(spark, near + apart), {}, 15.0).collect()}
    assert set(out) == {1, 4} and abs(out[1].score - 0.72) < 1e-9 and out[1].feature_type == "sinkhole" and out[1].outline_id == 3
    assert abs(out[1].morphometrics["depth_m"] - 5 / 3) < 1e-9 and out[1].source_passes == ["a", "b", "c"]
    assert fusion.fuse(candidates(spark, apart), {"a": 0.0}, 15.0).count() == 0  # no weight, no confidence


def test_gate_bounds_are_exclusive_and_missing_shapes_pass(spark):
    base = {"area_m2": 50.0, "depth_m": 1.0}
    rows = [(1, "a", 0.0, 0.0, 0.5, "x", 50.0, base), (2, "a", 0.0, 0.0, 0.15, "x", 50.0, base), (3, "a", 0.0, 0.0, 0.5, "x", 50.0, {**base, "area_m2": 20.0}),
            (4, "a", 0.0, 0.0, 0.5, "x", 50.0, {**base, "depth_m": 0.3}), (5, "a", 0.0, 0.0, 0.5, "x", 50.0, {**base, "depth_m": 150.0}), (6, "a", 0.0, 0.0, 0.5, "x", 50.0, {**base, "elongation": 0.4}),
            (7, "a", 0.0, 0.0, 0.5, "x", 50.0, {**base, "circularity": 0.3})]
    got = {r.cand_id: r.reject_reason for r in filters.with_gate(candidates(spark, rows)).collect()}
    assert got == {1: None, 2: "score", 3: "area", 4: "depth_low", 5: "depth_high", 6: "elongation", 7: "circularity"}


def test_cap_comes_after_the_filters(spark):
    m = {"area_m2": 50.0, "depth_m": 1.0}
    rows = [(i, "a", 0.0, 0.0, 1 - i / 100, "x", 50.0, m) for i in range(20)]
    c = candidates(spark, rows).withColumn("tile_id", F.lit("t"))
    out = filters.post_fuse_chain(c, [lambda d: d.where("cand_id % 2 = 1")], cap=5)
    assert sorted(r.cand_id for r in out.collect()) == [1, 3, 5, 7, 9]


def test_infrastructure_overlap_and_spring_exemption(spark):
    cells = spark.createDataFrame([(1, float(i), 0.5) for i in range(10)] + [(2, float(i), 50.0) for i in range(10)] + [(3, 2.0, 99.0)], "cand_id bigint, x double, y double")
    cands = spark.createDataFrame([(1, 5.0, 0.5, "depression"), (2, 5.0, 50.0, "spring"), (3, 2.0, 99.0, "depression"), (4, 5.0, 51.0, "depression")], "cand_id bigint, x double, y double, feature_type string")
    seg = spark.createDataFrame([(1, "road", -500.0, 0.5, 2.0, 0.5), (2, "water", 0.0, 50.0, 900.0, 50.0)], "seg_id bigint, layer string, x1 double, y1 double, x2 double, y2 double")
    for reach, want in ((0.9, "road"), (0.0, "road")):
        got = {r.cand_id: r.reject_layer for r in filters.infrastructure_verdict(cands, cells, seg, None, {"road": reach, "water": 2.0}, size=16.0).collect()}
        assert got == {1: want, 2: None, 3: None, 4: "water"}


def test_polygon_buildings_and_cemetery_exception(spark):
    ring = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    t = "id bigint, ring array<struct<lon:double,lat:double>>"
    b = spark.createDataFrame([(1, ring(0.0, 0.0, 0.01)), (2, ring(1.0, 1.0, 0.01))], t)
    c = spark.createDataFrame([(9, ring(1.0, 1.0, 0.05))], t)
    cand = spark.createDataFrame([(1, 0.001, 0.001), (2, 1.001, 1.0), (3, 0.5, 0.5)], "cand_id bigint, lon double, lat double")
    assert sorted(r.cand_id for r in filters.exclude_buildings(cand, b, c).collect()) == [2, 3]


def test_steep_rims_are_dropped_and_thin_ones_kept(spark):
    s = surface(spark, np.zeros((60, 60))).withColumn("slope", F.when(F.col("col") < 30, 30.0).otherwise(2.0))
    c = spark.createDataFrame([("s", 1, 15.5, 15.5, 50.0), ("s", 2, 40.5, 45.5, 50.0), ("s", 3, 20.5, 10.5, 0.2)], "survey_id string, region_id bigint, centroid_row double, centroid_col double, area_m2 double")
    assert sorted(r.region_id for r in filters.rim_filter(c, s).collect()) == [2, 3]


def test_point_passes_are_placed_in_survey_metres(spark):
    """A void at known metres is fused there, whatever the cells of the pass."""
    from fellscan.plans.survey import run_preset
    from fellscan.sources.presets import Preset

    grid = [(x, y) for x in range(100) for y in range(100) if not (60 <= x < 70 and 30 <= y < 40)]
    points = spark.createDataFrame([("s", 1000.5 + x, 2099.5 - y, 1, 2) for x, y in grid], "survey_id string, x double, y double, number_of_returns int, classification int")
    surface = spark.createDataFrame([("s", 0, 0, 1.0)], "survey_id string, row long, col long, z double")
    for cell in (1.0, 2.0, 5.0):
        voids = Preset("voids", ["point_density"], 0.0, {}, {"point_density": {"cell_size_m": cell, "z_score_threshold": -0.5}})
        (found,) = run_preset(surface, points, voids).collect()
        assert abs(found.x - 65) <= 0.5 and abs(found.y - 35) <= 0.5


def test_ground_is_decided_for_each_survey(spark):
    """A survey without classes is filtered; beside it, one with classes keeps its own ground."""
    from fellscan.plans.survey import build_terrain

    rows = [("classed", x + 0.5, y + 0.5, 10.0 if (x, y) != (6, 6) else 30.0, 1, 2) for x in range(12) for y in range(12)]
    rows += [("bare", x + 0.5, y + 0.5, 10.0 if (x, y) != (6, 6) else 30.0, 1, 1) for x in range(12) for y in range(12)]
    points = spark.createDataFrame(rows, "survey_id string, x double, y double, z double, number_of_returns int, classification int")
    top = {r.survey_id: r.z for r in build_terrain(points, window=4).groupBy("survey_id").agg(F.max("z").alias("z")).collect()}
    assert top["classed"] > 11 and abs(top["bare"] - 10) < 1e-9

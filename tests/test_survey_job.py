"""The job from surfaces to stored detections: georeferencing, context filters, fusion across surveys, tiles and cap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellscan.plans import survey
from fellscan.sources.presets import Preset
from helpers import surface

PITS = Preset("pits", ["fill_difference", "tpi"], 0.05, {}, {"fill_difference": {"min_depth_m": 0.5, "min_area_m2": 25}, "tpi": {"threshold": -50.0}})
#: row, column and what befalls the pit there
PLACES = {"kept": (20, 20), "house": (20, 60), "chapel": (20, 100), "road": (60, 20), "steep": (100, 80), "spring": (60, 100)}
X0, Y1 = 500_000.0, 4_480_000.0


def scene(tilt: bool = True) -> np.ndarray:
    r, c = np.indices((130, 130)).astype(float)
    z = 500 + 0.002 * r
    for i, j in PLACES.values():
        d = np.hypot(r - i, c - j)
        z = np.where(d < 7, z - 3 * (1 - d / 7), z)
    if tilt:  # a face that rises towards one pit from all sides but drains nowhere
        d = np.hypot(r - PLACES["steep"][0], c - PLACES["steep"][1])
        z = z + np.where((d >= 7) & (d < 16), (d - 7) * 1.2, 0) + np.where(d >= 16, np.maximum(0, 10.8 - (d - 16) * 1.2), 0)
    return z


def derived(spark, z, name):
    return survey.add_derivatives(surface(spark, z, name), needs={"fill_diff", "focal"})


@pytest.fixture(scope="module")
def two(spark):
    """The scene as one survey, and its right half as another one that begins 70 cells east."""
    z = scene()
    whole, half = derived(spark, z, "whole"), derived(spark, z[:, 70:], "half")
    return whole.unionByName(half).persist()


def lonlat(spark, x, y):
    return survey.georeference(spark.createDataFrame([(32617, float(x), float(y))], "epsg int, x double, y double")).select("lon", "lat").first()


def box(spark, name, half):
    """A rectangle in degrees around a pit."""
    i, j = PLACES[name]
    a, b = lonlat(spark, X0 + j + 0.5 - half, Y1 - i - 0.5 - half), lonlat(spark, X0 + j + 0.5 + half, Y1 - i - 0.5 + half)
    return a.lon, a.lat, b.lon, b.lat


def around(spark, **parts):
    surveys = spark.createDataFrame([("whole", 32617, X0, Y1), ("half", 32617, X0 + 70, Y1)], "survey_id string, epsg int, x0 double, y1 double")
    return survey.Context(surveys, **parts)


def names(rows):
    """Which pits detections belong to, by where they lie."""
    out = []
    for r in rows:
        gaps = {n: math.hypot(r.x - X0 - j - 0.5, Y1 - r.y - i - 0.5) for n, (i, j) in PLACES.items()}
        out.append(min(gaps, key=gaps.get))
        assert min(gaps.values()) < 2.5
    return sorted(out)


def test_surveys_are_fused_and_georeferenced(spark, two):
    found = survey.detect(two, None, PITS, where=survey.frames(around(spark), None))
    rows = found.candidates.collect()
    assert names(rows) == sorted(PLACES)  # a pit that both surveys hold is one candidate
    alone = survey.run_preset(two, None, PITS).collect()
    shared = sum(j > 85 for _, j in PLACES.values())
    assert len(alone) >= len(PLACES) + shared
    both = found.members.groupBy("cluster_id").agg(F.countDistinct("survey_id").alias("n")).where("n = 2").count()
    assert both >= shared
    for r in rows:
        want = lonlat(spark, r.x, r.y)
        assert abs(want.lon - r.lon) < 1e-9 and abs(want.lat - r.lat) < 1e-9 and 40.4 < r.lat < 40.5 and -81.01 < r.lon < -80.99
        assert (r.centroid_row, r.centroid_col) != (None, None) and r.area_m2 > 25


def test_context_filters(spark, two):
    buildings = spark.createDataFrame([("h", *box(spark, "house", 5)), ("c", *box(spark, "chapel", 5))], "id string, west double, south double, east double, north double")
    yard = spark.createDataFrame([("y", *box(spark, "chapel", 9))], buildings.schema)
    i, j = PLACES["road"]
    road = (X0 + j - 60, Y1 - i - 3, X0 + j + 10, Y1 - i - 3)
    segments = spark.createDataFrame([("road", 32617, *road), ("road", 32618, X0 + 20, Y1 - 20, X0 + 30, Y1 - 20)], "layer string, epsg int, x1 double, y1 double, x2 double, y2 double")
    run = lambda **parts: names(survey.survey_to_detections(None, PITS, terrain=two, context=around(spark, **parts)).collect())
    every = sorted(PLACES)
    without = lambda *gone: [n for n in every if n not in gone]
    assert run(rim=False) == every
    assert run(rim=True) == without("steep")
    assert run(buildings=buildings, rim=False) == without("house", "chapel")
    assert run(buildings=buildings, cemeteries=yard, rim=False) == without("house")  # what stands on a cemetery does not count
    assert run(segments=segments, rim=False) == without("road")  # a road of another system lies elsewhere
    assert run(buildings=buildings, cemeteries=yard, segments=segments) == without("house", "road", "steep")


def test_tiles_cap_and_stored_rows(spark, two):
    context = around(spark, rim=False)
    kept = survey.survey_to_detections(None, PITS, terrain=two, context=context, tile_cells=50)
    assert {r.tile_id.split(":", 1)[0] for r in kept.collect()} <= {"whole", "half"}
    for r in kept.collect():
        assert r.tile_id == f"{r.survey_id}:{int(r.centroid_row // 50)}:{int(r.centroid_col // 50)}"
    capped = survey.survey_to_detections(None, PITS, terrain=two, context=context, tile_cells=10_000, cap=1)
    assert capped.count() == capped.select("tile_id").distinct().count() < kept.count()
    found = survey.detect(two, None, PITS, where=survey.frames(context, None))
    stored = survey.stored_rows(kept).collect()
    best = {r.cand_id: r for r in kept.collect()}
    for r in stored:
        m = best[r.cand_id].morphometrics
        assert r.depth_m == (m.get("depth_m") or m.get("lrm_anomaly_m")) and r.area_m2 == m["area_m2"] and r.morphometrics["area_m2"] == round(m["area_m2"], 4)
    passes = survey.pass_results(kept, found.members).collect()
    assert {p.cand_id for p in passes} == set(best) and all(p.raw_score > 0.15 for p in passes)
    total = {r.survey_id: r for r in survey.job_summary(found.candidates, kept).collect()}
    assert sum(r.raw_candidates for r in total.values()) == found.candidates.count() and sum(r.stored for r in total.values()) == len(stored)


def test_other_systems_stop_the_job(spark):
    with pytest.raises(Exception, match="no UTM zone"):
        survey.georeference(spark.createDataFrame([(3857, 1.0, 2.0)], "epsg int, x double, y double")).collect()
    south = survey.georeference(spark.createDataFrame([(32733, 500_000.0, 9_000_000.0)], "epsg int, x double, y double")).first()
    assert abs(south.lon - 15) < 1e-9 and -10 < south.lat < -8


def test_candidates_beyond_two_hundred_are_kept(spark):
    """A survey has as many detections as it has pits."""
    r, c = np.indices((320, 320)).astype(float)
    z = 500 + 0.0 * r
    for i in range(16):
        for j in range(16):
            z = z - 3 * np.clip(1 - np.hypot(r - 20 * i - 10, c - 20 * j - 10) / 6, 0, None)
    out = survey.survey_to_detections(None, PITS, terrain=derived(spark, z, "s"), eps=5.0)
    assert out.count() == 256 and out.select("tile_id").distinct().count() == 1

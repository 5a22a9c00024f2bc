"""Operators that must not meet everything with everything: equal to plain loops, with pairs left where they arise."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fellscan.operators import evaluate, joins, learn, rects as kernels
from fellscan.operators.components import eps_clusters
from fellscan.plans import filters
from fellscan.registered.base import rnd, rnd_many


def rects(spark, rng, n, key, most, side=4.0):
    at, size = rng.uniform(0, side, (n, 2)).round(3), rng.uniform(0, most, (n, 2)).round(3)
    rows = [(i, float(w), float(s), float(w + x), float(s + y)) for i, ((w, s), (x, y)) in enumerate(zip(at, size))]
    return rows, spark.createDataFrame(rows, f"{key} long, west double, south double, east double, north double")


def exchanges_above(df, word):
    """Exchanges between the first use of ``word`` in the plan and its root."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.split(word)[0].count("Exchange")


def test_dems_of_a_tile_are_ranked_without_an_exchange_of_pairs(spark):
    rng = np.random.default_rng(1)
    tiles, t = rects(spark, rng, 60, "tile_id", 0.5)
    dems, d = rects(spark, rng, 80, "dem_id", 1.5)
    want = {}
    for i, w, s, e, n in tiles:
        over = [(-(min(e, e2) - max(w, w2)) * (min(n, n2) - max(s, s2)), j) for j, w2, s2, e2, n2 in dems if e > w2 and w < e2 and n > s2 and s < n2]
        want |= {(i, j): (k, -o) for k, (o, j) in enumerate(sorted(over), 1)}
    out = joins.all_dems(t, d)
    assert {(r.tile_id, r.dem_id): (r.rank, r.overlap) for r in out.collect()} == want
    assert exchanges_above(out, "Join") == 0
    assert {(r.tile_id, r.dem_id): (1, r.overlap) for r in joins.best_dem(t, d).collect()} == {k: v for k, v in want.items() if v[0] == 1}
    twice = joins.all_dems(t.unionByName(t), d)  # rows of one id are ranked together
    assert twice.count() == 2 * len(want) and twice.where("tile_id = 3").agg(F.max("rank")).first()[0] == 2 * sum(i == 3 for i, _ in want)


def test_neighbours_and_conflicts_come_once_without_an_exchange_of_pairs(spark):
    rng = np.random.default_rng(2)
    tiles, t = rects(spark, rng, 80, "tile_id", 0.4)
    pad = 100 / joins.M_PER_DEG
    want = {(i, j) for i, w, s, e, n in tiles for j, w2, s2, e2, n2 in tiles if i != j and e + pad >= w2 and w - pad <= e2 and n + pad >= s2 and s - pad <= n2}
    out = joins.tile_neighbours(t)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert exchanges_above(out, "Join") == 0
    moved = t.where("tile_id < 40").withColumns({"west": F.col("west") + 0.01, "east": F.col("east") + 0.01})
    again = [tuple(r) for r in joins.tile_neighbours(t.unionByName(t).unionByName(moved)).collect()]
    assert len(again) == len(set(again)) and want <= set(again)
    regions = t.select(F.col("tile_id").alias("region_id"), F.when(F.col("tile_id") % 2 == 0, "test").otherwise("development").alias("split"), "west", "south", "east", "north")
    conflicts = evaluate.region_conflicts(regions, 0.3)
    assert exchanges_above(conflicts, "Join") == 0
    want = set()
    for i, w, s, e, n in tiles:
        for j, w2, s2, e2, n2 in tiles:
            d = np.hypot(max(w - e2, w2 - e, 0), max(s - n2, s2 - n, 0))
            if i < j and (d == 0 or (i % 2 != j % 2 and d < 0.3)):
                want.add((i, j, "overlap" if d == 0 else "split_buffer"))
    got = [(r.region_id, r.other_id, r.conflict) for r in conflicts.collect()]
    assert len(got) == len(want) and set(got) == want


def above_join(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].split("Join")[0]


def crowd(spark, rng, n, key, most, prefix=None):
    """Rectangles in one small place, some equal, some twice as wide, with ids out of order."""
    at, ids = rng.integers(0, 40, (n, 2)) / 1e3, rng.permutation(n)
    rows = [(f"{prefix}{k}" if prefix else int(k), x, y, x + w, y + w) for k, (x, y), w in zip(ids, at.tolist(), (most * rng.integers(1, 3, n)).tolist())]
    return rows, spark.createDataFrame(rows, f"{key} {'string' if prefix else 'long'}, west double, south double, east double, north double")


def ranks(tiles, dems):
    want = {}
    for i, w, s, e, n in tiles:
        over = [(-(min(e, e2) - max(w, w2)) * (min(n, n2) - max(s, s2)), j) for j, w2, s2, e2, n2 in dems if e > w2 and w < e2 and n > s2 and s < n2]
        want |= {(i, j): (k, -o) for k, (o, j) in enumerate(sorted(over), 1)}
    return want


def test_crowded_dems_are_ranked_by_a_kernel(spark, monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(kernels, "CHUNK", 50, raising=False)
    tiles, t = crowd(spark, rng, 120, "tile_id", 0.0107)
    dems, d = crowd(spark, rng, 90, "dem_id", 0.0213, "dem")
    nowhere = spark.createDataFrame([(500, None, 0.0, 0.01, 0.01), (501, 0.0, 0.0, None, 0.01)], t.schema)
    out = joins.all_dems(t.unionByName(nowhere), d.unionByName(spark.createDataFrame([("dem500", 0.0, 0.0, 0.02, None)], d.schema)))
    assert {(r.tile_id, r.dem_id): (r.rank, r.overlap) for r in out.collect()} == ranks(tiles, dems)
    assert "MapInArrow" in above_join(out) and "lambdafunction" not in above_join(out)  # not one value at a time, for each tile and all DEMs of its cell
    rounded = spark.createDataFrame([(x,) for x in [0.0000000005, 1.5e-9, 2.5e-9, -2.5e-9, 3.4e-10, 0.000114490123456, 1234.0000000015, 3e12, None]], "x double").select(rnd("x", 9).alias("a"), rnd_many("x", 9).alias("b")).collect()
    assert [r.a for r in rounded] == [r.b for r in rounded]


def written(plan):
    """Rows written by the exchanges of a plan that has run."""
    name, of = plan.getClass().getSimpleName(), lambda x: written(x)
    if name == "AdaptiveSparkPlanExec":
        return of(plan.executedPlan())
    if name == "ShuffleQueryStageExec":
        return of(plan.plan())
    here = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return here + sum(of(plan.children().apply(k)) for k in range(plan.children().length()))


def test_crowded_neighbours_are_exchanged_in_few_copies(spark, monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(kernels, "CHUNK", 40, raising=False)
    tiles, t = crowd(spark, rng, 150, "tile_id", 0.0107)
    pad = 100 / joins.M_PER_DEG
    want = {(i, j) for i, w, s, e, n in tiles for j, w2, s2, e2, n2 in tiles if i != j and e + pad >= w2 and w - pad <= e2 and n + pad >= s2 and s - pad <= n2}
    lost = spark.createDataFrame([(None, 0.01, 0.01, 0.02, 0.02), (900, None, 0.0, 0.01, 0.01), (901, 0.0, 0.0, 0.01, None)], t.schema)
    got = [tuple(r) for r in joins.tile_neighbours(t.unionByName(lost)).collect()]
    assert len(got) == len(want) and set(got) == want
    at = rng.uniform(0, 1, (3000, 2))
    wide = spark.createDataFrame([(k, x, y, x + 0.0107, y + 0.0107) for k, (x, y) in enumerate(at.tolist())], t.schema)
    out = joins.tile_neighbours(wide)
    assert len(out.collect()) > 3000
    assert written(out._jdf.queryExecution().executedPlan()) < 2 * 3000


def test_keys_that_come_twice_are_found(spark):
    ids = lambda *rows, kind="long": spark.createDataFrame([(r,) for r in rows], f"k {kind}")
    assert joins.repeated(ids(0, 1, 63, 64, -1, -64, 2**62, None), "k") is None
    assert [r[0] for r in joins.repeated(ids(0, 1, 63, 64, 63, None), "k").collect()] == [63]
    assert [r[0] for r in joins.repeated(ids(0, None, None), "k").collect()] == [None]
    assert joins.repeated(ids("a", "b", kind="string"), "k") is None
    assert [r[0] for r in joins.repeated(ids("a", "b", "a", kind="string"), "k").collect()] == ["a"]


def test_the_best_dem_is_found_without_testing_all(spark, monkeypatch):
    rng = np.random.default_rng(13)
    monkeypatch.setattr(kernels, "CHUNK", 50, raising=False)
    tiles, t = crowd(spark, rng, 120, "tile_id", 0.0107)
    dems, d = crowd(spark, rng, 400, "dem_id", 0.0213, "dem")
    best = joins.best_dem(t.unionByName(t), d)  # rows of one id give one row
    want = {k: v for k, v in ranks(tiles, dems).items() if v[0] == 1}
    assert sorted((r.tile_id, r.dem_id, r.overlap) for r in best.collect()) == sorted((i, j, v[1]) for (i, j), v in want.items())
    assert "lambdafunction" not in above_join(best)
    a, b = (np.concatenate([x, x + w]) for x, w in ((rng.uniform(0, 0.01, (2, 4000)), 0.01), (rng.uniform(-0.01, 0.01, (2, 4000)), 0.02)))
    monkeypatch.setattr(kernels, "TESTS", 64)
    tests = lambda best: sum(i.size * j.size for i, j in kernels.near(a, b, best))
    assert tests(True) < tests(False) / 20
    turned = b[[2, 1, 0, 3]]  # west and east the other way round: overlap below zero, nothing is left out on its account
    assert {(x, y) for i, j in kernels.near(a[:, :9], turned[:, :9], best=True) for x in i for y in j} >= {(x, y) for x in range(9) for y in range(9) if a[2, x] > turned[0, y] and a[0, x] < turned[2, y]}


def test_sources_on_one_grid_are_sampled_as_one(spark, monkeypatch):
    cells = [(f"s{k}", r, c, float(100 * k + 10 * r + c)) for k in range(30) for r in range(4) for c in range(4) if (r + c + k) % 3]
    surface = spark.createDataFrame(cells, "source_id string, row long, col long, z double")
    survey = spark.createDataFrame([(f"s{k}", 32617, 0.0, 4.0, 1.0, 1.0, float(k % 2), f"p{k:02d}") for k in range(30)],
                                   "source_id string, epsg int, x0 double, y0 double, dx double, dy double, resolution_m double, path string")
    points = spark.createDataFrame([(4 * r + c, c + 0.5, 3.5 - r, 32617) for r in range(4) for c in range(4)] + [(99, 9.0, 9.0, 32617)], "id int, x double, y double, epsg int")
    boxes, keep = [], joins.cut_lineage
    monkeypatch.setattr(joins, "cut_lineage", lambda df: boxes.append(keep(df)) or boxes[-1])
    got = {r.id: r.source for r in joins.sample_nearest(points, surface, survey, "id").collect()}
    assert boxes[0].count() == 1  # a point meets one grid, not thirty sources
    order = sorted(range(30), key=lambda k: (k % 2, f"p{k:02d}"))
    assert got == {4 * r + c: next(f"s{k}" for k in order if (r + c + k) % 3) for r in range(4) for c in range(4)} | {99: None}


def test_crowded_squares_are_joined_without_pairs_of_points(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.uniform(0, 30, (3000, 2)), rng.uniform(60, 70, (40, 2)), [[300.0, 0.0], [303.9, 0.0], [310.0, 0.0]]]).round(2)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    parent = list(range(len(xy)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(xy)):
        for j in np.flatnonzero(np.sqrt(((xy - xy[i]) ** 2).sum(1)) <= 4.0):
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    want = {i: root(i) for i in range(len(xy))}
    for brute in (4096, 1):
        assert {r.id: r.cluster_id for r in eps_clusters(df, 4.0, brute=brute).collect()} == want


def test_points_in_crowded_rectangles_come_once(spark):
    rng = np.random.default_rng(5)
    boxes, b = rects(spark, rng, 300, "id", 0.02, 0.1)
    xy = rng.uniform(0, 0.12, (400, 2)).round(4)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(-1, None, 0.05)], "cand_id long, lon double, lat double")
    want = {i for i, (x, y) in enumerate(xy) if any(w < x < e and s < y < n for _, w, s, e, n in boxes)}
    got = [r.cand_id for r in joins.in_any_rect(points, b.unionByName(b), 0.05).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.cand_id for r in filters.exclude_buildings(points, b).collect()} == {-1, *range(400)} - want


def test_a_box_model_gets_few_patches_at_once(spark, monkeypatch):
    monkeypatch.setattr(learn, "BATCH_CELLS", 40)
    seen = []

    def model(batches):
        for pdf in batches:
            seen.append(pdf["cells"].map(len).tolist())
            yield pd.DataFrame({"survey_id": pdf["survey_id"], "patch_row": pdf["patch_row"], "patch_col": 0, "x0": 0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "score": 1.0, "class_id": 1})

    cells = pa.array([[{"row": 0, "col": k, "z": 0.5} for k in range(n)] for n in (16, 16, 16, 50, 8, 16)])
    batch = pa.record_batch({"survey_id": pa.array(["s"] * 6), "patch_row": pa.array(range(6)), "patch_col": pa.array([0] * 6), "cells": cells})
    out = pa.Table.from_batches(learn._by_few(model)([batch.slice(0, 4), batch.slice(4)]))
    assert seen == [[16, 16], [16], [50], [8, 16]] and out["patch_row"].to_pylist() == list(range(6)) and out.schema == learn.FOUND


def test_dense_assignment_and_crowded_labels(spark):
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(50):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        c = rng.uniform(0, 9, (n, m))
        assert c[np.arange(n), evaluate.assign_dense(c)].sum() == pytest.approx(min(sum(c[i, q[i]] for i in range(n)) for q in itertools.permutations(range(m), n)))
    spots = rng.uniform(0, 30, (12, 2)).round(0)
    labels = [(i, float(spots[i % 12][0]), float(spots[i % 12][1])) for i in range(40)]  # several labels share a place
    preds = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 30, (150, 2)).round(1))]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} long, x double, y double")
    got = evaluate.match_points(table(preds, "prediction_id"), table(labels, "label_id"), 5.0).collect()
    edges = [(i, j, float(np.hypot(x - x2, y - y2))) for i, x, y in preds for j, x2, y2 in labels if np.hypot(x - x2, y - y2) <= 5.0]
    left, right = (np.unique([q[k] for q in edges], return_inverse=True)[1] for k in (0, 1))
    cost = np.array([q[2] for q in edges])
    best = evaluate.assign_pairs(left, right, cost)
    assert len(got) == len(best) == len({r.prediction_id for r in got}) == len({r.label_id for r in got})
    assert sum(r.distance_m for r in got) == pytest.approx(cost[best].sum())


def test_area_of_discs_by_runs_equals_their_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    spots = rng.uniform(-5, 60, (40, 2)).round(2)
    unsure = spark.createDataFrame([("r", "a", float(x), float(y)) for x, y in spots], "region_id string, family string, x double, y double")
    region = spark.createDataFrame([("r", "a", 0.0, 0.0, 50.0, 40.0), ("q", "a", 0.0, 0.0, 5.0, 5.0)], "region_id string, family string, west double, south double, east double, north double")
    for tol, step in ((8.0, 1.0), (5.0, 2.0)):
        cells = {(gx, gy) for gx in range(-30, 90) for gy in range(-30, 90) if 0 <= (gx + 0.5) * step <= 50 and 0 <= (gy + 0.5) * step <= 40
                 and (((gx + 0.5) * step - spots[:, 0]) ** 2 + ((gy + 0.5) * step - spots[:, 1]) ** 2 <= tol * tol).any()}
        got = {r.region_id: r.area_m2 for r in evaluate.reviewed_area(region, unsure, tol, step).collect()}
        assert got == {"r": 2000.0 - len(cells) * step * step, "q": 25.0}


def test_forest_reads_its_rows_twice_at_most(spark):
    reads = spark.sparkContext.accumulator(0)

    def noted(batches):
        for pdf in batches:
            reads.add(len(pdf))
            yield pdf

    rng = np.random.default_rng(8)
    rows = [(*map(float, rng.uniform(0, 1, len(learn.FEATURES))), float(i % 2)) for i in range(60)]
    schema = ", ".join(f"{c} double" for c in learn.FEATURES) + ", label double"
    _, metrics = learn.train_forest(spark.createDataFrame(rows, schema).mapInPandas(noted, schema), trees=3, depth=3, folds=2)
    assert reads.value <= 120 and set(metrics["importances"]) == set(learn.FEATURES)


def test_cover_is_settled_early_and_still_exact(spark):
    regions = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0), (3, 0.0, 0.0, 10.0, 10.0), (4, 0.0, 0.0, 0.0, 10.0), (5, None, 0.0, 1.0, 1.0), (6, 0.0, 0.0, 1.0, 1.0)],
                                    "region_id int, west double, south double, east double, north double")
    prints = spark.createDataFrame([(1, -1.0, -1.0, 11.0, 11.0), (2, 0.0, 0.0, 6.0, 10.0), (2, 6.0, 0.0, 10.0, 10.0), (3, 0.0, 0.0, 6.1, 10.0), (3, 6.2, 0.0, 10.0, 10.0), (4, -1.0, 0.0, 1.0, 5.0), (4, -1.0, 5.0, 1.0, 10.0)],
                                   "region_id int, west double, south double, east double, north double")
    assert {r.region_id for r in evaluate.uncovered_regions(regions, prints).collect()} == {3, 5, 6}


def test_long_batches_are_encoded_in_runs(monkeypatch):
    from fellscan.llm import piece_dropout

    monkeypatch.setattr(piece_dropout, "_CHARACTERS", 10)
    pdf = pd.DataFrame({"text": ["aaaa", "bbbb", "", "cc", "d" * 30, "ee", "f"]})
    runs = [p["text"].tolist() for p in piece_dropout.by_characters([pdf, pdf.iloc[:0], pdf.iloc[5:]])]
    assert runs == [["aaaa", "bbbb", "", "cc"], ["d" * 30], ["ee", "f"], ["ee", "f"]]

import itertools

import numpy as np
from pyspark.sql import functions as F

from fellscan.functions import geodesy
from fellscan.operators import evaluate, measure, reports
from fellscan.sources import cells, feeds, sinks
from fellscan.streaming import folds


def brute_match(edges):
    """Best assignment by trying every subset of edges (small cases)."""
    best = (0, 0.0)
    for k in range(len(edges), 0, -1):
        for pick in itertools.combinations(edges, k):
            if len({e[0] for e in pick}) == k and len({e[1] for e in pick}) == k:
                cost = -sum(e[2] for e in pick)
                best = max(best, (k, cost))
        if best[0] == k:
            return best
    return best


def test_assignment_is_optimal():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 4, (8, 2))})
        cost = np.round(rng.uniform(0, 10, len(pairs)), 3)
        left, right = (np.unique([p[i] for p in pairs], return_inverse=True)[1] for i in (0, 1))
        got = evaluate.assign_pairs(left, right, cost)
        k, c = brute_match([(p[0], p[1], w) for p, w in zip(pairs, cost)])
        assert len({left[i] for i in got}) == len(got) == len({right[i] for i in got}) == k
        assert abs(sum(cost[i] for i in got) + c) < 1e-9


def test_scoring_counts_hits_duplicates_misses_and_exclusions(spark):
    r = "region_id string, ord int, independence_group string, split string, west double, south double, east double, north double"
    m = {
        "regions": spark.createDataFrame([("r1", 1, "g", "test", 0.0, 0.0, 1000.0, 1000.0), ("r2", 2, "h", "test", 2000.0, 0.0, 3000.0, 1000.0)], r),
        "region_reviews": spark.createDataFrame([("r1", "mound", "exhaustive"), ("r2", "mound", "partial")], "region_id string, family string, completeness string"),
        "labels": spark.createDataFrame([(1, "r1", "mound", "Point", 100.0, 100.0), (2, "r1", "mound", "Point", 500.0, 500.0), (3, "r1", "mound", "Point", 900.0, 900.0), (4, "r2", "mound", "Point", 2100.0, 100.0)],
                                        "label_id bigint, region_id string, family string, geometry_type string, x double, y double"),
        "label_reviews": spark.createDataFrame([(1, 1, "present"), (2, 1, "present"), (3, 1, "uncertain"), (4, 1, "present")], "label_id bigint, revision int, status string"),
    }
    preds = spark.createDataFrame([(1, "mound", 103.0, 100.0), (2, "mound", 98.0, 100.0), (3, "mound", 300.0, 300.0), (4, "mound", 905.0, 900.0), (5, "mound", 2100.0, 100.0)], "prediction_id bigint, family string, x double, y double")
    out = evaluate.score_points(m, preds, "test", 10.0, 0.5)
    row = out["families"].first()
    assert (row.true_positives, row.false_positives, row.false_negatives) == (1, 2, 1)
    assert abs(row.reviewed_area_km2 - (1e6 - np.pi * 100) / 1e6) < 4e-6  # a half-metre lattice is good to a few square metres on this disc
    assert {x.prediction_id: x.duplicate for x in out["false_positives"].collect()} == {1: True, 3: False}
    assert sorted((x.prediction_id, x.reason) for x in out["excluded_predictions"].collect()) == [(4, "unresolved_label_neighborhood"), (5, "region_not_exhaustively_reviewed")]
    assert [x.label_id for x in out["excluded_labels"].collect()] == [4]


def test_cover_by_footprints_is_exact(spark):
    rng = np.random.default_rng(11)
    regions, prints, want = [], [], set()
    for k in range(120):
        w, s, e, n = 2, 3, 2 + int(rng.integers(1, 12)), 3 + int(rng.integers(1, 12))
        regions.append((k, float(w), float(s), float(e), float(n)))
        seen = np.zeros((40, 40), bool)
        for _ in range(int(rng.integers(0, 14))):
            a, b = (int(v) for v in rng.integers(0, 10, 2))
            c, d = a + int(rng.integers(0, 10)), b + int(rng.integers(0, 10))
            prints.append((k, float(a), float(b), float(c), float(d)))
            seen[a:c, b:d] = True
        if not seen[w:e, s:n].all():
            want.add(k)
    regions += [(200, 0.0, 0.0, 10.0, 10.0), (201, 0.0, 0.0, 10.0, 10.0), (202, 5.0, 0.0, 5.0, 10.0), (203, 5.0, 0.0, 5.0, 10.0), (204, None, 0.0, 5.0, 10.0), (205, 0.0, 0.0, 1.0, 1.0)]
    # a slit of a thousandth, which no lattice of points meets; the same without the slit; lines; unknown bounds
    prints += [(200, 0.0, 0.0, 4.3331, 10.0), (200, 4.3341, 0.0, 10.0, 10.0), (201, 0.0, 0.0, 4.333, 10.0), (201, 4.333, 0.0, 10.0, 10.0), (202, 0.0, 0.0, 5.0, 10.0),
               (203, 0.0, 0.0, 5.0, 4.0), (203, 5.0, 5.0, 7.0, 10.0), (204, 0.0, 0.0, 9.0, 99.0), (205, None, 0.0, 1.0, 1.0)]
    want |= {200, 203, 204, 205}
    cols = "region_id bigint, west double, south double, east double, north double"
    got = [r.region_id for r in evaluate.uncovered_regions(spark.createDataFrame(regions, cols), spark.createDataFrame(prints + prints[:5], cols)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 5 < len(want) < 120
    assert evaluate.uncovered_regions(spark.createDataFrame([], cols), spark.createDataFrame(prints, cols)).count() == 0


def test_jobs_end_once_and_progress_never_falls(spark):
    rows = [("a", 1, "2024-01-01 00:00:01", "running", 10, "s1"), ("a", 2, "2024-01-01 00:00:02", "running", 60, "s2"), ("a", 3, "2024-01-01 00:00:03", "running", 40, None),
            ("a", 4, "2024-01-01 00:00:04", "cancelled", 50, None), ("a", 5, "2024-01-01 00:00:05", "completed", 100, "late"), ("b", 1, "2024-01-01 00:00:01", "running", 250, "s1")]
    ev = spark.createDataFrame(rows, "job_id string, seq bigint, ts string, status string, progress int, stage string").withColumn("ts", F.to_timestamp("ts"))
    out = {r.job_id: r for r in folds.fold_jobs(ev).collect()}
    assert (out["a"].status, out["a"].progress, out["a"].stage) == ("cancelled", 60, "s2") and out["b"].progress == 100
    assert sorted(r.seq for r in folds.fence(ev.where("job_id = 'a'"), folds.fold_jobs(ev)).collect()) == [1, 2, 3, 4]


def test_stream_of_jobs_equals_the_batch(spark, tmp_path):
    rows = [(f"j{i % 3}", i, f"2024-01-01 00:00:{i:02d}", "failed" if i == 17 else "running", (i * 7) % 130, f"s{i}") for i in range(24)]
    ev = spark.createDataFrame(rows, "job_id string, seq bigint, ts string, status string, progress int, stage string").withColumn("ts", F.to_timestamp("ts"))
    for part in range(3):
        ev.where(f"seq >= {part * 8} AND seq < {part * 8 + 8}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = folds.fold_jobs_stream(spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    got = {}

    def keep(batch, _):
        got.update({r.job_id: (r.status, r.progress, r.stage) for r in batch.collect()})

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert got == {r.job_id: (r.status, r.progress, r.stage) for r in folds.fold_jobs(ev).collect()}


def test_timed_stream_of_jobs_equals_the_batch_and_forgets_ended_ones(spark, tmp_path):
    cols = "job_id string, seq bigint, ts string, status string, progress int, stage string, summary map<string,string>, message string"
    at = lambda i: f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00"
    rows = [("a", 1, at(1), "running", 5, "load", None, None), ("a", 2, at(2), "running", None, "", {"n": "1", "stage": "own"}, None), ("a", 3, at(3), "running", 300, "fuse", None, None),
            ("a", 4, at(9), "failed", 20, None, None, "no space"), ("b", 1, at(1), "pending", 0, None, None, None), ("b", 2, at(10), "completed", 100, "ignored", {"n": "7"}, "fine"),
            ("c", 1, at(2), "running", 1, None, None, None), ("d", 1, at(3), "failed", None, None, None, None),
            ("a", 5, at(15), "running", 99, "late", {"n": "9"}, "late"), ("c", 2, at(16), "running", 2, "load", None, None), ("c", 3, at(300), "running", 3, None, {"m": None}, None), ("c", 4, at(301), "running", 3, None, None, None)]
    ev = spark.createDataFrame(rows, cols).withColumn("ts", F.to_timestamp("ts"))
    for k, part in enumerate((rows[:8], rows[8:10], rows[10:11], rows[11:])):
        spark.createDataFrame(part, cols).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = folds.fold_jobs_stream(spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "1 hour")
    got = {}

    def keep(batch, _):
        got.update({r.job_id: r for r in batch.collect()})

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.job_id: r for r in folds.fold_jobs(ev).select(*stream.columns).collect()}
    assert got == want
    assert want["a"].result_summary == {"n": "1", "stage": "fuse"} and want["a"].error_message == "no space" and want["a"].progress == 100
    assert want["b"].result_summary == {"n": "7"} and want["b"].error_message is None and want["d"].error_message == "" and want["d"].progress is None
    assert want["c"].result_summary == {"m": None}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) == 4 and held[-1] == 1  # only the running job is still known


def test_retention_evicts_by_age_then_only_as_far_as_the_cap_needs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"/p/{i}", int(rng.integers(1, 50)), int(rng.integers(0, 12))) for i in range(300)]
    files = spark.createDataFrame(rows, "file_id bigint, path string, size_bytes bigint, age_days int")
    out = reports.retention_plan(files, 9, 3000).collect()
    old = {r.file_id for r in out if r.evict == "age"}
    assert old == {r[0] for r in rows if r[3] > 9}
    cap = [r for r in out if r.evict == "cap"]
    left = sum(r.size_bytes for r in out if r.evict is None)
    assert left <= 3000 and left + max(r.size_bytes for r in cap) > 3000
    assert min(r.age_days for r in cap) >= max(r.age_days for r in out if r.evict is None)


def test_retention_by_cap_matches_a_walk_over_sorted_files(spark):
    rng = np.random.default_rng(5)
    ages = rng.choice([0.0, 1.25, 1.2500001, 3.5, 3.75, 9.5], 400)
    rows = [(i, f"/p/{i}", int(rng.integers(0, 50)), None if i % 50 == 0 else float(a)) for i, a in enumerate(ages)]
    files = spark.createDataFrame(rows, "file_id bigint, path string, size_bytes bigint, age_days double")
    size = {r[0]: r[2] for r in rows}
    age = {r[0]: r[3] or 0.0 for r in rows}
    for cap in (0, 1, 500, 3000, sum(s for i, s in size.items() if age[i] <= 9), 10**9):
        got = {r.file_id: r.evict for r in reports.retention_plan(files, 9, cap, buckets=16).collect()}
        assert {i for i, e in got.items() if e == "age"} == {i for i in age if age[i] > 9}
        stay, gone = [i for i in got if got[i] is None], [i for i in got if got[i] == "cap"]
        assert sum(size[i] for i in stay) <= cap
        if gone:  # the last one to go was still needed, and nothing older stays
            youngest = min(age[i] for i in gone)
            assert youngest >= max((age[i] for i in stay), default=0.0)
            assert any(sum(size[j] for j in stay) + size[i] > cap for i in gone if age[i] == youngest)
    assert reports.retention_plan(files.where("file_id < 0"), 9, 100).count() == 0


def test_storage_categories(spark):
    paths = ["/d/raw/a.laz", "/d/x/raw/b.laz", "/d/processed/t_dem.tif", "/d/processed/t/dem.tif", "/d/raw/hillshade.tif", "/d/p/hillshade.png", "/d/p/derivatives/dem.tif", "/d/p/derivatives/svf.tif", "/d/mydem.tif", None]
    out = reports.storage_breakdown(spark.createDataFrame([(p, 1) for p in paths], "path string, size_bytes bigint"), 10, "/d/")
    assert {r.category: r.files for r in out.collect()} == {"raw": 2, "dem": 3, "hillshade": 1, "derivatives": 1, "other": 3}
    none = reports.storage_breakdown(spark.createDataFrame([], "path string, size_bytes bigint"), 10).collect()
    assert len(none) == 5 and all((r.bytes, r.files, r.pct_of_cap) == (0, 0, 0.0) for r in none)


def test_geodesic_round_trip_and_known_values(spark):
    d, az = geodesy.inverse_arrays([0.0, -80.0], [0.0, 40.0], [1.0, -79.0], [0.0, 41.0])
    assert abs(d[0] - 111319.4908) < 1e-3 and abs(az[0] - 90) < 1e-9
    lon, lat = geodesy.direct_arrays([0.0, -80.0], [0.0, 40.0], az, d)
    assert np.allclose(lon, [1.0, -79.0], atol=1e-9) and np.allclose(lat, [0.0, 41.0], atol=1e-9)
    row = spark.range(1).select(*geodesy.utm_forward(F.lit(-81.0), F.lit(0.0), F.lit(17)), *geodesy.utm_forward(F.lit(-80.0), F.lit(40.0), F.lit(17))).first()
    assert abs(row[0] - 500000) < 1e-6 and abs(row[1]) < 1e-6 and abs(row[2] - 585360.4618) < 1e-2 and abs(row[3] - 4428236.0645) < 1e-2
    ring = [(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01), (0.0, 0.0)]
    rings = spark.createDataFrame([(1, ring)], "line_id bigint, points array<struct<lon:double,lat:double>>")
    area = measure.ring_areas(rings).first().area_m2
    assert abs(area / (1113.1949 * 1105.7427) - 1) < 1e-5


def test_profile_is_even_and_keeps_its_ends(spark):
    lines = spark.createDataFrame([(1, [(-80.0, 40.0), (-79.99, 40.0), (-79.99, 40.02)])], "line_id bigint, points array<struct<lon:double,lat:double>>")
    out = measure.profile_points(lines, 201).orderBy("i").collect()
    steps = np.diff([r.distance_m for r in out])
    assert len(out) == 201 and np.allclose(steps, steps[0]) and abs(out[-1].lat - 40.02) < 1e-9 and out[0].lon == -80.0


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = cells.fingerprint(df).first()[0], cells.fingerprint(df.orderBy(F.rand()).repartition(7)).first()[0]
    assert a == b and a != cells.fingerprint(df.union(df.limit(1))).first()[0]


def test_reload_by_source_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "sites")
    mk = lambda rows: spark.createDataFrame(rows, "name string, source string")
    feeds.replace_by_source(mk([("a", "x"), ("b", "y")]), path)
    feeds.replace_by_source(mk([("c", "x")]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("name", "source").collect()) == [("b", "y"), ("c", "x")]


def test_geojson_and_notebook_text(spark):
    f = spark.createDataFrame([("i", "f1", 'a "quoted" title', "Polygon", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])], "investigation_id string, id string, title string, geometry_type string, points array<struct<lon:double,lat:double>>")
    import json

    doc = json.loads(sinks.findings_to_geojson(f).first().value)
    assert doc["id"] == "f1" and doc["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]] and doc["properties"]["title"] == 'a "quoted" title'

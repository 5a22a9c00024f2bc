"""Evaluation, streaming replays, learned detectors and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellscan.operators import evaluate, fill, focal, horizon, learn, pointgrid
from fellscan.plans import survey
from fellscan.plans.registry import get_pass
from fellscan.registered.base import rd, register, rnd
from fellscan.registered.fixtures import ctes, fixture, load
from fellscan.registered.terrain import BLOCK
from fellscan.session import hold, shared_folder
from fellscan.sources.cells import point_cloud
from fellscan.streaming import folds

# Labels from customers, predictions from orders, on a 60 x 60 km plane cut into one region per nation (0 leaves a gap).
FAMILY = "CASE WHEN {k} % 3 = 0 THEN 'sinkhole' WHEN {k} % 3 = 1 THEN 'mound' ELSE 'ridge' END"
REG = """rg AS (SELECT concat('r', CAST(n_nationkey AS VARCHAR)) AS region_id, n_nationkey AS ord, concat('g', CAST(n_nationkey % 12 AS VARCHAR)) AS independence_group, CASE WHEN n_nationkey % 2 = 0 THEN 'test' ELSE 'development' END AS split,
    (n_nationkey % 5) * 12000.0 AS west, (n_nationkey // 5) * 12000.0 AS south, (n_nationkey % 5) * 12000.0 + 11000 AS east, (n_nationkey // 5) * 12000.0 + 11000 AS north FROM nation)"""
LBL = f"""lb AS (SELECT c_custkey AS label_id, c_custkey % 1490 AS feature_id, concat('r', CAST((c_custkey * 7919 % 60000) // 12000 + 5 * ((c_custkey * 104729 % 60000) // 12000) AS VARCHAR)) AS region_id, {FAMILY.format(k='c_custkey')} AS family,
    'Point' AS geometry_type, CAST(c_custkey * 7919 % 60000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 60000 AS DOUBLE) AS y, CASE WHEN c_custkey % 11 = 0 THEN 'uncertain' WHEN c_custkey % 7 = 0 THEN 'absent' ELSE 'present' END AS status FROM customer)"""
PRD = f"""pd AS (SELECT o_orderkey AS prediction_id, {FAMILY.format(k='o_custkey')} AS family, CAST(o_custkey * 7919 % 60000 + o_orderkey % 90 - 45 AS DOUBLE) AS x, CAST(o_custkey * 104729 % 60000 + o_orderkey % 70 - 35 AS DOUBLE) AS y, (o_orderkey % 100) / 1e2 AS score FROM orders)"""


def family(k):
    return F.when(k % 3 == 0, "sinkhole").when(k % 3 == 1, "mound").otherwise("ridge")


def manifest(spark, sf):
    n, c = load(spark, sf, "nation"), load(spark, sf, "customer")
    k, i = F.col("c_custkey"), F.col("n_nationkey")
    west, south = (i % 5) * F.lit(12000.0), F.expr("n_nationkey DIV 5") * F.lit(12000.0)
    regions = n.select(F.concat(F.lit("r"), i).alias("region_id"), i.alias("ord"), F.concat(F.lit("g"), i % 12).alias("independence_group"), F.when(i % 2 == 0, "test").otherwise("development").alias("split"),
                       west.alias("west"), south.alias("south"), (west + 11000).alias("east"), (south + 11000).alias("north"))
    x, y = k * 7919 % 60000, k * 104729 % 60000
    labels = c.select(k.alias("label_id"), (k % 1490).alias("feature_id"), F.concat(F.lit("r"), F.floor(x / 12000) + 5 * F.floor(y / 12000)).alias("region_id"), family(k).alias("family"), F.lit("Point").alias("geometry_type"),
                      x.cast("double").alias("x"), y.cast("double").alias("y"))
    status = F.when(k % 11 == 0, "uncertain").when(k % 7 == 0, "absent").otherwise("present")
    first = c.select(k.alias("label_id"), F.lit(1).alias("revision"), F.lit("uncertain").alias("status"), F.lit("2024-01-01").cast("date").alias("reviewed_on"))
    second = c.select(k.alias("label_id"), F.when(k % 97 == 0, 3).otherwise(2).alias("revision"), status.alias("status"), F.lit("2024-02-01").cast("date").alias("reviewed_on"))
    fam = F.explode(F.array(*[F.lit(f) for f in ("sinkhole", "mound", "ridge")]))
    reviews = n.select(F.concat(F.lit("r"), i).alias("region_id"), fam.alias("family"), F.when(i % 5 == 4, "partial").otherwise("exhaustive").alias("completeness"))
    surveys = n.select(F.concat(F.lit("s"), i).alias("survey_id"), (west - 500).alias("west"), (south - 500).alias("south"), (west + F.when(i % 9 == 4, 9000).otherwise(12000)).alias("east"), (south + 12000).alias("north"))
    links = n.select(F.concat(F.lit("r"), i).alias("region_id"), F.when(i == 7, "missing").otherwise(F.concat(F.lit("s"), i)).alias("survey_id"))
    protocol = n.where("n_nationkey = 0").select(F.lit(32617).alias("evaluation_epsg"), F.lit("synthetic").alias("dataset_id"), F.lit("1").alias("dataset_version"))
    return {"protocol": protocol, "surveys": surveys, "regions": regions, "region_surveys": links, "region_reviews": reviews, "labels": labels, "label_reviews": first.unionByName(second)}


def predictions(spark, sf):
    o = load(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("prediction_id"), family(c).alias("family"), (c * 7919 % 60000 + k % 90 - 45).cast("double").alias("x"), (c * 104729 % 60000 + k % 70 - 35).cast("double").alias("y"), (k % 100 / F.lit(1e2)).alias("score"))


@register("j9_assign_region", f"WITH {REG}, {PRD} SELECT prediction_id, region_id FROM (SELECT p.prediction_id, r.region_id, row_number() OVER (PARTITION BY p.prediction_id ORDER BY r.ord) AS k FROM pd p LEFT JOIN rg r ON p.x BETWEEN r.west AND r.east AND p.y BETWEEN r.south AND r.north) q WHERE k = 1")
def _j9(spark, sf):
    return evaluate.assign_region(predictions(spark, sf), manifest(spark, sf)["regions"], "prediction_id", 6000).select("prediction_id", "region_id")


@register("j9_outside_regions", f"WITH {REG}, {PRD} SELECT prediction_id FROM pd p WHERE NOT EXISTS (SELECT 1 FROM rg r WHERE p.x BETWEEN r.west AND r.east AND p.y BETWEEN r.south AND r.north)")
def _j9o(spark, sf):
    return evaluate.outside_regions(predictions(spark, sf), manifest(spark, sf)["regions"], "prediction_id")


CLOSE = "p.family = l.family AND p.x BETWEEN l.x - 40 AND l.x + 40 AND sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) <= 40"


@register("j10_match_points", f"""WITH {LBL}, {PRD}, e AS MATERIALIZED (SELECT prediction_id, label_id FROM pd p JOIN lb l ON {CLOSE}) SELECT count(DISTINCT label_id) AS matched_labels, count(DISTINCT label_id) AS pairs FROM e""")
def _j10(spark, sf):
    """Labels lie further apart than twice the tolerance here, so each label with any near prediction takes exactly one."""
    pairs = evaluate.match_points(predictions(spark, sf), manifest(spark, sf)["labels"], 40.0, ["family"])
    return pairs.agg(F.countDistinct("label_id").alias("matched_labels"), F.count("*").alias("pairs"))


@register("j10_match_pairs")
def _j10p(spark, sf):
    return evaluate.match_points(predictions(spark, sf), manifest(spark, sf)["labels"], 40.0, ["family"]).withColumn("distance_m", rnd("distance_m"))


NEAREST = f"""e AS MATERIALIZED (SELECT prediction_id, label_id, sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) AS d FROM pd p JOIN lb l ON {CLOSE}),
    m AS (SELECT prediction_id, label_id FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY d, prediction_id) AS k FROM e) q WHERE k = 1)"""


def nearest_pairs(spark, sf):
    """One prediction per label by distance: a fixed pairing both engines state alike, to test what follows from pairs."""
    from fellscan.operators.joins import within_distance

    p, lab = predictions(spark, sf).select("prediction_id", "x", "y", "family"), manifest(spark, sf)["labels"].select("label_id", "x", "y", "family")
    near = within_distance(p, lab, 40.0, "metric", "x", "y", "x", "y", keys=["family"])
    best = near.groupBy(F.col("b_label_id").alias("label_id")).agg(F.min(F.struct("distance_m", "a_prediction_id")).alias("m"))
    return best.select("label_id", F.col("m.a_prediction_id").alias("prediction_id"))


@register("j19_unmatched", f"WITH {LBL}, {PRD}, {NEAREST} SELECT p.prediction_id, p.prediction_id IN (SELECT prediction_id FROM e) AS duplicate FROM pd p WHERE p.prediction_id NOT IN (SELECT prediction_id FROM m)")
def _j19(spark, sf):
    out = evaluate.unmatched(predictions(spark, sf), manifest(spark, sf)["labels"], nearest_pairs(spark, sf), 40.0, ["family"])
    return out.select("prediction_id", "duplicate")


@register("u4_missed", f"WITH {LBL}, {PRD}, {NEAREST} SELECT label_id FROM lb WHERE label_id NOT IN (SELECT label_id FROM m)")
def _u4(spark, sf):
    return evaluate.missed(manifest(spark, sf)["labels"], nearest_pairs(spark, sf)).select("label_id")


@register("g9_scorecard", f"""WITH {REG}, {LBL}, {PRD}, {NEAREST}, f AS (SELECT DISTINCT family FROM pd), a AS (SELECT sum((east - west) * (north - south)) AS a FROM rg),
    c AS (SELECT family, (SELECT count(*) FROM m JOIN lb USING (label_id) WHERE lb.family = f.family) AS tp, (SELECT count(*) FROM lb WHERE lb.family = f.family AND label_id NOT IN (SELECT label_id FROM m)) AS fn,
      (SELECT count(*) FROM pd WHERE pd.family = f.family AND prediction_id NOT IN (SELECT prediction_id FROM m)) AS fp FROM f)
    SELECT family, tp AS true_positives, fp AS false_positives, fn AS false_negatives, {rd('CAST(tp AS DOUBLE) / (tp + fp)')} AS precision, {rd('CAST(tp AS DOUBLE) / (tp + fn)')} AS recall, {rd('a / 1e6')} AS reviewed_area_km2,
      {rd('fp / (a / 1e6)')} AS false_positives_per_km2, 'scored' AS status FROM c, a""")
def _g9(spark, sf):
    m = manifest(spark, sf)
    preds, pairs = predictions(spark, sf), nearest_pairs(spark, sf)
    fam = F.explode(F.array(*[F.lit(f) for f in ("sinkhole", "mound", "ridge")]))
    area = m["regions"].select(fam.alias("family"), ((F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))).alias("area_m2"))
    named = pairs.join(m["labels"].select("label_id", "family"), "label_id")
    out = evaluate.scorecard(named, evaluate.missed(m["labels"], pairs), evaluate.unmatched(preds, m["labels"], pairs, 40.0, ["family"]), area, preds)
    return out.withColumns({c: rnd(c) for c in ("precision", "recall", "reviewed_area_km2", "false_positives_per_km2")})


@register("e2_exclusion_zones", f"WITH {LBL}, {PRD} SELECT prediction_id, EXISTS (SELECT 1 FROM lb l WHERE l.status = 'uncertain' AND {CLOSE}) AS excluded FROM pd p")
def _e2(spark, sf):
    m = manifest(spark, sf)
    unsure = m["labels"].join(folds.latest_review(m["label_reviews"]).where("status = 'uncertain'"), "label_id")
    return evaluate.exclusion_zones(predictions(spark, sf), unsure, 40.0, "prediction_id", ["family"]).select("prediction_id", "excluded")


@register("t9_latest_review", f"WITH {LBL} SELECT label_id, status, CAST(CASE WHEN label_id % 97 = 0 THEN 3 ELSE 2 END AS INT) AS revision FROM lb")
def _t9(spark, sf):
    return folds.latest_review(manifest(spark, sf)["label_reviews"])


@register("t9_review_order", f"WITH {LBL} SELECT label_id FROM lb WHERE label_id % 97 = 0")
def _t9o(spark, sf):
    return folds.consecutive_revisions(manifest(spark, sf)["label_reviews"])


@register("j20_coincident_labels", """WITH c AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment, c_custkey % 40 AS x, c_custkey % 30 AS y FROM customer)
    SELECT c_nationkey AS region_id, c_mktsegment AS family, x, y, count(*) AS n, min(id) AS first_label FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def _j20(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("label_id"), F.col("c_nationkey").alias("region_id"), F.col("c_mktsegment").alias("family"), F.lit("Point").alias("geometry_type"), (F.col("c_custkey") % 40).alias("x"), (F.col("c_custkey") % 30).alias("y"))
    return evaluate.coincident_labels(c).drop("geometry_type")


CONFLICT = """ra AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'development' END AS split, CAST(p_partkey * 131 % 20000 AS DOUBLE) AS w, CAST(p_partkey * 733 % 20000 AS DOUBLE) AS s, CAST(p_partkey * 131 % 20000 + 60 AS DOUBLE) AS e, CAST(p_partkey * 733 % 20000 + 60 AS DOUBLE) AS n FROM part),
    pr AS (SELECT a.id AS region_id, b.id AS other_id, a.split AS sa, b.split AS sb, sqrt(pow(greatest(a.w - b.e, b.w - a.e, 0), 2) + pow(greatest(a.s - b.n, b.s - a.n, 0), 2)) AS d FROM ra a JOIN ra b ON a.id < b.id AND abs(a.w - b.w) <= 160 AND abs(a.s - b.s) <= 160)"""


@register("j21_region_conflicts", f"WITH {CONFLICT} SELECT region_id, other_id, CASE WHEN d = 0 THEN 'overlap' ELSE 'split_buffer' END AS conflict, {rd('d')} AS distance_m FROM pr WHERE d = 0 OR (sa <> sb AND d < 100)")
def _j21(spark, sf):
    p = load(spark, sf, "part")
    w, s = (F.col("p_partkey") * 131 % 20000).cast("double"), (F.col("p_partkey") * 733 % 20000).cast("double")
    r = p.select(F.col("p_partkey").alias("region_id"), F.when(F.col("p_size") % 2 == 0, "test").otherwise("development").alias("split"), w.alias("west"), s.alias("south"), (w + 60).alias("east"), (s + 60).alias("north"))
    return evaluate.region_conflicts(r, 100.0).withColumn("distance_m", rnd("distance_m"))


@register("e1_manifest_violations", f"""WITH {REG}, {LBL} SELECT 'duplicate_feature_id' AS rule, CAST(feature_id AS VARCHAR) AS key FROM lb GROUP BY feature_id HAVING count(*) > 1
    UNION ALL SELECT 'group_spans_splits', independence_group FROM rg GROUP BY 2 HAVING min(split) <> max(split) UNION ALL SELECT 'unknown_survey', 'r7'
    UNION ALL SELECT 'region_exceeds_surveys', region_id FROM rg WHERE ord % 9 = 4 OR ord = 7 UNION ALL SELECT 'label_outside_region', CAST(label_id AS VARCHAR) FROM lb JOIN rg USING (region_id) WHERE x > east OR y > north
    UNION ALL SELECT 'review_order', CAST(label_id AS VARCHAR) FROM lb WHERE label_id % 97 = 0""")
def _e1(spark, sf):
    return evaluate.manifest_violations(manifest(spark, sf), 500.0, 40.0)


# Regions of whole units from parts and footprints from lineitem; the SQL asks for every unit square.
COVER = """rc AS (SELECT p_partkey AS region_id, 0.0 AS west, 0.0 AS south, 60.0 + 15 * (p_size % 3) AS east, 45.0 + 15 * (p_size % 4) AS north FROM part),
    fp AS (SELECT DISTINCT l_partkey AS region_id, CAST(l_orderkey % 5 * 15 - 5 AS DOUBLE) AS west, CAST(l_suppkey % 4 * 15 - 10 AS DOUBLE) AS south,
      CAST(l_orderkey % 5 * 15 - 5 + 30 + l_linenumber * 5 AS DOUBLE) AS east, CAST(l_suppkey % 4 * 15 - 10 + 40 + CAST(l_quantity AS INT) AS DOUBLE) AS north FROM lineitem)"""


@register("e1_uncovered_regions", f"""WITH {COVER}, sq AS (SELECT region_id, i.x, j.y FROM rc, LATERAL (SELECT unnest(range(0, CAST(east AS BIGINT), 1)) + 0.5 AS x) i, LATERAL (SELECT unnest(range(0, CAST(north AS BIGINT), 1)) + 0.5 AS y) j)
    SELECT DISTINCT region_id FROM sq WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.region_id = sq.region_id AND sq.x > fp.west AND sq.x < fp.east AND sq.y > fp.south AND sq.y < fp.north)""")
def _e1c(spark, sf):
    p, i = load(spark, sf, "part"), load(spark, sf, "lineitem")
    regions = p.select(F.col("p_partkey").alias("region_id"), F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), (F.lit(60.0) + 15 * (F.col("p_size") % 3)).alias("east"), (F.lit(45.0) + 15 * (F.col("p_size") % 4)).alias("north"))
    w, s = F.col("l_orderkey") % 5 * 15 - 5, F.col("l_suppkey") % 4 * 15 - 10
    sides = {"west": w, "south": s, "east": w + 30 + F.col("l_linenumber") * 5, "north": s + 40 + F.col("l_quantity").cast("int")}
    return evaluate.uncovered_regions(regions, i.select(F.col("l_partkey").alias("region_id"), *[v.cast("double").alias(k) for k, v in sides.items()]))


@register("e4_contract_violations", """SELECT 'dataset_version' AS rule, '2' AS key UNION ALL SELECT 'manifest_digest', 'stale' UNION ALL SELECT 'undeclared_family', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 3 = 2""")
def _e4(spark, sf):
    header = load(spark, sf, "nation").where("n_nationkey = 0").select(F.lit("synthetic").alias("dataset_id"), F.lit("2").alias("dataset_version"), F.lit("stale").alias("manifest_digest"))
    declared = predictions(spark, sf).select("family").distinct().where("family <> 'ridge'")
    return evaluate.contract_violations(manifest(spark, sf), header, predictions(spark, sf), declared)


@register("e3_score_points")
def _e3(spark, sf):
    out = evaluate.score_points(manifest(spark, sf), predictions(spark, sf), "test", 40.0, 2.0)["families"]
    return out.withColumns({c: rnd(c) for c in ("precision", "recall", "reviewed_area_km2", "false_positives_per_km2")})


# ---- streams over the event files ----------------------------------------------------------------------------------

def _drain(stream, out_schema, mode):
    """Run a stream over the files present to its end and return what it wrote."""
    folder = shared_folder(stream.sparkSession, "stream")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(out_schema).parquet(f"{folder}/out")


def event_stream(spark, sf, cols):
    schema = load(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(*cols)


JOBS = ctes("job_events")


@register("i1_fold_jobs_stream", f"WITH {JOBS}, en AS (SELECT job_id, min(CASE WHEN status IN ('completed', 'failed') THEN seq END) AS e FROM job_events GROUP BY 1) SELECT job_id, arg_max(status, seq) AS status, max(least(progress, 100)) AS progress FROM job_events JOIN en USING (job_id) WHERE e IS NULL OR seq <= e GROUP BY 1")
def _i1s(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    status = (F.when(F.col("event_type") == "purchase", F.when(e % 50 == 3, "completed").otherwise("running")).when(F.col("event_type") == "error", F.when(e % 60 == 7, "failed").otherwise("running"))
              .when(F.col("event_type") == "signup", "pending").otherwise("running"))
    cols = [F.concat(F.lit("job"), F.col("user_id")).alias("job_id"), e.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.round(v).cast("int").alias("progress"), F.concat(F.lit("stage"), e % 6).alias("stage")]
    out = folds.fold_jobs_stream(event_stream(spark, sf, cols))
    return _drain(out, out.schema, "update").groupBy("job_id").agg(F.max_by("status", "updated_at").alias("status"), F.max("progress").alias("progress"))


@register("i5_request_rollup_stream")
def _i5s(spark, sf):
    e = F.col("event_id")
    cols = [F.expr("event_id DIV 2").alias("request_id"), F.when(e % 2 == 0, "in").otherwise("out").alias("phase"), F.col("ts").cast("timestamp").alias("ts"), F.when(e % 2 == 1, 200 + e % 3 * 100).alias("status")]
    out = folds.request_rollup_stream(event_stream(spark, sf, cols), "40 days", "1 day").select("status", "n", F.col("window.start").alias("day"))
    return _drain(out, out.schema, "update").groupBy("day", "status").agg(F.max("n").alias("n"))


# ---- learned detectors ---------------------------------------------------------------------------------------------

def learned_surface(spark, sf):
    s = fixture(spark, sf, "dem").withColumn("z", F.col("z") / 100.0)
    s = fill.fill_difference(s, BLOCK).drop("filled")
    s = horizon.horizon(s, 3, ("svf",), keep=["z", "fill_diff"], block=BLOCK)
    return hold(focal.derive(s, ["slope", "tpi"], BLOCK).na.fill(0.0, ["slope", "tpi", "svf"]))


@register("m1_feature_vector")
def _m1(spark, sf):
    s = learned_surface(spark, sf)
    out = learn.feature_vector(learn.depressions(s, 0.5, 4, BLOCK), s, block=BLOCK)
    return out.select("survey_id", "region_id", *[rnd(c).alias(c) for c in learn.FEATURES])


@register("m2_training_set")
def _m2(spark, sf):
    s = learned_surface(spark, sf)
    small = s.withColumn("fill_diff", F.col("fill_diff") / 10)
    return learn.training_set(small, learn.depressions(s, 0.5, 4, BLOCK), 40, block=BLOCK).select("label", *[rnd(c).alias(c) for c in learn.FEATURES])


@register("d14_random_forest")
def _d14(spark, sf):
    s = learned_surface(spark, sf)
    rows = learn.feature_vector(learn.depressions(s, 0.5, 4, BLOCK), s, block=BLOCK).withColumn("label", (F.col("depth_m") > 2.5).cast("double"))
    model, _ = learn.train_forest(rows, trees=20, depth=8, folds=2)
    return get_pass("random_forest")(s, model=model, block=BLOCK).candidates.select("survey_id", "region_id", rnd("score").alias("score"), "feature_type")


@register("m3_train_forest")
def _m3(spark, sf):
    s = learned_surface(spark, sf)
    rows = learn.feature_vector(learn.depressions(s, 0.5, 4, BLOCK), s, block=BLOCK).withColumn("label", (F.col("depth_m") > 2.5).cast("double"))
    _, metrics = learn.train_forest(rows, trees=20, depth=8, folds=2)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in [*metrics["importances"].items(), ("roc_auc", metrics["roc_auc"])]], "name string, value double")


@register("m4_patch_samples")
def _m4(spark, sf):
    s = learned_surface(spark, sf)
    centres = s.where("row % 50 = 20 AND col % 16 = 9").select(F.concat_ws(":", "survey_id", "row", "col").alias("centre_id"), "survey_id", "row", "col")
    return learn.patch_samples(s, centres, 8).select("centre_id", *[rnd(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).alias(c) for c in learn.CHANNELS], F.size("target").alias("cells"))


@register("d15_segmentation")
def _d15(spark, sf):
    s = learned_surface(spark, sf).withColumn("lrm_7", F.col("tpi"))
    low = lambda cells: F.transform(cells, lambda c: 1 - c["z"])
    return get_pass("unet_segmentation")(s, predict=low, size=32, overlap=8, threshold=0.7, min_cells=3, block=BLOCK).candidates.select("survey_id", "region_id", rnd("score").alias("score"), "area_m2")


def lowest_cell(batches):
    """A stand-in model: one box round each patch's lowest cell."""
    import pandas as pd

    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            best = min(r.cells, key=lambda c: (c["z"], c["row"], c["col"]))
            y, x = best["row"] - r.patch_row, best["col"] - r.patch_col
            rows.append((r.survey_id, r.patch_row, r.patch_col, float(x) - 1, float(y) - 1, float(x) + 2, float(y) + 2, 1 - float(best["z"]), int(best["row"] % 5)))
        yield pd.DataFrame(rows, columns=["survey_id", "patch_row", "patch_col", "x0", "y0", "x1", "y1", "score", "class_id"])


@register("d16_boxes")
def _d16(spark, sf):
    out = learn.boxes(fixture(spark, sf, "dem"), lowest_cell, 32, 8)
    return out.select("survey_id", "region_id", "row", "col", rnd("score").alias("score"), "feature_type", "area_m2")


# ---- whole jobs ----------------------------------------------------------------------------------------------------

def scan(spark, sf):
    """The line items as points of two surveys, heights scaled to tens of metres."""
    return point_cloud(fixture(spark, sf, "points").withColumn("z", F.col("z") / 100))


def scan_terrain(spark, sf):
    return survey.build_terrain(scan(spark, sf), res=4.0, radius=8.0, pre_classified=True, kernels=(7,), svf_radius=12.0, block=BLOCK)


def around(spark, sf):
    """What lies around the scan: two neighbouring UTM surveys, footprints of parts brought to them, roads of suppliers."""
    surveys = spark.createDataFrame([("p0", 32617), ("p1", 32617)], "survey_id string, epsg int")
    foot = fixture(spark, sf, "footprints")
    west, south = -85.4888, 0.0005  # eastings and northings below 500 m lie here
    moved = foot.select("id", "kind", *[(F.lit(west) + (F.col(c) + 80.025) / 100).alias(c) for c in ("west", "east")], *[(F.lit(south) + (F.col(c) - 39.975) / 100).alias(c) for c in ("south", "north")])
    return survey.Context(surveys, moved.where("kind = 'building'").drop("kind"), moved.where("kind = 'cemetery'").drop("kind"), fixture(spark, sf, "segments"))


@register("f8_build_terrain")
def _f8(spark, sf):
    return scan_terrain(spark, sf).select("survey_id", "row", "col", *[rnd(c, 5).alias(c) for c in ("z", "fill_diff", "lrm_7", "svf", "slope", "tpi")])


@register("f7_run_preset")
def _f7(spark, sf):
    out = survey.run_preset(scan_terrain(spark, sf), scan(spark, sf), "sinkhole_survey", res=4.0, block=BLOCK)
    return out.select("survey_id", "cand_id", rnd("x", 3).alias("x"), rnd("y", 3).alias("y"), rnd("score").alias("score"), "feature_type", F.concat_ws(",", "source_passes").alias("passes"))


@register("f9_survey_to_detections")
def _f9(spark, sf):
    out = survey.survey_to_detections(scan(spark, sf), "sinkhole_survey", res=4.0, block=BLOCK, terrain=scan_terrain(spark, sf), context=around(spark, sf))
    rows = survey.stored_rows(out)
    return rows.select("tile_id", "cand_id", rnd("lon", 7).alias("lon"), rnd("lat", 7).alias("lat"), rnd("confidence").alias("confidence"), "feature_type", rnd("depth_m").alias("depth_m"), rnd("area_m2").alias("area_m2"), F.concat_ws(",", "source_passes").alias("passes"))

"""Learned detectors: features, training sets, a forest, patch samples, and adapters for user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscan.operators.blocks import BLOCK, KEYS
from fellscan.operators.components import drop_small, label
from fellscan.operators.focal import normalise_channels
from fellscan.operators.regions import REGION, batch_morphometrics, pca_elongation, region_stats
from fellscan.operators.warp import patches, stitch
from fellscan.plans.passes import mask, sanitise
from fellscan.plans.registry import Found, as_candidates, register_pass
from fellscan.session import cut_lineage, hold

FEATURES = ["depth_m", "area_m2", "perimeter_m", "circularity", "elongation", "depth_area_ratio", "mean_slope", "max_slope", "tpi_centroid", "svf_centroid"]
CHANNELS = ["z", "slope", "tpi", "svf", "fill_diff"]
BATCH_CELLS = 65_536  # of the patches given to a box model at once (about 30 MB as pandas rows); at least one patch
FOUND = pa.schema([("survey_id", pa.string()), ("patch_row", pa.int64()), ("patch_col", pa.int64()), *[(c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "score")], ("class_id", pa.int32())])
BOX_TYPES = {0: "sinkhole", 1: "cave_entrance", 2: "mine_portal", 3: "depression"}  # fixed values: class numbers of box models


def feature_vector(labelled: DataFrame, surface: DataFrame, res: float = 1.0, block: int = BLOCK) -> DataFrame:
    """The ten features per region; the surface needs z, slope, tpi and svf. TPI and SVF come from the cell at the truncated centroid."""
    shape = batch_morphometrics(labelled.select(*REGION, "row", "col"), surface.select(*KEYS, "z", "slope"), res, block)
    steep = labelled.select(*REGION, "row", "col").join(surface.select(*KEYS, "slope"), KEYS).groupBy(*REGION).agg(F.max("slope").alias("max_slope"))
    base = shape.join(pca_elongation(labelled), REGION).join(steep, REGION)
    at = base.withColumns({"row": F.floor("centroid_row").cast("bigint"), "col": F.floor("centroid_col").cast("bigint")})
    full = at.join(surface.select(*KEYS, F.col("tpi").alias("tpi_centroid"), F.col("svf").alias("svf_centroid")), KEYS, "left")
    return full.select(*REGION, "cells", "centroid_row", "centroid_col", "depth_m", "area_m2", "perimeter_m", "circularity", F.col("elongation_pca").alias("elongation"),
                       (F.col("depth_m") / F.col("area_m2")).alias("depth_area_ratio"), F.coalesce("wall_slope_deg", F.lit(0.0)).alias("mean_slope"),
                       F.coalesce("max_slope", F.lit(0.0)).alias("max_slope"), F.coalesce("tpi_centroid", F.lit(0.0)).alias("tpi_centroid"), F.coalesce("svf_centroid", F.lit(0.0)).alias("svf_centroid"))


def depressions(surface: DataFrame, min_depth: float, min_cells: int = 4, block: int = BLOCK) -> DataFrame:
    return drop_small(label(mask(sanitise(surface, "fill_diff"), "fill_diff", ">", min_depth).select(*KEYS), block), min_cells).drop("cells")


def training_set(surface: DataFrame, positives: DataFrame, n_neg: int, seed: int = 42, res: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Feature rows with ``label``: the given regions, and seeded discs (radius 5..14 cells) on ground without depressions.

    Disc centres are the surface cells with the smallest seeded hashes, so the draw needs no driver-side sampling.
    """
    pos = feature_vector(drop_small(positives, 4).drop("cells"), surface, res, block).withColumn("label", F.lit(1.0))
    draw = F.xxhash64(F.lit(seed), "survey_id", "row", "col")
    centres = surface.select(*KEYS).withColumn("h", draw).orderBy("h").limit(3 * n_neg)
    disc = centres.select("survey_id", F.col("row").alias("r0"), F.col("col").alias("c0"), "h", (5 + F.pmod(F.col("h"), F.lit(10))).cast("int").alias("radius"))
    steps = disc.withColumn("dr", F.explode(F.sequence(-F.col("radius"), F.col("radius")))).withColumn("dc", F.explode(F.sequence(-F.col("radius"), F.col("radius"))))
    cells = steps.where("dr * dr + dc * dc <= radius * radius").select("survey_id", (F.col("r0") + F.col("dr")).alias("row"), (F.col("c0") + F.col("dc")).alias("col"), F.col("h").alias("region_id"))
    there = cells.join(surface.select(*KEYS, "fill_diff"), KEYS)
    bad = there.where("fill_diff > 0.5").select("region_id").distinct()
    good = there.join(bad, "region_id", "left_anti").select("survey_id", "region_id", "row", "col")
    # discs may overlap; each is measured as its own region by giving it its own survey-sized copy key
    tagged = good.withColumn("survey_id", F.concat_ws("#", "survey_id", F.col("region_id").cast("string")))
    own = tagged.join(surface.select(F.col("survey_id").alias("_s"), "row", "col", "z", "slope", "tpi", "svf"), (F.substring_index("survey_id", "#", 1) == F.col("_s")) & (tagged["row"] == surface["row"]) & (tagged["col"] == surface["col"]))
    copy = own.select("survey_id", tagged["row"], tagged["col"], "z", "slope", "tpi", "svf")
    neg = feature_vector(tagged, copy, res, block).withColumn("label", F.lit(0.0)).orderBy("region_id").limit(n_neg)
    return pos.unionByName(neg)


def train_forest(df: DataFrame, trees: int = 200, depth: int = 20, folds: int = 5, seed: int = 42) -> tuple[Model, dict]:
    """Balanced forest on the ten features; metrics hold the cross-validated ROC area and feature importances."""
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    kept = cut_lineage(assembled.select("features", "label"))
    held = hold(assembled)  # counts and folds read the rows again and again
    counts = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}  # two rows
    total, classes = sum(counts.values()), len(counts)
    weight = F.when(F.col("label") == 1.0, total / (classes * counts.get(1.0, total))).otherwise(total / (classes * counts.get(0.0, total)))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    judge = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    k = max(2, min(folds, int(min(counts.values()))))
    dealt = held.withColumn("weight", weight).withColumn("_fold", F.rand(seed))
    scores = []
    for i in range(k):
        mine = (F.col("_fold") >= i / k) & (F.col("_fold") < (i + 1) / k)
        train, rest = hold(dealt.where(~mine)), hold(dealt.where(mine))
        scores.append(judge.evaluate(forest.fit(train).transform(rest)))
        train.unpersist(), rest.unpersist()
    model = forest.fit(kept.withColumn("weight", weight))
    return model, {"roc_auc": sum(scores) / k, "folds": k, "importances": dict(zip(FEATURES, model.featureImportances.toArray().tolist()))}


def patch_samples(surface: DataFrame, centres: DataFrame, size: int, channels: list[str] | None = None) -> DataFrame:
    """One row per centre with its size x size window of 0..1 channels (row-major arrays) and a label mask (fill > 0.5).

    Windows leaving the ground are dropped. ``centres``: (centre_id, survey_id, row, col).
    """
    names, half = channels or CHANNELS, size // 2
    scaled = normalise_channels(surface, names).select(*KEYS, *[F.col(f"{c}_norm").alias(c + "_n") for c in names], (F.col("fill_diff") > 0.5).cast("int").alias("target"))
    want = centres.withColumn("dr", F.explode(F.sequence(F.lit(-half), F.lit(size - half - 1)))).withColumn("dc", F.explode(F.sequence(F.lit(-half), F.lit(size - half - 1))))
    want = want.select("centre_id", "survey_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    full = want.join(scaled, KEYS).groupBy("centre_id").agg(  # at most size**2 cells per centre
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("row", "col", *[c + "_n" for c in names], "target"))).alias("cells")).where(F.col("n") == size * size)
    take = lambda c: F.transform("cells", lambda x: x[c])
    return full.select("centre_id", *[take(c + "_n").alias(c) for c in names], take("target").alias("target"))


@register_pass("random_forest", ["z", "fill_diff", "slope", "tpi", "svf"], "0.2.0", model=None, min_depth_m=0.5, min_probability=0.5, res=1.0, block=BLOCK)
def random_forest(surface, model, min_depth_m, min_probability, res, block) -> Found:
    lab = depressions(surface, min_depth_m, 4, block)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(feature_vector(lab, surface, res, block))
    scored = model.transform(rows).withColumn("p", F.element_at(vector_to_array("probability"), -1)).where(F.col("p") >= min_probability)
    scored = scored.withColumns({"centroid_row": F.col("centroid_row") + 0.5, "centroid_col": F.col("centroid_col") + 0.5})
    extra = {c: F.col(c) for c in FEATURES if c != "area_m2"}
    return Found(as_candidates(scored, "random_forest", F.col("p"), "sinkhole", F.col("area_m2"), **extra), lab.join(scored.select(*REGION), REGION, "left_semi"))


@register_pass("unet_segmentation", ["z", "slope", "svf"], "0.1.0", predict=None, size=256, overlap=64, threshold=0.5, min_cells=10, res=1.0, block=BLOCK)
def segmentation(surface, predict, size, overlap, threshold, min_cells, res, block) -> Found:
    """``predict`` is a Column function (such as a batch-inference UDF) over the normalised channels of one cell's patch row.

    It receives ``cells array<struct<row,col,channels...>>`` of a patch and returns probabilities in the same order.
    """
    tpi = F.coalesce(*[F.col(c) for c in ("tpi_15m", "tpi") if c in surface.columns])
    lrm = next(c for c in surface.columns if c.startswith("lrm_") or c == "local_relief")
    names = ["z", "slope", "svf", "_tpi", lrm]
    scaled = normalise_channels(surface.withColumn("_tpi", tpi), names)
    rows = patches(scaled, size, overlap).groupBy("survey_id", "patch_row", "patch_col").agg(  # at most size**2 cells per patch
        F.sort_array(F.collect_list(F.struct("row", "col", *[F.col(f"{c}_norm").alias(c) for c in names]))).alias("cells"))
    paired = rows.select("survey_id", F.explode(F.arrays_zip(F.col("cells").alias("c"), predict(F.col("cells")).alias("p"))).alias("q"))
    prob = stitch(paired.select("survey_id", F.col("q.c.row").alias("row"), F.col("q.c.col").alias("col"), F.col("q.p").alias("p")))
    lab = label(prob.where(F.col("p") > threshold), block)
    stats = region_stats(lab, "p").where(F.col("cells") >= min_cells)
    cands = as_candidates(stats, "unet_segmentation", F.col("mean_v"), "sinkhole", F.col("cells") * (res * res), mean_probability=F.col("mean_v"))
    return Found(cands, lab.select(*REGION, "row", "col").join(stats.select(*REGION), REGION, "left_semi"))


def _by_few(predict: Callable) -> Callable:
    """``predict`` over Arrow batches, with few patches a time as pandas rows: cells cost far more memory there."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = batch.column("cells").offsets.to_numpy()
            a, n = 0, batch.num_rows
            while a < n:
                b = min(n, max(a + 1, int(np.searchsorted(ends, ends[a] + BATCH_CELLS, "right")) - 1))
                yield batch.slice(a, b - a).to_pandas()
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in predict(few(batches)):
            yield pa.RecordBatch.from_pandas(pdf, FOUND, preserve_index=False)

    return run


def boxes(surface: DataFrame, predict: Callable, size: int = 640, overlap: int = 64, channels: list[str] | None = None, res: float = 1.0, min_score: float = 0.25) -> DataFrame:
    """Candidates from a box model applied per patch.

    ``predict`` maps batches of (survey_id, patch_row, patch_col, cells) pandas rows to (survey_id, patch_row, patch_col,
    x0, y0, x1, y1, score, class_id) with pixel boxes relative to the patch. A batch holds about ``BATCH_CELLS`` cells.
    """
    names = channels or ["z"]
    scaled = normalise_channels(surface, names)
    rows = patches(scaled, size, overlap).groupBy("survey_id", "patch_row", "patch_col").agg(  # at most size**2 cells per patch
        F.sort_array(F.collect_list(F.struct("row", "col", *[F.col(f"{c}_norm").alias(c) for c in names]))).alias("cells"))
    found = rows.mapInArrow(_by_few(predict), "survey_id string, patch_row bigint, patch_col bigint, x0 double, y0 double, x1 double, y1 double, score double, class_id int")
    kinds = F.create_map(*[x for k, v in BOX_TYPES.items() for x in (F.lit(k), F.lit(v))])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (res * res)
    return found.where(F.col("score") >= min_score).select(
        "survey_id", F.xxhash64("patch_row", "patch_col", "x0", "y0", "x1", "y1").alias("region_id"), F.lit("yolo_detector").alias("pass_name"),
        (F.col("patch_row") + (F.col("y0") + F.col("y1")) / 2).alias("row"), (F.col("patch_col") + (F.col("x0") + F.col("x1")) / 2).alias("col"), "score",
        F.coalesce(F.element_at(kinds, F.col("class_id")), F.lit("unknown")).alias("feature_type"), area.alias("area_m2"),
        F.create_map(F.lit("bbox_area_m2"), area, F.lit("area_m2"), area).alias("morphometrics"))

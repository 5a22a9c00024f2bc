"""Scoring predictions against reviewed labels: contract checks, regions, exclusion zones, matching, scorecards.

Manifest tables (coordinates in projected metres):
  protocol(evaluation_epsg, split_buffer_m, point_tolerance_m, dataset_id, dataset_version)   one row
  surveys(survey_id, west, south, east, north)                regions(region_id, ord, independence_group, split, west..north)
  region_surveys(region_id, survey_id)                        region_reviews(region_id, family, completeness)
  labels(label_id, feature_id, region_id, family, geometry_type, x, y)
  label_reviews(label_id, revision, status, reviewed_on)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscan.operators.components import connected_components
from fellscan.operators.joins import pairs_once, placed_pairs, points_in_rects, within_distance
from fellscan.operators.reports import duplicate_keys
from fellscan.session import cut_lineage
from fellscan.sources.cells import fingerprint
from fellscan.streaming.folds import consecutive_revisions, latest_review

MAX_COMPONENT = 20_000


def assign_region(points: DataFrame, regions: DataFrame, key: str, size: float = 1000.0) -> DataFrame:
    """First region (by ``ord``) covering each point, edges included; ``region_id`` is null outside all of them."""
    rects = regions.select("ord", "region_id", "west", "south", "east", "north")
    hits = points_in_rects(points.select(key, "x", "y"), rects, size, "x", "y", closed=True).groupBy(key).agg(F.min(F.struct("r_ord", "r_region_id")).alias("m"))
    return points.join(hits, key, "left").select(*points.columns, F.col("m.r_region_id").alias("region_id"))


def outside_regions(points: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    return assign_region(points, regions, key).where(F.col("region_id").isNull()).select(key)


def assign_pairs(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> list[int]:
    """Indices of the chosen edges: as many one-to-one pairs as possible, then the smallest total cost.

    Repeatedly adds the cheapest augmenting path from the free left points, found by label correction over the sparse
    edges; paths of a growing matching stay the cheapest of its size, so the result is optimal.
    """
    n, m = int(left.max()) + 1, int(right.max()) + 1
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    for k, (i, j, c) in enumerate(zip(left.tolist(), right.tolist(), cost.tolist())):
        out[i].append((j, k, c))
    mate_l, mate_r = [-1] * n, [-1] * m  # chosen edge per side
    while True:
        dist_r, via = [np.inf] * m, [-1] * m
        queue = [i for i in range(n) if mate_l[i] < 0]
        dist_l = [0.0 if mate_l[i] < 0 else np.inf for i in range(n)]
        while queue:
            i = queue.pop(0)
            for j, k, c in out[i]:
                if k == mate_l[i]:
                    continue
                d = dist_l[i] + c
                if d < dist_r[j] - 1e-12:
                    dist_r[j], via[j] = d, k
                    if mate_r[j] >= 0:
                        back = mate_r[j]
                        i2 = int(left[back])
                        if d - cost[back] < dist_l[i2] - 1e-12:
                            dist_l[i2] = d - cost[back]
                            if i2 not in queue:
                                queue.append(i2)
        ends = [(dist_r[j], j) for j in range(m) if mate_r[j] < 0 and dist_r[j] < np.inf]
        if not ends:
            break
        j = min(ends)[1]
        while True:
            k = via[j]
            i = int(left[k])
            before = mate_l[i]
            mate_l[i], mate_r[j] = k, k
            if before < 0:
                break
            j = int(right[before])
    return [k for k in mate_l if k >= 0]


def assign_dense(cost: np.ndarray) -> np.ndarray:
    """Column of each row (rows <= columns) with the smallest total: shortest augmenting paths, a row of the matrix a step."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, back = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        best, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            now = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = (now < best[1:]) & ~used[1:]
            best[1:][better], back[1:][better] = now[better], j
            j = int(np.where(used, np.inf, best)[1:].argmin()) + 1
            step = best[j]
            u[row_of[used]] += step
            v[used] -= step
            best[~used] -= step
            if row_of[j] == 0:
                break
        while j:
            row_of[j], j = row_of[back[j]], back[j]
    out = np.zeros(n, int)
    out[row_of[1:][row_of[1:] > 0] - 1] = np.flatnonzero(row_of[1:])
    return out


DENSE = 4_000_000  # entries of a component's cost matrix (32 MB); larger components are solved over their edges


def _match(edges: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one group of components. ``edges``: (s, p, distance_m), ``labels``: (s, t), s the place labels share."""
    both = labels.merge(edges, on="s").sort_values(["distance_m", "p", "t"], ignore_index=True).drop_duplicates(["p", "t"], ignore_index=True)
    both = both.sort_values(["p", "t"], ignore_index=True)
    left, right = pd.factorize(both["p"])[0], pd.factorize(both["t"])[0]
    cost, n, m = both["distance_m"].to_numpy(float), int(left.max()) + 1, int(right.max()) + 1
    if n * m > DENSE:
        chosen = assign_pairs(left, right, cost)
    else:
        none = (min(n, m) + 1) * (cost.max() + 1)  # dearer than any matching, so as many pairs as possible are made
        table, at = np.full((n, m), none), np.zeros((n, m), int)
        table[left, right], at[left, right] = cost, np.arange(len(both))
        rows, cols = (np.arange(n), assign_dense(table)) if n <= m else (assign_dense(table.T), np.arange(m))
        real = table[rows, cols] < none
        chosen = at[rows[real], cols[real]]
    return both.loc[chosen, ["p", "t", "distance_m"]]


def match_points(pred: DataFrame, truth: DataFrame, tol: float, keys: list[str] | None = None, pred_id: str = "prediction_id", label_id: str = "label_id",
                 max_component: int = MAX_COMPONENT) -> DataFrame:
    """(prediction_id, label_id, distance_m): most pairs within ``tol``, then least total distance, at most one per point.

    Labels of one place stand together, and a place meets no more of its nearest predictions than there are labels within
    twice the tolerance: the others near it can take fewer than that, so one of these stays free for each of its labels and
    a pair with a farther prediction is never needed. Pairs split into connected components and each is solved on its own.
    A component with more points than ``max_component`` stops the job with its size instead of being cut.
    """
    keys = keys or []
    types = {f.name: f.dataType.simpleString() for f in [*pred.select(F.col(pred_id).alias("p")).schema, *truth.select(F.col(label_id).alias("t")).schema]}
    spots = pred.select(F.col(pred_id).alias("p"), "x", "y", *keys).distinct()
    labels = truth.select(F.col(label_id).alias("t"), "x", "y", *keys).where("t IS NOT NULL").distinct()
    place = ["x", "y", *keys]
    sites = cut_lineage(labels.groupBy(*place).agg(F.count("*").alias("m"), F.concat_ws(":", F.lit("t"), F.min("t").cast("string"), "x", "y").alias("s")))
    crowd = within_distance(sites, sites, 2 * tol * (1 + 1e-9), "metric", "x", "y", "x", "y", keys=keys).groupBy(F.col("a_s").alias("s")).agg(F.sum("b_m").alias("most"))
    # an id at several places could fill the nearest ones twice over
    repeats = spots.groupBy("p").count().agg(F.max("count")).first()[0] or 1
    near = within_distance(sites.select("s", *place).join(crowd, "s"), spots, tol, "metric", "x", "y", "x", "y", keys=keys)
    nearest = Window.partitionBy("a_s").orderBy("distance_m", "b_p")
    n = max(int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * pred.sparkSession.sparkContext.defaultParallelism)  # pairs compress too well to be merged by size
    edges = near.select("a_s", "a_most", "b_p", "distance_m").repartition(n, "a_s").withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= F.col("a_most") * repeats)
    edges = cut_lineage(edges.select(F.col("a_s").alias("s"), F.col("b_p").alias("p"), "distance_m", "k"))
    tag = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    # a label at several places links them
    known = cut_lineage(labels.join(sites, place).select("s", "t"))
    spread = known.join(known.groupBy("t").agg(F.min("s").alias("v"), F.count("*").alias("n")).where("n > 1"), "t").select(F.lit("all").alias("scope"), F.col("s").alias("u"), "v")
    graph = edges.select(F.lit("all").alias("scope"), tag("p").alias("u"), F.col("s").alias("v")).unionByName(spread)
    home = cut_lineage(connected_components(graph).select("id", "root"))
    mine = known.join(home.withColumnRenamed("id", "s"), "s")
    sizes = home.where("id LIKE 'p%'").groupBy("root").agg(F.count("*").alias("n")).unionByName(mine.groupBy("root").agg(F.countDistinct("t").alias("n"))).groupBy("root").agg(F.sum("n").alias("n"))
    guard = F.when(F.col("n") > max_component, F.raise_error(F.concat(F.lit("matching component too large: "), F.col("n").cast("string"))).cast("boolean")).otherwise(True)
    places = home.where("id LIKE 't%'").groupBy("root").agg(F.count("*").alias("places"))
    alone = (F.col("places") == 1) & F.lit(repeats == 1)
    roots = home.join(sizes.where(guard), "root").join(places, "root").select(F.col("id").alias("s"), "root", alone.alias("alone"))
    # a place of its own: its labels take the nearest predictions
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("t")))
    plain = edges.join(roots.where("alone"), "s").join(ranked, ["s", "k"]).select("p", "t", "distance_m")
    of_edges = edges.join(roots.where("NOT alone"), "s").select("root", "s", "p", "distance_m").repartition(n, "root")
    of_labels = known.join(roots.where("NOT alone"), "s").select(F.col("root").alias("at"), "s", "t").repartition(n, "at")
    out = plain.unionByName(of_edges.groupBy("root").cogroup(of_labels.groupBy("at")).applyInPandas(
        lambda e, t: _match(e, t) if len(e) else pd.DataFrame({"p": [], "t": [], "distance_m": []}), f"p {types['p']}, t {types['t']}, distance_m double"))
    return out.select(F.col("p").alias(pred_id), F.col("t").alias(label_id), "distance_m")


def missed(truth: DataFrame, pairs: DataFrame, label_id: str = "label_id") -> DataFrame:
    return truth.join(pairs.select(label_id), label_id, "left_anti")


def unmatched(pred: DataFrame, truth: DataFrame, pairs: DataFrame, tol: float, keys: list[str] | None = None, pred_id: str = "prediction_id", label_id: str = "label_id") -> DataFrame:
    """False positives, with ``duplicate`` where some truth lies within the tolerance all the same."""
    keys = keys or []
    fps = pred.join(pairs.select(pred_id), pred_id, "left_anti")
    near = within_distance(fps.select(pred_id, "x", "y", *keys), truth.select("x", "y", *keys).distinct(), tol, "metric", "x", "y", "x", "y", keys=keys)
    near = near.select(F.col(f"a_{pred_id}").alias(pred_id), F.lit(True).alias("duplicate")).distinct()
    return fps.join(near, pred_id, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def exclusion_zones(points: DataFrame, uncertain: DataFrame, tol: float, key: str, keys: list[str] | None = None) -> DataFrame:
    """Points with ``excluded``: within ``tol`` of an unresolved label (of the same ``keys``)."""
    keys = keys or []
    near = within_distance(points.select(key, "x", "y", *keys), uncertain.select("x", "y", *keys).distinct(), tol, "metric", "x", "y", "x", "y", keys=keys)
    near = near.select(F.col(f"a_{key}").alias(key), F.lit(True).alias("excluded")).distinct()
    return points.join(near, key, "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def reviewed_area(regions: DataFrame, uncertain: DataFrame, tol: float, step: float = 1.0) -> DataFrame:
    """(region_id, family, area_m2): rectangle area less the discs of ``tol`` around unresolved labels, on a ``step`` lattice.

    Only the discs are rasterised, a lattice row of one being a run of cells; runs that overlap count once.
    """
    c, box = F.col, ["region_id", "family", "west", "south", "east", "north"]
    middle = lambda g: (g + 0.5) * step
    # roots may be rounded, so a run's ends are tried with their neighbours
    first = lambda g, ok: F.when(ok(g - 1), g - 1).when(ok(g), g).when(ok(g + 1), g + 1)
    last = lambda g, ok: F.when(ok(g + 1), g + 1).when(ok(g), g).when(ok(g - 1), g - 1)
    spark = regions.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # runs far outnumber discs
    discs = uncertain.select("region_id", "family", "x", "y").distinct().repartition(n)
    rows = discs.withColumn("gy", F.explode(F.sequence(F.floor((c("y") - tol) / step), F.floor((c("y") + tol) / step))))
    half = F.sqrt(F.greatest(tol * tol - (middle(c("gy")) - c("y")) ** 2, F.lit(0.0)))
    held = lambda g: (middle(g) - c("x")) ** 2 + (middle(c("gy")) - c("y")) ** 2 <= tol * tol
    runs = rows.select("region_id", "family", "gy", first(F.ceil((c("x") - half) / step - 0.5), held).alias("lo"), last(F.floor((c("x") + half) / step - 0.5), held).alias("hi")).where("lo IS NOT NULL")
    several = regions.select(*box).groupBy(*box).agg(F.count("*").alias("_m"))
    inside = runs.join(several, ["region_id", "family"]).where((middle(c("gy")) >= c("south")) & (middle(c("gy")) <= c("north"))).select(
        *box, "_m", "gy", F.greatest("lo", first(F.ceil(c("west") / step - 0.5), lambda g: middle(g) >= c("west"))).alias("lo"),
        F.least("hi", last(F.floor(c("east") / step - 0.5), lambda g: middle(g) <= c("east"))).alias("hi")).where("lo <= hi").repartition(n, *box, "gy")
    before = F.max("hi").over(Window.partitionBy(*box, "gy").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    new = inside.withColumn("_new", F.greatest(c("hi") - F.greatest(c("lo") - 1, F.coalesce(before, c("lo") - 1)), F.lit(0)))
    lost = new.groupBy("region_id", "family").agg((F.sum(c("_new") * c("_m")) * (step * step)).alias("lost"))
    box = regions.select(*box)
    full = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return box.join(lost, ["region_id", "family"], "left").select("region_id", "family", (full - F.coalesce("lost", F.lit(0.0))).alias("area_m2"))


def scorecard(matches: DataFrame, misses: DataFrame, fps: DataFrame, area: DataFrame, families: DataFrame) -> DataFrame:
    """Per family: counts, precision, recall (null when undefined), reviewed km2, false positives per km2, status."""
    n = lambda df, name: df.groupBy("family").agg(F.count("*").alias(name))
    out = families.select("family").distinct()
    for df, name in ((matches, "tp"), (misses, "fn"), (fps, "fp")):
        out = out.join(n(df, name), "family", "left")
    out = out.join(area.groupBy("family").agg(F.sum("area_m2").alias("a")), "family", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tp, fn, fp, km2 = zero("tp"), zero("fn"), zero("fp"), F.coalesce("a", F.lit(0.0)) / 1e6
    return out.select(
        "family", tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"), km2.alias("reviewed_area_km2"), F.when(km2 > 0, fp / km2).alias("false_positives_per_km2"),
        F.when(km2 > 0, "scored").otherwise("no_reviewed_area").alias("status"))


def score_points(manifest: dict[str, DataFrame], preds: DataFrame, split: str, tol: float, step: float = 1.0) -> dict[str, DataFrame]:
    """Full point scoring of one split. ``preds``: (prediction_id, family, x, y). Returns the report's tables."""
    regions = manifest["regions"].where(F.col("split") == split)
    located = cut_lineage(assign_region(preds, regions, "prediction_id").where(F.col("region_id").isNotNull()))
    exhaustive = manifest["region_reviews"].where("completeness = 'exhaustive'").select("region_id", "family").distinct()
    reviewed = located.join(exhaustive, ["region_id", "family"], "left_semi")
    not_reviewed = located.join(exhaustive, ["region_id", "family"], "left_anti").select("prediction_id", "family", F.lit("region_not_exhaustively_reviewed").alias("reason"))
    labels = manifest["labels"].join(regions.select("region_id"), "region_id", "left_semi").join(latest_review(manifest["label_reviews"]).select("label_id", "status"), "label_id")
    in_reviewed = labels.join(exhaustive, ["region_id", "family"], "left_semi")
    outside = labels.where("status = 'present'").join(exhaustive, ["region_id", "family"], "left_anti").select("label_id", "family")
    keys = ["region_id", "family"]
    unsure = in_reviewed.where("status = 'uncertain'").select("x", "y", *keys)
    flagged = cut_lineage(exclusion_zones(reviewed, unsure, tol, "prediction_id", keys))
    truth_all = in_reviewed.where("status = 'present'")
    wrong = F.when(F.col("geometry_type") != "Point", F.raise_error("present label is not a point").cast("boolean")).otherwise(True)
    truth_flagged = cut_lineage(exclusion_zones(truth_all.where(wrong), unsure, tol, "label_id", keys))
    kept, truth = flagged.where("NOT excluded").drop("excluded"), truth_flagged.where("NOT excluded").drop("excluded")
    matches = cut_lineage(match_points(kept, truth, tol, keys))
    fps = unmatched(kept, truth, matches, tol, keys)
    misses = missed(truth, matches)
    area = reviewed_area(regions.join(exhaustive, "region_id"), unsure, tol, step)
    named = matches.join(kept.select("prediction_id", "family"), "prediction_id")
    excluded = not_reviewed.unionByName(flagged.where("excluded").select("prediction_id", "family", F.lit("unresolved_label_neighborhood").alias("reason")))
    excluded_labels = outside.unionByName(truth_flagged.where("excluded").select("label_id", "family"))
    return {"families": scorecard(named, misses, fps, area, preds.select("family")), "matches": named, "misses": misses, "false_positives": fps,
            "excluded_predictions": excluded, "excluded_labels": excluded_labels}


# ---- contracts -----------------------------------------------------------------------------------------------------

def coincident_labels(labels: DataFrame) -> DataFrame:
    """Labels sharing region, family and exact place; one row per crowded place, so copies never pair up."""
    return labels.groupBy("region_id", "family", "geometry_type", "x", "y").agg(F.count("*").alias("n"), F.min("label_id").alias("first_label")).where("n > 1")


def region_conflicts(regions: DataFrame, buffer_m: float) -> DataFrame:
    """Pairs of regions that touch, or lie in different splits closer than the buffer. Meets on grid cells, each pair in one."""
    gap = lambda lo, hi: F.greatest(F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.lit(0.0))
    d = F.sqrt(gap("west", "east") ** 2 + gap("south", "north") ** 2)
    kind = F.when(F.col("distance_m") == 0, "overlap").when((F.col("a_split") != F.col("b_split")) & (F.col("distance_m") < buffer_m), "split_buffer")

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        met = placed_pairs(a, b, max(buffer_m * 4, 1.0), buffer_m).where("a_region_id < b_region_id").withColumn("distance_m", d).withColumn("conflict", kind)
        return met.where("conflict IS NOT NULL").select(F.col("a_region_id").alias("region_id"), F.col("b_region_id").alias("other_id"), "conflict", "distance_m")

    return pairs_once(regions.select("region_id", "split", "west", "south", "east", "north"), "region_id", pairs)


def uncovered_regions(regions: DataFrame, prints: DataFrame) -> DataFrame:
    """region_id of the rectangles that the union of their footprints ``prints`` (region_id, west .. north) does not cover.

    Exact: the footprints' sides cut each region into slabs between neighbouring x; in a slab, the footprints that span it
    cover it when, from south to north, each begins no farther than the ones before it reach. Sides are closed, so only a
    gap with an area counts; a region without width or height is covered as a line or a point. Footprints meet their slabs
    by number, so the rows are the spans themselves, never all pairs of a region's footprints and slabs. Regions with a
    null bound count as uncovered, footprints with one cover nothing.

    Most regions are settled before that: one footprint covers them whole, or one of 5 x 5 points of theirs lies in none.
    """
    box = ["region_id", "r_w", "r_s", "r_e", "r_n"]
    r = regions.select("region_id", *[F.col(c).alias("r_" + c[0]) for c in ("west", "south", "east", "north")]).distinct()
    near = r.join(prints.select("region_id", "west", "south", "east", "north"), "region_id").where("west <= r_e AND east >= r_w AND south <= r_n AND north >= r_s")
    clip = near.select(*box, F.greatest("west", "r_w").alias("x0"), F.least("east", "r_e").alias("x1"), F.greatest("south", "r_s").alias("y0"), F.least("north", "r_n").alias("y1"))
    clip = cut_lineage(clip.distinct())
    c, last_probe = F.col, 4
    at = lambda lo, hi, i: c(hi) if i == last_probe else c(lo) + (c(hi) - c(lo)) * (i / last_probe)
    held = lambda a, b, lo, hi, i: (c(a) <= at(lo, hi, i)) & (c(b) >= at(lo, hi, i))
    column = sum((F.when(held("y0", "y1", "r_s", "r_n", i), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(last_probe + 1)), F.lit(0)).cast("bigint")
    probed = clip.withColumn("_c", column).withColumn("_b", sum((F.when(held("x0", "x1", "r_w", "r_e", i), F.shiftleft("_c", (last_probe + 1) * i)).otherwise(F.lit(0)) for i in range(last_probe + 1)), F.lit(0)))
    alone = (c("x0") == c("r_w")) & (c("x1") == c("r_e")) & (c("y0") == c("r_s")) & (c("y1") == c("r_n"))
    judged = cut_lineage(probed.groupBy(*box).agg(F.bit_or("_b").alias("_b"), F.max(alone).alias("_whole")))
    held_all = judged.where(F.col("_b") == (1 << (last_probe + 1) ** 2) - 1)
    bare_at_once = r.join(held_all, box, "left_anti").select("region_id")  # null bounds too
    r = held_all.where("NOT _whole").select(*box)
    clip = clip.join(r, box, "left_semi")
    sides = r.select(*box, F.explode(F.array("r_w", "r_e")).alias("x")).unionByName(clip.select(*box, F.explode(F.array("x0", "x1")).alias("x"))).distinct()
    by_x = Window.partitionBy(*box).orderBy("x")
    cuts = cut_lineage(sides.select(*box, "x", F.row_number().over(by_x).alias("k"), F.lead("x").over(by_x).alias("_next")))
    # the last side starts no slab, unless it is the only one: a region without width
    slabs = cuts.where("_next IS NOT NULL OR k = 1").select(*box, "k")
    first = clip.join(cuts.select(*box, F.col("x").alias("x0"), F.col("k").alias("k0")), [*box, "x0"])
    spans = first.join(cuts.select(*box, F.col("x").alias("x1"), F.col("k").alias("k1")), [*box, "x1"])
    last = F.when(F.col("r_w") == F.col("r_e"), F.col("k1")).otherwise(F.col("k1") - 1)
    spans = spans.withColumn("_l", last).where("k0 <= _l").select(*box, F.explode(F.sequence("k0", "_l")).alias("k"), "y0", "y1")
    upward = Window.partitionBy(*box, "k").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("y0") > F.coalesce(F.max("y1").over(upward), F.col("r_s"))
    whole = spans.withColumn("_g", gap).groupBy(*box, "k").agg(F.max("_g").alias("gap"), F.max("y1").alias("top")).where("NOT gap AND top >= r_n").select(*box, "k")
    bare = slabs.join(whole, [*box, "k"], "left_anti")
    return bare.select("region_id").unionByName(bare_at_once).distinct()


def _break(df: DataFrame, rule: str, key: Column | str) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(rule).alias("rule"), k.cast("string").alias("key"))


def manifest_violations(t: dict[str, DataFrame], buffer_m: float, tol: float) -> DataFrame:
    """Every broken rule of a manifest as (rule, key)."""
    regions, labels, reviews = t["regions"], t["labels"], t["label_reviews"]
    rules = [_break(duplicate_keys(t[name], key), f"duplicate_{key}", key) for name, key in
             (("surveys", "survey_id"), ("regions", "region_id"), ("labels", "label_id"), ("labels", "feature_id"))]
    rules.append(_break(duplicate_keys(t["region_surveys"], "region_id", "survey_id"), "duplicate_survey_reference", "region_id"))
    rules.append(_break(duplicate_keys(t["region_reviews"], "region_id", "family"), "duplicate_family_review", "region_id"))
    split_groups = regions.groupBy("independence_group").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    rules.append(_break(split_groups, "group_spans_splits", "independence_group"))
    rules.append(_break(t["region_surveys"].join(t["surveys"], "survey_id", "left_anti"), "unknown_survey", "region_id"))
    prints = t["region_surveys"].join(t["surveys"], "survey_id")
    rules.append(_break(uncovered_regions(regions, prints), "region_exceeds_surveys", "region_id"))
    conflicts = region_conflicts(regions, buffer_m)
    rules.append(_break(conflicts, "region_conflict", F.concat_ws("|", "region_id", "other_id")))
    rules.append(_break(labels.join(regions, "region_id", "left_anti"), "unknown_region", "label_id"))
    away = labels.join(regions.select("region_id", "west", "south", "east", "north"), "region_id").where("x < west OR x > east OR y < south OR y > north")
    rules.append(_break(away, "label_outside_region", "label_id"))
    rules.append(_break(coincident_labels(labels), "coincident_labels", "first_label"))
    rules.append(_break(consecutive_revisions(reviews), "review_order", "label_id"))
    rules.append(_break(labels.join(reviews, "label_id", "left_anti"), "label_without_review", "label_id"))
    utm = F.floor(F.col("evaluation_epsg") / 100).isin(269, 326, 327)
    rules.append(_break(t["protocol"].where(~utm), "evaluation_crs", "evaluation_epsg"))
    rules.append(_break(t["protocol"].where(F.lit(buffer_m < 2 * tol)), "buffer_below_twice_tolerance", "evaluation_epsg"))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def manifest_digest(t: dict[str, DataFrame]) -> DataFrame:
    """One digest over all manifest tables, whatever their row order."""
    parts = None
    for name in sorted(t):
        d = fingerprint(t[name]).select(F.lit(name).alias("table"), "digest")
        parts = d if parts is None else parts.unionByName(d)
    return fingerprint(parts, "table", "digest")


def contract_violations(manifest: dict[str, DataFrame], header: DataFrame, preds: DataFrame, families: DataFrame) -> DataFrame:
    """Broken rules of a prediction set: dataset id, version, digest, undeclared families, duplicate ids, scores out of range.

    ``header``: one row (dataset_id, dataset_version, manifest_digest).
    """
    want = manifest["protocol"].select(F.col("dataset_id").alias("_i"), F.col("dataset_version").alias("_v")).crossJoin(F.broadcast(manifest_digest(manifest)))  # one row each
    both = header.crossJoin(F.broadcast(want))  # one row each
    rules = [_break(both.where("dataset_id <> _i"), "dataset_id", "dataset_id"), _break(both.where("dataset_version <> _v"), "dataset_version", "dataset_version"),
             _break(both.where("manifest_digest <> digest"), "manifest_digest", "manifest_digest"),
             _break(preds.join(families, "family", "left_anti"), "undeclared_family", "prediction_id"),
             _break(duplicate_keys(preds, "prediction_id"), "duplicate_prediction", "prediction_id"),
             _break(duplicate_keys(families, "family"), "duplicate_family", "family"),
             _break(preds.where("score IS NOT NULL AND (score < 0 OR score > 1)"), "score_range", "prediction_id")]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out

"""Region tables: per-region statistics, morphometrics and shape measures from member cells.

A labelled table is ``(survey_id, row, col, region_id, ...)``. Every measure is a hash aggregation that combines on the
map side, so one region holding a large share of the cells never gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscan.operators.blocks import BLOCK, BLOCK_KEYS, KEYS, pack, tiled
from fellscan.operators.components import FINISH_EDGES, connected_components, join_parts, label_grid
from fellscan.operators.focal import with_neighbour_flags
from fellscan.session import cut_lineage

REGION = ["survey_id", "region_id"]


def zonal(regions: DataFrame, surface: DataFrame) -> DataFrame:
    """Member cells with the surface columns at the same cell."""
    extra = [c for c in surface.columns if c in KEYS or c not in regions.columns]
    return regions.join(surface.select(*extra), KEYS)


def region_stats(labelled: DataFrame, col: str = "z", anchor: str = "center") -> DataFrame:
    """cells, min, max, sum, mean and centroid (mean index, plus half a cell when ``anchor='center'``)."""
    half = 0.5 if anchor == "center" else 0.0
    return labelled.groupBy(*REGION).agg(
        F.count("*").alias("cells"), F.min(col).alias("min_v"), F.max(col).alias("max_v"), F.sum(col).alias("sum_v"),
        F.avg(col).alias("mean_v"), (F.avg("row") + half).alias("centroid_row"), (F.avg("col") + half).alias("centroid_col"),
    )


def morphometric_aggs(z: str = "z", dx: float = 1.0, dy: float = 1.0) -> dict[str, Column]:
    """Aggregates shared by the batch and single-region forms; needs ``n4`` (edge neighbours inside the region)."""
    cell, n = dx * dy, F.count("*")
    area = n * cell
    depth = F.max(z) - F.min(z)
    volume = F.greatest((F.max(z) * n - F.sum(z)) * cell, F.lit(0.0))
    perimeter = F.sum((F.col("n4") < 4).cast("int")) * dx
    return {
        "cells": n, "area_m2": area.cast("double"), "depth_m": depth.cast("double"), "volume_m3": volume.cast("double"),
        "perimeter_m": perimeter.cast("double"),
        "circularity": F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(F.lit(0.0)),
        "k_value": F.when(volume > 0, area * depth / volume).otherwise(F.lit(0.0)),
    }


def batch_morphometrics(labelled: DataFrame, surface: DataFrame, res: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Per region: area, depth, volume, mean wall slope (when the surface has ``slope``), edge perimeter, circularity, k, bbox aspect."""
    flagged = with_neighbour_flags(labelled.select(*REGION, "row", "col"), block)
    cells = zonal(flagged, surface)
    height = F.max("row") - F.min("row") + 1
    width = F.max("col") - F.min("col") + 1
    aggs = {**morphometric_aggs("z", res, res), "elongation_bbox": F.least(height, width) / F.greatest(height, width),
            "centroid_row": F.avg("row"), "centroid_col": F.avg("col")}
    if "slope" in surface.columns:
        aggs["wall_slope_deg"] = F.avg("slope")
    return cells.groupBy(*REGION).agg(*[v.alias(k) for k, v in aggs.items()])


def region_metrics(cells: DataFrame, surface: DataFrame, res: float = 1.0, block: int = BLOCK) -> DataFrame:
    """The single-outline form of the same measures, plus the eigenvalue elongation."""
    return batch_morphometrics(cells, surface, res, block).drop("elongation_bbox").join(pca_elongation(cells), REGION)


def pca_elongation(cells: DataFrame) -> DataFrame:
    """sqrt(minor/major) of the member-cell covariance; 1 for fewer than three cells or a degenerate spread."""
    moments = cells.groupBy(*REGION).agg(
        F.count("*").alias("n"), F.var_samp("row").alias("vr"), F.var_samp("col").alias("vc"), F.covar_samp("row", "col").alias("cv")
    )
    mid = (F.col("vr") + F.col("vc")) / 2
    spread = F.sqrt(((F.col("vr") - F.col("vc")) / 2) ** 2 + F.col("cv") ** 2)
    value = F.when((F.col("n") < 3) | (mid + spread <= 0), F.lit(1.0)).otherwise(F.sqrt(F.greatest(mid - spread, F.lit(0.0)) / (mid + spread)))
    return moments.select(*REGION, value.alias("elongation_pca"))


def label_candidates(labelled: DataFrame, surface: DataFrame) -> DataFrame:
    """Regions as candidates: rim and floor elevation, depth, and a score that saturates at 3 m."""
    depth = F.max("z") - F.min("z")
    return zonal(labelled, surface).groupBy(*REGION).agg(
        F.count("*").alias("cells"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"),
        F.max("z").alias("rim_z"), F.min("z").alias("floor_z"), depth.alias("depth_m"), F.least(depth / 3.0, F.lit(1.0)).alias("score"),
    )


def select_regions(labelled: DataFrame, surface: DataFrame, min_area: float, max_area: float, limit: int | None = None,
                   dx: float = 1.0, dy: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Regions inside the area window that do not touch the survey's edge.

    With a ``limit`` only the largest of each survey (and value of ``by``, where given) are looked at, before edges are.
    """
    by = by or []
    sizes = labelled.groupBy(*REGION, *by).agg(
        F.count("*").alias("cells"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")
    ).where((F.col("cells") * dx * dy >= min_area) & (F.col("cells") * dx * dy <= max_area))
    if limit is not None:  # only where the caller asks for it; the filter is pushed below the exchange
        rank = F.row_number().over(Window.partitionBy("survey_id", *by).orderBy(F.desc("cells"), "region_id"))
        sizes = sizes.withColumn("_k", rank).where(F.col("_k") <= limit).drop("_k")
    edge = surface.groupBy("survey_id").agg(F.min("row").alias("s0"), F.max("row").alias("s1"), F.min("col").alias("t0"), F.max("col").alias("t1"))
    inner = sizes.join(edge, "survey_id").where("r0 > s0 AND r1 < s1 AND c0 > t0 AND c1 < t1")
    return inner.select(*REGION, *by, "cells", "r0", "r1", "c0", "c1")


def outline_edges(labelled: DataFrame) -> DataFrame:
    """Exposed cell sides as unit segments in lattice corners, region on the right-hand side of travel."""
    r, c = F.col("row"), F.col("col")
    sides = F.array(
        F.struct(F.lit("n").alias("side"), r.alias("r0"), c.alias("c0"), r.alias("r1"), (c + 1).alias("c1"), (r - 1).alias("nr"), c.alias("nc")),
        F.struct(F.lit("e").alias("side"), r.alias("r0"), (c + 1).alias("c0"), (r + 1).alias("r1"), (c + 1).alias("c1"), r.alias("nr"), (c + 1).alias("nc")),
        F.struct(F.lit("s").alias("side"), (r + 1).alias("r0"), (c + 1).alias("c0"), (r + 1).alias("r1"), c.alias("c1"), (r + 1).alias("nr"), c.alias("nc")),
        F.struct(F.lit("w").alias("side"), (r + 1).alias("r0"), c.alias("c0"), r.alias("r1"), c.alias("c1"), r.alias("nr"), (c - 1).alias("nc")),
    )
    out = labelled.select(*REGION, F.explode(sides).alias("s")).select(*REGION, "s.*")
    there = labelled.select("survey_id", F.col("row").alias("nr"), F.col("col").alias("nc"), "region_id")
    return out.join(there, ["survey_id", "region_id", "nr", "nc"], "left_anti").select(*REGION, "side", "r0", "c0", "r1", "c1")


def topology(labelled: DataFrame, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Per region: cells, polygon perimeter and hole count, the latter from the Euler number of its cells."""
    flagged = with_neighbour_flags(labelled.select(*REGION, "row", "col"), block)
    euler = F.count("*") - F.sum(F.col("link_e") + F.col("link_s")) + F.sum("quad")
    return flagged.groupBy(*REGION).agg(
        F.count("*").alias("cells"), F.sum(F.col("open_ew") * dy + F.col("open_ns") * dx).cast("double").alias("outline_m"),
        (1 - euler).alias("holes"),
    )


def _hull(points: np.ndarray) -> np.ndarray:
    order = np.lexsort((points[:, 1], points[:, 0]))
    pts = points[order]
    pts = pts[np.r_[True, (pts[1:] != pts[:-1]).any(axis=1)]]
    if len(pts) < 3:
        return pts
    # of points in one column only the first and last may be corners of the hull
    ends = np.r_[True, pts[1:, 0] != pts[:-1, 0]]
    pts = pts[ends | np.r_[ends[1:], True]]

    def half(seq: list) -> list:
        chain: list = []
        for p in seq:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    pts = pts.tolist()
    return np.array(half(pts) + half(pts[::-1]))


def min_rectangle(points: np.ndarray) -> tuple[float, float]:
    """Length and width of the smallest-area rectangle around the points (one side lies on a hull edge)."""
    hull = _hull(points)
    if len(hull) < 2:
        return 0.0, 0.0
    step = np.roll(hull, -1, axis=0) - hull
    norm = np.hypot(step[:, 0], step[:, 1])
    unit = step[norm > 0] / norm[norm > 0][:, None]
    along = unit @ hull.T
    across = np.stack([-unit[:, 1], unit[:, 0]], axis=1) @ hull.T
    a, b = np.ptp(along, axis=1), np.ptp(across, axis=1)
    length, width = np.maximum(a, b), np.minimum(a, b)
    best = np.lexsort((np.round(length, 6), np.round(a * b, 6)))[0]  # equal areas: the shorter rectangle
    return round(float(length[best]), 9), round(float(width[best]), 9)  # whole-number ratios compare exactly


def per_region(rows: DataFrame, order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each region, many regions a call: a task streams its regions in order and holds one of them
    beside a batch of rows, so small regions cost no call of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            s, r = pdf["survey_id"].to_numpy(), pdf["region_id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
            pieces = [pdf.iloc[a:b] for a, b in zip(starts, [*starts[1:], len(pdf)])]
            if held and tuple(held[0].iloc[0][REGION]) == (s[0], r[0]):
                held.append(pieces.pop(0))
            if pieces:
                whole = ([pd.concat(held)] if held else []) + pieces[:-1]
                held = [pieces[-1]]
                if whole:
                    yield pd.concat([work(p) for p in whole])
        if held:
            yield work(pd.concat(held))

    return rows.repartition(*REGION).sortWithinPartitions(*REGION, *order).mapInPandas(run, schema)


def shape_metrics(labelled: DataFrame, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK, only: Column | None = None) -> DataFrame:
    """Area, length and width of the minimum rotated rectangle, aspect, rectangularity, circularity and holes.

    Only the first and last cell of each grid line can carry a hull corner, so that is all the per-region step gets.
    ``only`` is a condition on what native aggregates know of a region (cells, outline_m, holes, and ``diagonal_m`` of its
    bounding box, which no rectangle is longer than); regions outside it get no rectangle and no row.
    """
    facts = topology(labelled, dx, dy, block)
    if only is not None:
        span = lambda c, step: (F.max(c) - F.min(c) + 1) * step
        box = labelled.groupBy(*REGION).agg(F.hypot(span("row", dy), span("col", dx)).alias("diagonal_m"))
        facts = cut_lineage(facts.join(box, REGION).where(only).drop("diagonal_m"))
        labelled = labelled.join(facts.select(*REGION), REGION, "left_semi")
    lines = labelled.groupBy(*REGION, "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))

    def rectangle(pdf: pd.DataFrame) -> pd.DataFrame:
        r, a, b = (pdf[c].to_numpy(float) for c in ("row", "c0", "c1"))
        corners = np.concatenate([np.stack([x * dx, y * dy], axis=1) for x in (a, b + 1) for y in (r, r + 1)])
        length, width = min_rectangle(corners)
        return pd.DataFrame({"survey_id": [pdf["survey_id"].iloc[0]], "region_id": [pdf["region_id"].iloc[0]], "length_m": [length], "width_m": [width]})

    types = {f.name: f.dataType.simpleString() for f in labelled.schema}
    boxes = per_region(lines, ["row"], rectangle, f"survey_id {types['survey_id']}, region_id {types['region_id']}, length_m double, width_m double")
    area = F.col("cells") * (dx * dy)
    return facts.join(boxes, REGION).select(
        *REGION, "cells", area.cast("double").alias("area_m2"), "length_m", "width_m", "outline_m", "holes",
        (F.col("length_m") / F.greatest("width_m", F.lit(1e-9))).alias("aspect_ratio"),
        (area / F.greatest(F.col("length_m") * F.col("width_m"), F.lit(1e-9))).alias("rectangularity"),
        F.least(4 * math.pi * area / F.greatest(F.col("outline_m") ** 2, F.lit(1e-9)), F.lit(1.0)).alias("circularity"),
    )


def interior_runs(labelled: DataFrame, width: int = 64, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(survey_id, region_id, row, c0, c1): the runs of cells enclosed by each region, cut off from outside under 8-connection.

    An enclosed cell lies between two members of its row, so only the gaps of rows count, not the cells of a bounding box.
    A gap is open where the row above or below has none of the region's members as far out as the gap reaches (one cell
    beyond its ends, as corners connect). Gaps of neighbouring rows meet in strips of ``width`` columns, which bounds the
    pairs of a strip; the components of gaps without an open one are the interiors. Regions may share gaps: each has its
    own copy. Nothing of a region is held in memory, so none is too large.
    """
    line = [*REGION, "row"]
    cells = labelled.select(*line, "col")
    before = F.lag("col").over(Window.partitionBy(*line).orderBy("col"))
    gaps = cells.withColumn("_p", before).where(F.col("col") - F.col("_p") > 1)
    gaps = cut_lineage(gaps.select(*line, (F.col("_p") + 1).alias("c0"), (F.col("col") - 1).alias("c1")))
    ends = cells.groupBy(*line).agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    # only rows beside a gap are looked up; a row without members is outside from end to end
    beside = gaps.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("_at", F.col("row") + F.col("_d"))
    ends = ends.withColumnRenamed("row", "_at")
    reaches = F.coalesce((F.col("c0") - 1 < F.col("lo")) | (F.col("c1") + 1 > F.col("hi")), F.lit(True))
    gap_id = pack("row", "c0")
    facts = beside.join(ends, [*REGION, "_at"], "left").groupBy(*line, "c0", "c1").agg(F.max(reaches).alias("open"))
    scope = F.concat_ws(":", "region_id", "survey_id")
    facts = cut_lineage(facts.select(*line, "c0", "c1", "open", scope.alias("scope"), gap_id.alias("id")))
    strips = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    upper = facts.select("scope", (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("id").alias("u")).withColumn("_s", strips(F.col("a0") - 1, F.col("a1") + 1))
    lower = facts.select("scope", "row", "c0", "c1", F.col("id").alias("v")).withColumn("_s", strips(F.col("c0"), F.col("c1")))
    edges = upper.join(lower, ["scope", "row", "_s"]).where("a0 - 1 <= c1 AND c0 <= a1 + 1").select("scope", "u", "v")
    roots = connected_components(edges, finish_edges)
    parts = facts.join(roots, ["scope", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    shut = parts.groupBy("scope", "root").agg(F.max("open").alias("open")).where("NOT open").select("scope", "root")
    return parts.join(shut, ["scope", "root"], "left_semi").select(*line, "c0", "c1")


def interiors(labelled: DataFrame, width: int = 64, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Cells enclosed by each region: not members, and cut off from outside under 8-connection."""
    return interior_runs(labelled, width, finish_edges).withColumn("col", F.explode(F.sequence("c0", "c1"))).select(*REGION, "row", "col")


def representative_cell(labelled: DataFrame) -> DataFrame:
    """The member cell nearest the centroid (ties by row, then column)."""
    mid = labelled.groupBy(*REGION).agg(F.avg("row").alias("mr"), F.avg("col").alias("mc"))
    d = F.round((F.col("row") - F.col("mr")) ** 2 + (F.col("col") - F.col("mc")) ** 2, 9)
    return (
        labelled.join(mid, REGION).groupBy(*REGION).agg(F.min(F.struct(d.alias("d"), "row", "col")).alias("m"))
        .select(*REGION, F.col("m.row").alias("row"), F.col("m.col").alias("col"))
    )


def _supported_block(col: str, threshold: float, signs: tuple[int, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, v = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf[col].to_numpy(float)
        r0, c0 = r.min() - 1, c.min() - 1
        value = np.full((r.max() - r0 + 2, c.max() - c0 + 2), np.nan)
        value[r - r0, c - c0] = v

        def all_four(flag: np.ndarray) -> np.ndarray:
            out = np.zeros_like(flag)
            out[1:-1, 1:-1] = flag[1:-1, 1:-1] & flag[:-2, 1:-1] & flag[2:, 1:-1] & flag[1:-1, :-2] & flag[1:-1, 2:]
            return out

        inside = all_four(np.isfinite(value))
        clear = all_four(inside)  # an interior cell beside a non-interior one is exposed
        own = np.zeros_like(inside)
        at = pdf["_own"].to_numpy()
        own[r[at] - r0, c[at] - c0] = True
        frames = []
        for sign in signs:
            mask = own & inside & (np.nan_to_num(value) * sign >= threshold)
            labels = label_grid(mask)
            rows, cols = np.nonzero(mask)
            packed = (rows + r0).astype("int64") * 4294967296 + (cols + c0)
            part = pd.Series(packed).groupby(labels[rows, cols]).transform("min")
            frames.append(pd.DataFrame({"survey_id": pdf["survey_id"].iloc[0], "row": rows + r0, "col": cols + c0, col: value[rows, cols], "sign": sign,
                                        "_exposed": ~clear[rows, cols], "part": part.to_numpy("int64")}))
        return pd.concat(frames, ignore_index=True)

    return run


def supported_mask(surface: DataFrame, col: str, threshold: float, sign: int = 1, block: int = BLOCK) -> DataFrame:
    """Labelled cells with ``sign*col >= threshold`` whose whole region stays clear of unsupported ground."""
    return supported_masks(surface, col, threshold, (sign,), block).drop("sign")


def supported_masks(surface: DataFrame, col: str, threshold: float, signs: tuple[int, ...] = (1, -1), block: int = BLOCK) -> DataFrame:
    """The masks of several signs from one pass over the surface (``sign`` column).

    Interior means the cell and its four neighbours have a value; any region beside (or on) a non-interior cell goes.
    One exchange feeds a block kernel that thresholds, tests support and labels; only masked cells come out.
    """
    valid = surface.where(F.col(col).isNotNull()).select("survey_id", "row", "col", F.col(col).cast("double").alias(col))
    types = {f.name: f.dataType.simpleString() for f in valid.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in ("survey_id", "row", "col", col)) + ", sign int, _exposed boolean, part bigint"
    parts = tiled(valid, 2, block, exchange=False).groupBy(*BLOCK_KEYS).applyInPandas(_supported_block(col, threshold, signs), schema)
    labelled = join_parts(parts, block, same=["sign"])
    bad = labelled.where("_exposed").select(*REGION, "sign").distinct()
    return labelled.drop("_exposed").join(bad, [*REGION, "sign"], "left_anti")

"""Point clouds to grids: density, multi-return share, mean and inverse-distance elevation, ground filtering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscan.operators.blocks import BLOCK, BLOCK_KEYS, KEYS, tiled

VEGETATION = [3, 4, 5]
GROUND = 2


def exclude_vegetation(points: DataFrame) -> DataFrame:
    return points.where(~F.col("classification").isin(VEGETATION))


def extent(points: DataFrame) -> DataFrame:
    return points.groupBy("survey_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _shape(cell: float) -> tuple[Column, Column]:
    cols = F.greatest(F.ceil((F.col("x1") - F.col("x0")) / cell), F.lit(1))
    rows = F.greatest(F.ceil((F.col("y1") - F.col("y0")) / cell), F.lit(1))
    return rows, cols


def _binned(points: DataFrame, bounds: DataFrame, cell: float) -> DataFrame:
    """Points with lattice row (from the top) and column; the far edges fall into the last cell."""
    rows, cols = _shape(cell)
    at = lambda v, n: F.greatest(F.least(F.floor(v / cell), n - 1), F.lit(0)).cast("bigint")
    return points.join(bounds, "survey_id").withColumns(
        {"row": at(F.col("y1") - F.col("y"), rows), "col": at(F.col("x") - F.col("x0"), cols)}).drop("x0", "x1", "y0", "y1")


def lattice(bounds: DataFrame, cell: float) -> DataFrame:
    """Every cell of every survey's bounding lattice, generated row by row across the cluster."""
    rows, cols = _shape(cell)
    lines = bounds.select("survey_id", cols.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), rows - 1)).alias("row"))
    return lines.repartition("survey_id", "row").select("survey_id", "row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("col"))


def point_density(points: DataFrame, cell: float = 2.0) -> DataFrame:
    """Counts and z-scores on the full lattice; mean and spread are taken over occupied cells only."""
    bounds = extent(points)
    counts = _binned(points.select("survey_id", "x", "y"), bounds, cell).groupBy(*KEYS).agg(F.count("*").alias("n"))
    stats = counts.groupBy("survey_id").agg(F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("std_n"))
    std = F.when(F.col("std_n") < 1e-10, F.lit(1.0)).otherwise(F.col("std_n"))
    grid = lattice(bounds, cell).join(counts, KEYS, "left").join(stats, "survey_id")
    density = F.coalesce("n", F.lit(0))
    return grid.select(*KEYS, density.alias("density"), ((density - F.col("mean_n")) / std).alias("z_score"))


def multi_return_ratio(points: DataFrame, cell: float = 5.0) -> DataFrame:
    """Share of non-vegetation points with several returns per cell; empty cells are 0. Bounds cover all points."""
    bounds = extent(points)
    kept = _binned(exclude_vegetation(points).select("survey_id", "x", "y", "number_of_returns"), bounds, cell)
    share = kept.groupBy(*KEYS).agg(F.avg((F.col("number_of_returns") > 1).cast("double")).alias("ratio"))
    return lattice(bounds, cell).join(share, KEYS, "left").select(*KEYS, F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def ground_share(points: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Ground share per survey and whether it counts as already classified (above the threshold)."""
    share = F.avg((F.col("classification") == GROUND).cast("double"))
    return points.groupBy("survey_id").agg(share.alias("ground_share")).withColumn("pre_classified", F.col("ground_share") > threshold)


def _covered(points: DataFrame, res: float, radius: float, bounds: DataFrame | None = None) -> DataFrame:
    """Each point once per cell whose centre lies within the radius; carries the distance ``d``."""
    reach = math.ceil(radius / res)
    top = extent(points) if bounds is None else bounds
    at = points.join(top, "survey_id").withColumns({"_u": (F.col("x") - F.floor("x0")) / res, "_v": (F.ceil("y1") - F.col("y")) / res}).drop("x0", "x1", "y0", "y1")
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)])
    out = at.withColumn("_m", F.explode(moves)).withColumns(
        {"row": (F.floor("_v") + F.col("_m.r")).cast("bigint"), "col": (F.floor("_u") + F.col("_m.c")).cast("bigint")})
    d = F.sqrt(((F.col("col") + 0.5 - F.col("_u")) * res) ** 2 + ((F.col("row") + 0.5 - F.col("_v")) * res) ** 2)
    return out.withColumn("d", d).where(F.col("d") <= radius).drop("_u", "_v", "_m")


def grid_mean(points: DataFrame, res: float = 1.0, radius: float = 1.5, fill: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """Mean elevation of the points within ``radius`` of each cell centre; bare cells beside a value take the
    inverse-distance mean of their neighbours when ``fill``. Rows count from the survey's top, columns from its left, by
    the extent of the points given or by ``bounds``."""
    grid = _covered(points.select("survey_id", "x", "y", "z"), res, radius, bounds).groupBy(*KEYS).agg(F.avg("z").alias("z"))
    if not fill:
        return grid
    around = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(1 / math.hypot(r, c)).alias("w"))
                       for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    near = grid.select("survey_id", "row", "col", "z", F.explode(around).alias("m")).select(
        "survey_id", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"), "z", F.col("m.w").alias("w"))
    filled = near.groupBy(*KEYS).agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z"))
    return grid.unionByName(filled.join(grid.select(*KEYS), KEYS, "left_anti"))


def grid_idw(points: DataFrame, res: float = 1.0, power: float = 1.0, radius: float | None = None) -> DataFrame:
    """Inverse-distance elevation per cell; a point on the centre takes the cell."""
    reach = radius if radius is not None else res * math.sqrt(2)
    near = _covered(points.select("survey_id", "x", "y", "z"), res, reach)
    w = 1 / F.pow(F.greatest("d", F.lit(1e-9)), F.lit(power))
    exact = F.avg(F.when(F.col("d") < 1e-9, F.col("z")))
    return near.groupBy(*KEYS).agg(F.coalesce(exact, F.sum(F.col("z") * w) / F.sum(w)).alias("z"))


def full_return(points: DataFrame, res: float = 1.0) -> DataFrame:
    """Inverse-distance grid of the unclassified, ground and low-point classes (1, 2, 7)."""
    return grid_idw(points.where(F.col("classification").isin(1, 2, 7)), res)


def _sliding(a: np.ndarray, half: int, op) -> np.ndarray:
    """Centred running minimum or maximum along both axes, edges held by the neutral value."""
    neutral = np.inf if op is np.minimum else -np.inf
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half, half)
        wide = np.pad(a, pad, constant_values=neutral)
        n, span, reach = a.shape[axis], 1, 2 * half + 1
        while span * 2 <= reach:  # doubling: log(width) passes whatever the window
            wide = op(np.take(wide, range(wide.shape[axis] - span), axis), np.take(wide, range(span, wide.shape[axis]), axis))
            span *= 2
        rest = reach - span
        a = op(np.take(wide, range(n), axis), np.take(wide, range(rest, rest + n), axis))
    return a


def _ground_surface(slope: float, window: float, res: float):
    steps = range(1, math.ceil(window / res) + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = r.min(), c.min()
        z = np.full((r.max() - r0 + 1, c.max() - c0 + 1), np.inf)
        z[r - r0, c - c0] = pdf["z"].to_numpy(float)
        last, off = z, np.zeros(z.shape, bool)
        for half in steps:
            eroded = _sliding(z, half, np.minimum)
            opened = _sliding(np.where(np.isfinite(eroded), eroded, -np.inf), half, np.maximum)
            off |= np.isfinite(last) & (last - opened > slope * half * res)
            last = opened
        own = pdf[pdf["_own"].to_numpy()]
        hit = off[own["row"].to_numpy() - r0, own["col"].to_numpy() - c0]
        return own.loc[~hit, ["survey_id", "row", "col", "z"]]

    return run


def smrf(points: DataFrame, slope: float = 0.15, window: float = 18, threshold: float = 0.5, scalar: float = 1.25, res: float = 1.0,
         block: int = BLOCK) -> DataFrame:
    """Points plus ``ground``: progressive morphological opening of the grid minima, then a height test per point.

    Opening with growing squares of the minima equals opening the previous result, so one halo of twice the largest
    window gives every block exact surfaces. The height limit grows with the local slope of the ground surface.
    """
    from fellscan.operators.focal import derive, product

    top = extent(points)
    placed = points.join(top, "survey_id").withColumns(
        {"row": F.floor((F.ceil("y1") - F.col("y")) / res), "col": F.floor((F.col("x") - F.floor("x0")) / res)}).drop("x0", "x1", "y0", "y1")
    minima = placed.groupBy(*KEYS).agg(F.min("z").alias("z"))
    halo = 2 * math.ceil(window / res)
    types = {f.name: f.dataType.simpleString() for f in minima.schema}
    ground = tiled(minima, halo, max(block, halo), exchange=False).groupBy(*BLOCK_KEYS).applyInPandas(
        _ground_surface(slope, window, res), ", ".join(f"{k} {types[k]}" for k in (*KEYS, "z")))
    tilt = derive(ground, {"_g": F.tan(F.radians(product("slope_gradient", res, res)))}, block).select(*KEYS, F.col("z").alias("_z"), "_g")
    limit = threshold + scalar * F.coalesce("_g", F.lit(0.0))
    return placed.join(tilt, KEYS, "left").withColumn("ground", F.coalesce(F.abs(F.col("z") - F.col("_z")) <= limit, F.lit(False))).drop("_z", "_g", "row", "col")

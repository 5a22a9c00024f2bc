"""Resampling surveys to Web-Mercator tiles, filling small gaps, patch grids for models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscan.functions.geodesy import with_lonlat, with_utm
from fellscan.functions.scalars import tile_position
from fellscan.operators.blocks import KEYS
from fellscan.operators.focal import dilate


def to_mercator(surface: DataFrame, survey: DataFrame, z: int, size: int = 512, col: str = "z") -> DataFrame:
    """(z, x, y, px, py, value): bilinear values at pixel centres, null-free; first source by (resolution, survey) wins.

    A pixel needs all four surrounding cell centres. Pixels are found from the cells: each cell's footprint names the
    few pixels whose centres can lie in the unit square to its lower right, so no tile is rendered without ground.
    ``survey``: survey_id, epsg (UTM), x0, y0, dx, dy, resolution_m.
    """
    grid = survey.select("survey_id", "epsg", "x0", "y0", "dx", "dy", "resolution_m")
    zone, south = (F.col("epsg") % 100).cast("int"), F.floor(F.col("epsg") / 100) == 327
    pixels = float(size)
    placed = surface.select(*KEYS, F.col(col).cast("double").alias("v")).join(grid, "survey_id")
    placed = with_lonlat(placed, F.col("x0") + (F.col("col") + 0.5) * F.col("dx"), F.col("y0") - (F.col("row") + 0.5) * F.col("dy"), zone, south, "_lon", "_lat")
    fx, fy = tile_position("_lon", "_lat", F.lit(z))
    cells = placed.withColumns({"fx": fx * pixels, "fy": fy * pixels}).drop("_lon", "_lat")
    # each cell is one corner of up to four squares of cell centres; gathering by square needs a single exchange
    corners = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    spread = cells.withColumn("k", F.explode(corners)).withColumns({"row": F.col("row") - F.col("k.r"), "col": F.col("col") - F.col("k.c")})
    at = lambda r, c: F.max(F.when((F.col("k.r") == r) & (F.col("k.c") == c), F.col("v")))
    quad = spread.groupBy(*KEYS).agg(
        F.count("*").alias("n"), at(0, 0).alias("v00"), at(0, 1).alias("v01"), at(1, 0).alias("v10"), at(1, 1).alias("v11"),
        F.min("fx").alias("fx0"), F.max("fx").alias("fx1"), F.min("fy").alias("fy0"), F.max("fy").alias("fy1"),
        *[F.first(c).alias(c) for c in ("epsg", "x0", "y0", "dx", "dy", "resolution_m")]).where("n = 4")
    # pixel centres between the outermost corners; the margin only covers rounding
    first = lambda a: F.ceil(F.col(f"f{a}0") - 0.5 - 1e-6)
    last = lambda a: F.floor(F.col(f"f{a}1") - 0.5 + 1e-6)
    some = quad.where((first("x") <= last("x")) & (first("y") <= last("y")))
    hit = some.withColumn("gx", F.explode(F.sequence(first("x"), last("x")))).withColumn("gy", F.explode(F.sequence(first("y"), last("y"))))
    n = 2.0**z * pixels
    hit = hit.withColumns({"_lon": (F.col("gx") + 0.5) / n * 360 - 180, "_lat": F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (F.col("gy") + 0.5) / n))))})
    hit = with_utm(hit, F.col("_lon"), F.col("_lat"), zone)
    u = (F.col("east") - F.col("x0")) / F.col("dx") - F.col("col") - 0.5
    w = (F.col("y0") - F.col("north")) / F.col("dy") - F.col("row") - 0.5
    hit = hit.withColumns({"u": u, "w": w}).where("u >= 0 AND u < 1 AND w >= 0 AND w < 1")
    value = (1 - F.col("w")) * ((1 - F.col("u")) * F.col("v00") + F.col("u") * F.col("v01")) + F.col("w") * ((1 - F.col("u")) * F.col("v10") + F.col("u") * F.col("v11"))
    best = hit.groupBy("gx", "gy").agg(F.min(F.struct("resolution_m", "survey_id", value.alias("value"))).alias("m"))
    tile = lambda g: F.floor(F.col(g) / size).cast("bigint")
    return best.select(F.lit(z).alias("z"), tile("gx").alias("x"), tile("gy").alias("y"), F.pmod("gx", F.lit(size)).cast("int").alias("px"),
                       F.pmod("gy", F.lit(size)).cast("int").alias("py"), F.col("m.value").alias("value"))


def fill_gaps(s: DataFrame, max_cells: int = 30, col: str = "z") -> DataFrame:
    """Absent cells inside the survey's bounds take the nearest present value within ``max_cells`` (ties: smaller row, then column).

    A gap cell's nearest value lies on the rim of present ground, and squared distance splits by axis: the nearest rim
    cell of each column first, then the nearest over columns. Each step is a combinable minimum.
    """
    box = s.groupBy("survey_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    have = s.select(*KEYS, F.col(col).alias("_v"))
    rim = dilate(dilate(have, "square").join(have.select(*KEYS), KEYS, "left_anti"), "square").join(have, KEYS)  # present cells beside a gap
    reach = rim.withColumn("_dr", F.explode(F.sequence(F.lit(-max_cells), F.lit(max_cells)))).join(box, "survey_id").where(
        (F.col("row") + F.col("_dr") >= F.col("r0")) & (F.col("row") + F.col("_dr") <= F.col("r1")))
    # first along columns: per (gap row, column) the nearest present cell of that column, then along the row
    vertical = reach.groupBy("survey_id", (F.col("row") + F.col("_dr")).alias("row"), "col", "c0", "c1").agg(F.min(F.struct((F.col("_dr") * F.col("_dr")).alias("d"), F.col("row").alias("sr"), "_v")).alias("m"))
    across = vertical.withColumn("_dc", F.explode(F.sequence(F.lit(-max_cells), F.lit(max_cells)))).where((F.col("col") + F.col("_dc") >= F.col("c0")) & (F.col("col") + F.col("_dc") <= F.col("c1")))
    d2 = F.col("m.d") + F.col("_dc") * F.col("_dc")
    nearest = across.where(d2 <= max_cells * max_cells).groupBy("survey_id", "row", (F.col("col") + F.col("_dc")).alias("col")).agg(
        F.min(F.struct(d2.alias("d"), F.col("m.sr").alias("sr"), F.col("col").alias("sc"), F.col("m._v").alias("v"))).alias("b"))
    gaps = nearest.join(have.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.col("b.v").alias(col))
    return s.select(*KEYS, col).unionByName(gaps)


def patches(s: DataFrame, size: int, overlap: int) -> DataFrame:
    """Cells copied into every overlapping patch that holds them: adds patch_row, patch_col (lattice origin of the patch)."""
    stride = size - overlap
    starts = lambda c: F.sequence(F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)), F.floor(F.col(c) / stride))
    placed = s.withColumn("patch_row", F.explode(starts("row"))).withColumn("patch_col", F.explode(starts("col")))
    return placed.withColumns({"patch_row": F.col("patch_row") * stride, "patch_col": F.col("patch_col") * stride})


def stitch(preds: DataFrame, value: str = "p") -> DataFrame:
    """Average the overlapping predictions of each cell."""
    return preds.groupBy(*KEYS).agg(F.avg(value).alias(value))

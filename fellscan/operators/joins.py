"""Spatial joins as equi-joins on buckets: distance, rectangle, point-in-polygon, nearest cell.

Every theta join here first meets on a bucket key, so it shuffles by that key and AQE can split a crowded bucket;
none falls back to a nested loop over the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscan.functions.scalars import EARTH_M, M_PER_DEG, haversine_m, tile_bounds, tile_position
from fellscan.operators import rects
from fellscan.operators.blocks import KEYS
from fellscan.session import cut_lineage


def _axes(lon: Column, lat: Column, coords: str) -> list[Column]:
    """Cartesian metres whose straight-line distance never exceeds the real one."""
    if coords == "metric":
        return [lon.cast("double"), lat.cast("double")]
    p, q = F.radians(lat), F.radians(lon)
    return [EARTH_M * F.cos(p) * F.cos(q), EARTH_M * F.cos(p) * F.sin(q), EARTH_M * F.sin(p)]


def within_distance(a: DataFrame, b: DataFrame, metres: float, coords: str = "lonlat", ax: str = "lon", ay: str = "lat",
                    bx: str = "lon", by: str = "lat", a_prefix: str = "a_", b_prefix: str = "b_", keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows at most ``metres`` apart (great circle, or plane for ``metric``), with ``distance_m``.

    Buckets are cubes of side 2m: a probe reaches at most two of them per axis, and cubes work at the poles and across
    the date line alike. ``keys`` are extra equality keys present on both sides.
    """
    keys = keys or []
    side = 2 * metres * (1 + 1e-9) if metres > 0 else 1.0
    left = a.select(*[F.col(c).alias(a_prefix + c) for c in a.columns], *[F.col(k).alias(f"_k_{k}") for k in keys])
    right = b.select(*[F.col(c).alias(b_prefix + c) for c in b.columns], *[F.col(k).alias(f"_k_{k}") for k in keys])
    buckets = [f"_b{i}" for i in range(2 if coords == "metric" else 3)]
    for name, axis in zip(buckets, _axes(F.col(a_prefix + ax), F.col(a_prefix + ay), coords)):
        left = left.withColumn(name, F.floor(axis / side))
    for name, axis in zip(buckets, _axes(F.col(b_prefix + bx), F.col(b_prefix + by), coords)):
        right = right.withColumn(name, F.explode(F.sequence(F.floor((axis - metres) / side), F.floor((axis + metres) / side))))
    x1, y1, x2, y2 = (F.col(c) for c in (a_prefix + ax, a_prefix + ay, b_prefix + bx, b_prefix + by))
    dist = F.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) if coords == "metric" else haversine_m(x1, y1, x2, y2)
    on = buckets + [f"_k_{k}" for k in keys]
    return left.join(right, on).drop(*on).withColumn("distance_m", dist).where(F.col("distance_m") <= metres)


def count_within(a: DataFrame, b: DataFrame, metres: float, key: str, coords: str = "lonlat") -> DataFrame:
    """Rows of ``b`` near each row of ``a``, zero included."""
    pairs = within_distance(a.select(key, "lon", "lat"), b.select("lon", "lat"), metres, coords)
    counts = pairs.groupBy(F.col(f"a_{key}").alias(key)).agg(F.count("*").alias("near"))
    return a.join(counts, key, "left").withColumn("near", F.coalesce("near", F.lit(0)))


def rect_intersects(a: str, b: str) -> Column:
    """Strict overlap of rectangles held in ``{a}west`` ... ``{b}north`` columns."""
    c = F.col
    return (c(f"{a}east") > c(f"{b}west")) & (c(f"{a}west") < c(f"{b}east")) & (c(f"{a}north") > c(f"{b}south")) & (c(f"{a}south") < c(f"{b}north"))


def _cells(prefix: str, size: float) -> tuple[Column, Column]:
    span = lambda lo, hi: F.sequence(F.floor(F.col(prefix + lo) / size), F.floor(F.col(prefix + hi) / size))
    return span("west", "east"), span("south", "north")


PLACE = ["_g", "_gx", "_gy"]


def placed_pairs(a: DataFrame, b: DataFrame, size: float, pad: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rectangles (``a_``/``b_`` prefixed) that may come within ``pad`` of each other, every pair at one place only.

    A rectangle of ``a`` lies in the one grid cell of its south-west corner; those of ``b`` are copied to the cells where a
    corner of a rectangle near them can be. Grids follow the rectangles of ``a`` by powers of two of their longer side, not
    below a quarter of ``size``. All pairs of a row of ``a`` are in one cell and its columns ``_g, _gx, _gy`` stay, so what is
    grouped by them needs no exchange of pairs.
    """
    keys, c = keys or [], F.col
    spark = a.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # pairs outnumber rows, so partitions are not merged by size
    side = F.greatest(c("east") - c("west"), c("north") - c("south"), F.lit(size / 4))
    graded = a.withColumn("_g", F.when(side < 1e300, F.ceil(F.log2(side)).cast("int"))).where("_g IS NOT NULL")
    found = graded.groupBy("_g").agg(F.max((c("east") - c("west")).cast("double")).alias("w"), F.max((c("north") - c("south")).cast("double")).alias("h")).collect()  # powers of two, so a handful
    grades = F.array(*[F.struct(F.lit(r["_g"]).alias("g"), F.lit(2.0 ** r["_g"]).alias("step"), F.lit(max(r["w"], 0.0)).alias("w"), F.lit(max(r["h"], 0.0)).alias("h")) for r in found]
                     or [F.struct(F.lit(0).alias("g"), F.lit(1.0).alias("step"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))])
    step = F.pow(F.lit(2.0), c("_g"))
    left = graded.withColumns({"_gx": F.floor(c("west") / step), "_gy": F.floor(c("south") / step)})
    left = left.select(*[c(x).alias("a_" + x) for x in a.columns], *[c(k).alias(f"_k_{k}") for k in keys], *PLACE)
    # the margin only covers rounding
    span = lambda lo, hi, most: F.sequence(F.floor((c(lo) - c(f"_s.{most}") - pad) / c("_s.step") - 1e-6), F.floor((c(hi) + pad) / c("_s.step") + 1e-6))
    right = b.withColumn("_s", F.explode(grades)).withColumn("_gx", F.explode(span("west", "east", "w"))).withColumn("_gy", F.explode(span("south", "north", "h"))).withColumn("_g", c("_s.g"))
    on = PLACE + [f"_k_{k}" for k in keys]
    right = right.select(*[c(x).alias("b_" + x) for x in b.columns], *[c(k).alias(f"_k_{k}") for k in keys], *PLACE)
    return left.repartition(n, *on).join(right.repartition(n, *on), on).drop(*on[3:])


def repeated(df: DataFrame, key: str) -> DataFrame | None:
    """Values of a key that come twice, as ``_many``; None where there are none. 64 neighbouring whole numbers are looked for as one word of bits."""
    whole = df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole:
        bit = F.expr(f"shiftleft(1L, CAST(CAST(`{key}` AS BIGINT) & 63 AS INT))")
        words = df.groupBy(F.shiftright(F.col(key).cast("bigint"), 6).alias("_word")).agg(F.count("*").alias("_n"), F.bit_or(bit).alias("_seen"))
        if words.where("_n > coalesce(bit_count(_seen), 1)").isEmpty():
            return None
    many = df.groupBy(F.col(key).alias("_many")).agg(F.count("*").alias("_n")).where("_n > 1").select("_many")
    return many if whole or not many.isEmpty() else None


def pairs_once(df: DataFrame, key: str, pairs: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``pairs(df, df)`` without equal rows. Only rows whose key comes twice can give a pair twice; no other pair is shuffled."""
    many = repeated(df, key)
    if many is None:
        return pairs(df, df)
    same = F.col(key).eqNullSafe(F.col("_many"))
    one, more = df.join(many, same, "left_anti"), df.join(many, same, "left_semi").distinct()
    return pairs(one, one).unionByName(pairs(one, more).unionByName(pairs(more, one)).unionByName(pairs(more, more)).distinct())


def rect_join(a: DataFrame, b: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping rectangles (``a_``/``b_`` prefixed), each once. Meets on grid cells of ``size`` degrees or metres."""
    return placed_pairs(a, b, size, keys=keys).where(rect_intersects("a_", "b_")).drop(*PLACE)


def points_in_rects(points: DataFrame, rects: DataFrame, size: float, x: str = "lon", y: str = "lat", closed: bool = False) -> DataFrame:
    """Points joined to the rectangles holding them (strict interior unless ``closed``); rectangle columns get ``r_``."""
    xs, ys = _cells("r_", size)
    spread = rects.select(*[F.col(c).alias("r_" + c) for c in rects.columns]).withColumn("_gx", F.explode(xs)).withColumn("_gy", F.explode(ys))
    placed = points.withColumn("_gx", F.floor(F.col(x) / size)).withColumn("_gy", F.floor(F.col(y) / size))
    px, py, c = F.col(x), F.col(y), F.col
    inside = (px > c("r_west")) & (px < c("r_east")) & (py > c("r_south")) & (py < c("r_north"))
    if closed:
        inside = (px >= c("r_west")) & (px <= c("r_east")) & (py >= c("r_south")) & (py <= c("r_north"))
    return placed.join(spread, ["_gx", "_gy"]).where(inside).drop("_gx", "_gy")


def in_any_rect(points: DataFrame, rects: DataFrame, size: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points strictly inside at least one rectangle, each row once.

    Equal rectangles count once. The grid is the finest, from ``size`` down, on which rectangles touch four cells on
    average; in a cell that some rectangle covers whole, it stands for all others.
    """
    c, box = F.col, ["west", "south", "east", "north"]
    rects = cut_lineage(rects.select(*[c(b).cast("double").alias("r_" + b) for b in box]).where("r_west < r_east AND r_south < r_north").distinct())
    steps = [size / 2**k for k in range(9)]
    touched = lambda s: (F.floor(c("r_east") / s) - F.floor(c("r_west") / s) + 1) * (F.floor(c("r_north") / s) - F.floor(c("r_south") / s) + 1)
    n, *cells = rects.agg(F.count("*"), *[F.sum(touched(s).cast("double")) for s in steps]).first()
    step = min([size, *[s for s, k in zip(steps, cells) if n and k <= 4 * n]])
    xs, ys = _cells("r_", step)
    spread = rects.withColumn("_gx", F.explode(xs)).withColumn("_gy", F.explode(ys))
    rim = step * 1e-6  # covers rounding
    whole = (c("r_west") <= c("_gx") * step - rim) & (c("r_east") >= (c("_gx") + 1) * step + rim) & (c("r_south") <= c("_gy") * step - rim) & (c("r_north") >= (c("_gy") + 1) * step + rim)
    covered = spread.where(whole).groupBy("_gx", "_gy").agg(*[F.first("r_" + b).alias("r_" + b) for b in box])
    spread = spread.join(covered.select("_gx", "_gy"), ["_gx", "_gy"], "left_anti").unionByName(covered.select(*spread.columns)).withColumnsRenamed({"_gx": "_hx", "_gy": "_hy"})
    placed = points.withColumn("_gx", F.floor(c(x) / step)).withColumn("_gy", F.floor(c(y) / step))
    inside = (c(x) > c("r_west")) & (c(x) < c("r_east")) & (c(y) > c("r_south")) & (c(y) < c("r_north"))
    return placed.join(spread, (c("_gx") == c("_hx")) & (c("_gy") == c("_hy")) & inside, "left_semi").drop("_gx", "_gy")


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float, poly_key: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """``(point columns, poly_key)`` for points inside polygons given as ``ring array<struct<lon,lat>>`` (even-odd rule)."""
    bounds = rings.select(poly_key, "ring", F.array_min(F.transform("ring", lambda p: p.lon)).alias("west"), F.array_max(F.transform("ring", lambda p: p.lon)).alias("east"),
                          F.array_min(F.transform("ring", lambda p: p.lat)).alias("south"), F.array_max(F.transform("ring", lambda p: p.lat)).alias("north"))
    near = points_in_rects(points, bounds, size, x, y, closed=True)
    ring = F.col("r_ring")
    side = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crosses = F.filter(side, lambda s: ((s.p.lat > F.col(y)) != (s.q.lat > F.col(y))) & (
        F.col(x) < (s.q.lon - s.p.lon) * (F.col(y) - s.p.lat) / (s.q.lat - s.p.lat) + s.p.lon))
    return near.where(F.size(crosses) % 2 == 1).select(*points.columns, F.col(f"r_{poly_key}").alias(poly_key))


def tiles_intersecting(tiles: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Tiles meeting a box (edges count); plain range predicates, so they reach the scan."""
    w, s, e, n = bbox
    return tiles.where((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s))


def tile_neighbours(tiles: DataFrame, buffer_m: float = 100, size: float = 0.05, key: str = "tile_id") -> DataFrame:
    """Pairs of different tiles that meet when the first is grown by ``buffer_m`` (as degrees at 111 320 m each)."""
    pad = buffer_m / M_PER_DEG
    cols = [key, "west", "south", "east", "north"]

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        kind = tiles.schema[key].dataType.simpleString()
        found = rects.kernel(rects.met(a, b, key, key, size, pad), rects.neighbours, f"id {kind}, found array<{kind}>", pad=pad)
        return found.select(F.col("id").alias(key), F.explode("found").alias("neighbour_id"))

    return pairs_once(tiles.select(*cols), key, pairs)


def compatible_surveys(survey: DataFrame) -> DataFrame:
    """Pairs of sources that may be joined: same survey, datum and CRS, same spacing, lattices aligned to 1e-6 cells."""
    near = lambda p, q: F.abs(p - q) <= F.greatest(1e-10 * F.greatest(F.abs(p), F.abs(q)), F.lit(1e-12))
    a, b = survey.alias("a"), survey.alias("b")
    keys = ["survey_key", "datum", "epsg"]
    off = lambda axis, step: (F.col(f"b.{axis}") - F.col(f"a.{axis}")) / F.col(f"a.{step}")
    return (
        a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
        .where((F.col("a.source_id") < F.col("b.source_id")) & near(F.col("a.dx"), F.col("b.dx")) & near(F.col("a.dy"), F.col("b.dy"))
               & (F.abs(off("x0", "dx") - F.round(off("x0", "dx"))) <= 1e-6) & (F.abs(off("y0", "dy") - F.round(off("y0", "dy"))) <= 1e-6))
        .select(F.col("a.source_id").alias("source_a"), F.col("b.source_id").alias("source_b"), F.col("a.survey_key").alias("survey_key"))
    )


def mosaic(surface: DataFrame, survey: DataFrame) -> DataFrame:
    """One row per lattice cell: the first finite source by (resolution, path), scale and offset applied first.

    ``surface`` has (survey_key, source_id, row, col, raw); the winner is a minimum over a struct, so overlaps combine
    before the shuffle and nothing is sorted.
    """
    value = F.col("raw") * F.col("scale") + F.col("offset")
    joined = surface.join(survey.select("source_id", "resolution_m", "path", "scale", "offset"), "source_id").withColumn("v", value)
    fine = joined.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    return fine.groupBy("survey_key", "row", "col").agg(F.min(F.struct("resolution_m", "path", "source_id", "v")).alias("m")).select(
        "survey_key", "row", "col", F.col("m.v").alias("z"), F.col("m.source_id").alias("source_id"))


def rim_cells(regions: DataFrame, surface: DataFrame, ring_factor: float = 2.0, dx: float = 1.0, dy: float = 1.0, bucket: int = 64) -> DataFrame:
    """Surface cells in each region's annulus r < d <= ring_factor*r about its centroid, r = sqrt(area/pi).

    ``regions``: (survey_id, region_id, centroid_row, centroid_col, area_m2), centroids in lattice units. Distances are
    taken to cell centres. Regions are spread to the ``bucket``-cell squares their ring covers, then met by equality.
    """
    r = F.sqrt(F.col("area_m2") / math.pi)
    reg = regions.select("survey_id", "region_id", "centroid_row", "centroid_col", r.alias("_r"), (r * ring_factor).alias("_outer"))
    span = lambda c, step: F.sequence(F.floor((F.col(c) - F.col("_outer") / step - 1) / bucket), F.floor((F.col(c) + F.col("_outer") / step + 1) / bucket))
    reg = reg.withColumn("_gr", F.explode(span("centroid_row", dy))).withColumn("_gc", F.explode(span("centroid_col", dx)))
    cells = surface.withColumn("_gr", F.floor(F.col("row") / bucket)).withColumn("_gc", F.floor(F.col("col") / bucket))
    d = F.sqrt(((F.col("row") + 0.5 - F.col("centroid_row")) * dy) ** 2 + ((F.col("col") + 0.5 - F.col("centroid_col")) * dx) ** 2)
    return reg.join(cells, ["survey_id", "_gr", "_gc"]).where((d > F.col("_r")) & (d <= F.col("_outer"))).drop("_gr", "_gc", "_r", "_outer")


def _overlap() -> Column:
    return (F.least("a_east", "b_east") - F.greatest("a_west", "b_west")) * (F.least("a_north", "b_north") - F.greatest("a_south", "b_south"))


def _overlaps(met: DataFrame, find: Callable, tiles: DataFrame, inventory: DataFrame, more: str = "", best: bool = False) -> DataFrame:
    tile, dem = tiles.schema["tile_id"].dataType.simpleString(), inventory.schema["dem_id"].dataType.simpleString()
    return rects.kernel(met, find, f"tile_id {tile}, dem_id {dem}, overlap double{more}", best)


def all_dems(tiles: DataFrame, inventory: DataFrame, size: float = 0.05) -> DataFrame:
    """Every DEM overlapping each tile, best overlap first (``rank`` 1).

    A tile meets all its DEMs in one block, where a kernel ranks them, so pairs are neither shuffled nor sorted outside it.
    Rows that share a tile_id are ranked together, by a window over their pairs.
    """
    many = repeated(tiles, "tile_id")
    same = F.col("tile_id").eqNullSafe(F.col("_many"))
    one = tiles if many is None else tiles.join(many, same, "left_anti")
    out = _overlaps(rects.met(one, inventory, "tile_id", "dem_id", size, whole=True), rects.ranked, tiles, inventory, ", rank int")
    if many is None:
        return out
    pairs = rect_join(tiles.join(many, same, "left_semi"), inventory, size).withColumn("overlap", _overlap())
    w = Window.partitionBy("a_tile_id").orderBy(F.desc("overlap"), "b_dem_id")
    return out.unionByName(pairs.select(F.col("a_tile_id").alias("tile_id"), F.col("b_dem_id").alias("dem_id"), "overlap", F.row_number().over(w).alias("rank")))


def best_dem(tiles: DataFrame, inventory: DataFrame, size: float = 0.05) -> DataFrame:
    """The DEM with the largest overlap per tile, smallest id among equals.

    Of DEMs with one rectangle only the smallest id can win. Tiles meet the others in blocks, where those that have less
    overlap with every tile of a part than another one has are left out; one row a tile and list of DEMs is exchanged.
    """
    box = ["west", "south", "east", "north"]
    first = inventory.groupBy(*box).agg(F.min(F.struct("dem_id")).alias("m")).select(F.col("m.dem_id").alias("dem_id"), *box)
    found = _overlaps(rects.met(tiles, first, "tile_id", "dem_id", size), rects.largest, tiles, inventory, best=True)
    best = found.groupBy("tile_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "dem_id")).alias("m"))
    return best.select("tile_id", "m.dem_id", (-F.col("m.o")).alias("overlap"))


MERCATOR_LAT = 85.0511287798066


def coverage_grid(inventory: DataFrame, bbox: tuple[float, float, float, float], z: int, cap: int | None = 200) -> DataFrame:
    """Tiles of a viewport marked ``lidar`` where some DEM overlaps them, else ``fallback``; refuses more than ``cap``."""
    spark = inventory.sparkSession
    w, s, e, n = bbox[0], max(bbox[1], -MERCATOR_LAT), bbox[2], min(bbox[3], MERCATOR_LAT)
    x0, y0 = tile_position(F.lit(w), F.lit(n), F.lit(z))
    x1, y1 = tile_position(F.lit(e), F.lit(s), F.lit(z))
    on_grid = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(2**z - 1))
    plan = spark.range(1).select(on_grid(x0).alias("x0"), on_grid(x1).alias("x1"), on_grid(y0).alias("y0"), on_grid(y1).alias("y1"))
    if cap is not None:
        count = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
        plan = plan.where(F.when(count > cap, F.raise_error("viewport holds too many tiles").cast("boolean")).otherwise(True))
    tiles = plan.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("x", F.explode(F.sequence("y0", "y1")).alias("y"))
    tiles = tiles.withColumns({k: v for k, v in tile_bounds(F.lit(z), "x", "y").items()}).withColumn("tile_id", F.concat_ws("/", F.lit(z), "x", "y"))
    side = 360.0 / 2**z  # tiles at the rim reach outside the viewport, by one tile's side at most
    hit = rect_join(tiles, tiles_intersecting(inventory, (w - side, s - side, e + side, n + side)), side).select(F.col("a_tile_id").alias("tile_id")).distinct().withColumn("_hit", F.lit(True))
    return tiles.join(hit, "tile_id", "left").select("x", "y", F.when(F.col("_hit"), "lidar").otherwise("fallback").alias("source"))


def sample_nearest(points: DataFrame, surface: DataFrame, survey: DataFrame, key: str) -> DataFrame:
    """Elevation of the native cell under each position, first source by (resolution, path) that has one.

    ``points`` has projected ``x, y`` and ``epsg``; ``survey`` has x0, y0 (top-left), dx, dy, epsg, resolution_m, path.
    Sources on one grid (equal CRS, origin and spacing) are one mosaic first, with the first source of each cell, so points
    meet a grid once however many sources overlap there. They meet only grids whose cells' rectangle holds them, in squares
    of about the rectangle's size.
    """
    grid = ["epsg", "x0", "y0", "dx", "dy"]
    held = surface.where("z IS NOT NULL").join(survey.select("source_id", *grid, "resolution_m", "path"), "source_id")
    cells = held.groupBy(*grid, "row", "col").agg(F.min(F.struct("resolution_m", "path", "source_id", "z")).alias("m"))
    # rectangles with a cell to spare, each in the few squares of its own size that it touches
    boxes = cut_lineage(
        held.groupBy(*grid).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
        .withColumns({"_w": F.expr("x0 + (c0 - 1) * dx"), "_e": F.expr("x0 + (c1 + 2) * dx"), "_s": F.expr("y0 - (r1 + 2) * dy"), "_n": F.expr("y0 - (r0 - 1) * dy")}).where("_w < _e AND _s < _n")
        .withColumn("_level", F.ceil(F.log2(F.greatest(F.expr("_e - _w"), F.expr("_n - _s")))).cast("int")).drop("r0", "r1", "c0", "c1"))
    levels = [r[0] for r in boxes.select("_level").distinct().collect()]  # powers of two, so a handful
    square = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    boxes = boxes.withColumn("_gx", F.explode(F.sequence(square("_w"), square("_e")))).withColumn("_gy", F.explode(F.sequence(square("_s"), square("_n"))))
    spots = points.select(key, "epsg", "x", "y").withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumns({"_gx": square("x"), "_gy": square("y")})
    inside = spots.join(boxes, ["epsg", "_level", "_gx", "_gy"]).where("x BETWEEN _w AND _e AND y BETWEEN _s AND _n")
    on_grid = inside.select(key, F.col("epsg").alias("_crs"), *grid[1:], F.floor((F.col("y0") - F.col("y")) / F.col("dy")).alias("row"), F.floor((F.col("x") - F.col("x0")) / F.col("dx")).alias("col"))
    best = on_grid.join(cells.withColumnRenamed("epsg", "_crs"), ["_crs", *grid[1:], "row", "col"]).groupBy(key).agg(F.min("m").alias("m"))
    return points.join(best, key, "left").select(*points.columns, F.col("m.z").alias("elevation_m"), F.col("m.source_id").alias("source"))


def route(points: DataFrame, boxes: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """First box (by ``ord``) holding each position, edges included; null when none does."""
    hits = points_in_rects(points, boxes, size, closed=True).groupBy(key).agg(F.min(F.struct("r_ord", "r_name")).alias("m"))
    return points.join(hits, key, "left").select(*points.columns, F.col("m.r_name").alias("area"))


def nn_distance(df: DataFrame, group: list[str], max_m: float, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Distance to the nearest other member of the group, for members with one inside ``max_m``."""
    pairs = within_distance(df.select(*group, key, x, y), df.select(*group, key, x, y), max_m, "metric", x, y, x, y, keys=group)
    return (
        pairs.where(F.col(f"a_{key}") != F.col(f"b_{key}"))
        .groupBy(*[F.col(f"a_{g}").alias(g) for g in group], F.col(f"a_{key}").alias(key)).agg(F.min("distance_m").alias("nn_m"))
    )


def cell_lookup(cells: DataFrame, surface: DataFrame) -> DataFrame:
    return cells.join(surface, KEYS, "left")

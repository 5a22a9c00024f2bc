"""Neighbourhood derivatives as windows over halo blocks (one shuffle per call, whatever the products)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellscan.operators.blocks import BLOCK, along_col, along_row, owned, tiled

NINE = ["na", "nb", "nc", "nd", "ne", "nf", "ng", "nh", "ni"]
# Light directions (degrees) and weights of the two blended reliefs, and the tint of shaded relief.
MDOW_LIGHTS = [(225, 0.167), (270, 0.278), (315, 0.167), (360, 0.111), (45, 0.056), (90, 0.222)]
RELIEF_LIGHTS = [(315, 0.5), (45, 0.2), (270, 0.2), (90, 0.1)]
RELIEF_TINT = (228, 230, 211)
UNBOUNDED = Window.unboundedPreceding


def neighbourhood(blocks: DataFrame, col: str = "z") -> DataFrame:
    """Add ``na..ni`` (north-west to south-east, ``ne`` the cell itself); null where the neighbour is absent."""
    row_w, col_w = along_row(), along_col()
    out = (
        blocks.withColumn("ne", F.col(col).cast("double"))
        .withColumn("nd", F.max("ne").over(row_w.rangeBetween(-1, -1)))
        .withColumn("nf", F.max("ne").over(row_w.rangeBetween(1, 1)))
        .withColumn("_line", F.struct("nd", "ne", "nf"))
    )
    out = out.withColumn("_n", F.first("_line").over(col_w.rangeBetween(-1, -1))).withColumn(
        "_s", F.first("_line").over(col_w.rangeBetween(1, 1))
    )
    return (
        out.withColumns(
            {"na": F.col("_n.nd"), "nb": F.col("_n.ne"), "nc": F.col("_n.nf"),
             "ng": F.col("_s.nd"), "nh": F.col("_s.ne"), "ni": F.col("_s.nf")}
        ).drop("_line", "_n", "_s")
    )


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _horn(dx: float, dy: float) -> tuple[Column, Column]:
    a, b, c, d, f, g, h, i = _c("na", "nb", "nc", "nd", "nf", "ng", "nh", "ni")
    return ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * dx), ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * dy)


def _central(dx: float, dy: float) -> tuple[Column, Column]:
    return (F.col("nf") - F.col("nd")) / (2 * dx), (F.col("nh") - F.col("nb")) / (2 * dy)


def _clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _lambert(gx: Column, gy: Column, az: float, alt: float, clip: bool = True) -> Column:
    """Illumination of the surface normal (-gx, +gy north-up) by a light at ``az``/``alt`` degrees."""
    a, e = math.radians(az), math.radians(alt)
    shade = (-gx * (math.sin(a) * math.cos(e)) + gy * (math.cos(a) * math.cos(e)) + math.sin(e)) / F.sqrt(1 + gx * gx + gy * gy)
    return _clip(shade, 0.0, 1.0) if clip else shade


def _curvature_terms(size: float) -> tuple[Column, Column, Column, Column, Column]:
    a, b, c, d, e, f, g, h, i = _c(*NINE)
    return (((d + f) / 2 - e) / size**2, ((b + h) / 2 - e) / size**2, (-a + c + g - i) / (4 * size**2),
            (-d + f) / (2 * size), (b - h) / (2 * size))


def product(name: str, dx: float = 1.0, dy: float = 1.0, az: float = 315.0, alt: float = 45.0) -> Column:
    """Column over ``na..ni`` for one 3x3 product; meaningful only where all nine cells are present."""
    e = F.col("ne")
    around = [F.col(n) for n in NINE if n != "ne"]
    if name == "slope":
        p, q = _horn(dx, dy)
        return F.degrees(F.atan(F.sqrt(p * p + q * q)))
    if name == "hillshade":
        p, q = _horn(dx, dy)
        return _lambert(p, q, az, alt)
    if name == "tpi":
        return e - sum(around[1:], around[0]) / 8
    if name == "roughness":
        return F.greatest(*_c(*NINE)) - F.least(*_c(*NINE))
    if name in ("profile_curvature", "plan_curvature"):
        d, ee, f, g, h = _curvature_terms(dx)
        flat = g * g + h * h
        top = -2 * (d * g * g + ee * h * h + f * g * h) if name == "profile_curvature" else 2 * (d * h * h + ee * g * g - f * g * h)
        return F.when(flat == 0, F.lit(0.0)).otherwise(top / flat)
    if name == "slope_gradient":
        gx, gy = _central(dx, dy)
        return F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    if name == "hillshade_gradient":
        gx, gy = _central(dx, dy)
        return _lambert(gx, gy, az, alt)
    if name == "mdow":
        gx, gy = _central(dx, dy)
        s, aspect, e_alt = F.sqrt(gx * gx + gy * gy), F.atan2(-gy, gx), math.radians(alt)
        parts = [w * _clip((math.cos(e_alt) * s * F.cos(math.radians(a) - aspect) + math.sin(e_alt)) / (1 + s), 0.0, 1.0) for a, w in MDOW_LIGHTS]
        return sum(parts[1:], parts[0])
    if name == "relief_intensity":
        gx, gy = _central(dx, dy)
        parts = [w * _lambert(gx, gy, a, alt) for a, w in RELIEF_LIGHTS]
        return _clip(0.30 + 0.84 * sum(parts[1:], parts[0]), 0.0, 1.0)
    raise ValueError(f"unknown product {name}")


def derive(surface: DataFrame, products: dict[str, Column] | list[str], block: int = BLOCK) -> DataFrame:
    """Surface plus the named 3x3 products, null unless the cell's whole 3x3 neighbourhood is present."""
    if not isinstance(products, dict):
        products = {n: product(n) for n in products}
    full = F.lit(True)
    for n in NINE:
        full = full & F.col(n).isNotNull()
    near = neighbourhood(tiled(surface, 1, block))
    return owned(near.withColumns({k: F.when(full, v) for k, v in products.items()}).drop(*NINE))


def hillshade_horn(s: DataFrame, az: float = 315, alt: float = 45, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    return derive(s, {"hillshade": product("hillshade", dx, dy, az, alt)}, block)


def slope_horn(s: DataFrame, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    return derive(s, {"slope": product("slope", dx, dy)}, block)


def tpi(s: DataFrame, block: int = BLOCK) -> DataFrame:
    return derive(s, ["tpi"], block)


def roughness(s: DataFrame, block: int = BLOCK) -> DataFrame:
    return derive(s, ["roughness"], block)


def profile_curvature(s: DataFrame, dx: float = 1.0, block: int = BLOCK) -> DataFrame:
    return derive(s, {"profile_curvature": product("profile_curvature", dx)}, block)


def plan_curvature(s: DataFrame, dx: float = 1.0, block: int = BLOCK) -> DataFrame:
    return derive(s, {"plan_curvature": product("plan_curvature", dx)}, block)


def slope_gradient(s: DataFrame, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    return derive(s, {"slope_gradient": product("slope_gradient", dx, dy)}, block)


def hillshade_gradient(s: DataFrame, az: float = 315, alt: float = 45, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    return derive(s, {"hillshade_gradient": product("hillshade_gradient", dx, dy, az, alt)}, block)


def mdow_hillshade(s: DataFrame, alt: float = 45, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    return derive(s, {"mdow": product("mdow", dx, dy, alt=alt)}, block)


def shaded_relief(s: DataFrame, alt: float = 40, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Blend of four lights, tinted to r, g, b bytes."""
    out = derive(s, {"intensity": product("relief_intensity", dx, dy, alt=alt)}, block)
    return out.withColumns({n: F.floor(F.col("intensity") * t).cast("int") for n, t in zip(("r", "g", "b"), RELIEF_TINT)})


def _running(expr: Column, window, half: int) -> Column:
    """Sum over ``[-half, half]`` as a difference of two running sums: constant work per cell for any kernel."""
    upto = F.sum(expr).over(window.rangeBetween(UNBOUNDED, half))
    before = F.sum(expr).over(window.rangeBetween(UNBOUNDED, -half - 1))
    return upto - F.coalesce(before, F.lit(0))


def box_stats(blocks: DataFrame, col: str, rx: int, ry: int, prefix: str) -> DataFrame:
    """Add ``{prefix}_sum`` and ``{prefix}_n`` over the (2rx+1) x (2ry+1) box, row pass then column pass.

    A row without a cell at this column still contributes to the box, so the row pass is spread to every lattice
    column the block's row can see before the column pass runs; ``box_lattice`` supplies those cells.
    """
    row_w, col_w = along_row(), along_col()
    one = F.when(F.col(col).isNotNull(), 1).otherwise(0)
    value = F.coalesce(F.col(col), F.lit(0))
    out = blocks.withColumn("_rs", _running(value, row_w, rx)).withColumn("_rn", _running(one, row_w, rx))
    return (
        out.withColumn(f"{prefix}_sum", _running(F.col("_rs"), col_w, ry))
        .withColumn(f"{prefix}_n", _running(F.col("_rn"), col_w, ry))
        .drop("_rs", "_rn")
    )


def box_lattice(blocks: DataFrame, col: str) -> DataFrame:
    """Complete every block to its bounding lattice (absent cells get a null value) inside the block's partition."""
    keys = ["survey_id", "_br", "_bc"]
    span = (
        blocks.groupBy(*keys)
        .agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))
        .where("n < (r1 - r0 + 1) * (c1 - c0 + 1)")  # a complete block needs nothing added
    )
    frame = (
        span.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
        .select(*keys, "row", "col", F.lit(None).cast(blocks.schema[col].dataType).alias(col), F.lit(False).alias("_real"))
    )
    real = blocks.withColumn("_real", F.lit(True))
    both = real.unionByName(frame, allowMissingColumns=True).repartition(*keys)
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in real.columns if c not in (*keys, "row", "col", "_real")]
    return both.groupBy(*keys, "row", "col").agg(F.max("_real").alias("_real"), *aggs)


def lrm(s: DataFrame, kernel: int = 100, col: str = "z", out: str | None = None, block: int = BLOCK) -> DataFrame:
    """Cell minus the mean of the available cells in a kernel-wide box (an even kernel is widened by one)."""
    half = kernel // 2
    name = out or f"lrm_{kernel}"
    boxed = box_stats(box_lattice(tiled(s, half, max(block, half)), col), col, half, half, "_b")
    return owned(boxed.where("_real").withColumn(name, F.col(col) - F.col("_b_sum") / F.col("_b_n")).drop("_b_sum", "_b_n", "_real"))


def local_relief(s: DataFrame, radius_m: float = 25, dx: float = 1.0, dy: float = 1.0, col: str = "z",
                 out: str = "local_relief", block: int = BLOCK) -> DataFrame:
    """Cell minus box mean, null unless every cell of the box is present."""
    return local_reliefs(s, {out: radius_m}, dx, dy, col, block)


def local_reliefs(s: DataFrame, radii: dict[str, float], dx: float = 1.0, dy: float = 1.0, col: str = "z", block: int = BLOCK) -> DataFrame:
    """Several full-support reliefs from one exchange.

    A full box implies a full line on every row it covers, so sparse rows can be left out: a missing line makes the
    counted cells fall short and the result null, which is what full support asks for.
    """
    halves = {n: (math.ceil(r / dx), math.ceil(r / dy)) for n, r in radii.items()}
    halo = max(max(h) for h in halves.values())
    return owned(_full_boxes(tiled(s, halo, max(block, halo)), halves, col))


def _full_boxes(blocks: DataFrame, halves: dict[str, tuple[int, int]], col: str, row_extra: dict | None = None, col_extra: dict | None = None) -> DataFrame:
    """All row windows, then all column windows: two sorts however many boxes (and extra windows) there are."""
    row_w, col_w = along_row(), along_col()
    one = F.when(F.col(col).isNotNull(), 1).otherwise(0)
    first = {}
    for n, (rx, _) in halves.items():
        first[f"_s_{n}"], first[f"_n_{n}"] = _running(F.coalesce(F.col(col), F.lit(0)), row_w, rx), _running(one, row_w, rx)
    out = blocks.withColumns({**first, **(row_extra or {})})
    second = {}
    for n, (_, ry) in halves.items():
        second[f"_S_{n}"], second[f"_N_{n}"] = _running(F.col(f"_s_{n}"), col_w, ry), _running(F.col(f"_n_{n}"), col_w, ry)
    renamed = {k.replace("_S_", "_bs_").replace("_N_", "_bn_"): v for k, v in second.items()}
    out = out.withColumns({**renamed, **(col_extra or {})})
    final = {}
    for n, (rx, ry) in halves.items():
        size = (2 * rx + 1) * (2 * ry + 1)
        final[n] = F.when(F.col(f"_bn_{n}") == size, F.col(col) - F.col(f"_bs_{n}") / size)
    return out.withColumns(final).drop(*first, *renamed)


def discovery_surface(s: DataFrame, dx: float = 1.0, dy: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Relief at 10 m and 25 m and central-difference slope, all with full support, from one exchange and two sorts."""
    halo = max(math.ceil(25 / min(dx, dy)), 1)
    halves = {n: (math.ceil(r / dx), math.ceil(r / dy)) for n, r in (("relief_10", 10), ("relief_25", 25))}
    row_w, col_w = along_row(), along_col()
    z = F.col("z").cast("double")
    line = {"ne": z, "nd": F.max(z).over(row_w.rangeBetween(-1, -1)), "nf": F.max(z).over(row_w.rangeBetween(1, 1))}
    # three present cells on a line make its ends known; that flag stands in for the corners above and below
    whole = F.when(F.col("nd").isNotNull() & F.col("nf").isNotNull(), F.col("ne"))
    column = {"nb": F.max(whole).over(col_w.rangeBetween(-1, -1)), "nh": F.max(whole).over(col_w.rangeBetween(1, 1))}
    out = _full_boxes(tiled(s.select("survey_id", "row", "col", "z"), halo, max(block, halo)), halves, "z", line, column)
    full = F.col("nd").isNotNull() & F.col("nf").isNotNull() & F.col("nb").isNotNull() & F.col("nh").isNotNull()
    slope = F.when(full, product("slope_gradient", dx, dy))
    return owned(out.withColumn("slope", slope).drop("ne", "nd", "nf", "nb", "nh"))


# ---- masks ---------------------------------------------------------------------------------------------------------

def with_neighbour_flags(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """Mask cells plus ``n4`` (present edge neighbours), ``ew``/``ns`` exposed sides and 2x2 completeness ``quad``."""
    near = neighbourhood(tiled(mask.withColumn("_m", F.lit(1)), 1, block), "_m")
    have = {n: F.col(n).isNotNull().cast("int") for n in NINE}
    return owned(
        near.withColumns(
            {"n4": have["nb"] + have["nd"] + have["nf"] + have["nh"],
             "open_ew": 2 - have["nd"] - have["nf"], "open_ns": 2 - have["nb"] - have["nh"],
             "link_e": have["nf"], "link_s": have["nh"], "quad": have["nf"] * have["nh"] * have["ni"],
             "n8": sum((have[n] for n in NINE if n != "ne"), F.lit(0))}
        ).drop("_m", *NINE)
    )


def erode(mask: DataFrame, shape: str = "cross", block: int = BLOCK) -> DataFrame:
    """Cells whose neighbours (4 for ``cross``, 8 for ``square``) are all in the mask; outside counts as false."""
    need = "n4 = 4" if shape == "cross" else "n8 = 8"
    return with_neighbour_flags(mask, block).where(need).select(*mask.columns)


def dilate(mask: DataFrame, shape: str = "cross") -> DataFrame:
    """Mask cells and their neighbours, once each (keys only)."""
    steps = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    if shape == "square":
        steps += [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps])
    return (
        mask.select("survey_id", "row", "col", F.explode(moves).alias("m"))
        .select("survey_id", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).distinct()
    )


def feather(local: DataFrame, background: DataFrame, pad: int = 8, block: int = BLOCK) -> DataFrame:
    """Blend ``local.value`` into ``background.value`` with weight min(distance to missing ground / pad, 1)."""
    half = pad
    offsets = F.array(*[
        F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(math.hypot(r, c)).alias("d"))
        for r in range(-half, half + 1) for c in range(-half, half + 1) if 0 < math.hypot(r, c) < pad
    ])
    cells = local.select("survey_id", "row", "col", F.col("value").alias("local_value"))
    # Only absent cells next to a present one can be the nearest missing ground, so the rim is all that is spread.
    rim = dilate(cells, "square").join(cells.select("survey_id", "row", "col"), ["survey_id", "row", "col"], "left_anti")
    reach = (
        rim.withColumn("_o", F.explode(F.array_union(offsets, F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0.0).alias("d"))))))
        .select("survey_id", (F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"), F.col("_o.d").alias("d"))
        .groupBy("survey_id", "row", "col").agg(F.min("d").alias("d"))
    )
    weight = F.least(F.coalesce(F.col("d"), F.lit(float(pad))) / pad, F.lit(1.0))
    return (
        cells.join(reach, ["survey_id", "row", "col"], "left").withColumn("weight", weight)
        .join(background.select("survey_id", "row", "col", F.col("value").alias("back")), ["survey_id", "row", "col"], "left")
        .select("survey_id", "row", "col", "weight",
                (F.col("local_value") * F.col("weight") + F.coalesce("back", F.lit(0.0)) * (1 - F.col("weight"))).alias("value"))
    )


def normalise_channels(s: DataFrame, cols: list[str]) -> DataFrame:
    """Scale each channel to 0..1 over its survey; a flat channel becomes 0."""
    stats = s.groupBy("survey_id").agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = s.join(stats, "survey_id")
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(f"{c}_norm", F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0)))
    return out.drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])

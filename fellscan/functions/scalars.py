"""Column helpers: coordinates, tiles, CRS text, scores, colours, text extraction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_DEG = 111_320.0
EARTH_M = 6_371_008.8
WORLD_M = 20037508.342789244
# The ordered classification rules, as (conditions, label); bounds are exclusive.
CLASS_RULES = [
    ("area > 10000 AND depth < 5 AND circ < 0.3", "salt_dome_collapse"),
    ("circ < 0.2 AND depth > 0.5 AND area > 500", "lava_tube"),
    ("depth > 3 AND area < 500 AND circ > 0.4", "cave_entrance"),
    ("circ < 0.3 AND depth > 1 AND area < 1000", "mine_portal"),
    ("area > 200 AND depth > 0.5 AND circ > 0.5", "sinkhole"),
    ("depth > 0.5", "depression"),
]
# Feature types in enumeration order (ties in votes go to the earlier one).
FEATURE_TYPES = [
    "sinkhole", "cave_entrance", "mine_portal", "depression", "collapse_pit", "spring", "lava_tube", "salt_dome_collapse", "mound",
    "platform", "linear_bank", "linear_ditch", "enclosure", "repeated_pattern", "ridge", "hollow", "scarp", "unknown",
]
# Hypsometric stops (elevation in metres, r, g, b).
HYPSOMETRIC = [
    (0, 72, 133, 75), (100, 106, 163, 88), (200, 166, 194, 114), (400, 209, 197, 140),
    (700, 186, 163, 130), (1200, 170, 160, 150), (2000, 200, 200, 200), (3500, 245, 245, 245),
]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utm_zone(lon) -> Column:
    return (F.floor((_col(lon) + 180) / 6) + 1).cast("int")


def utm_epsg(lon, lat) -> Column:
    return F.when(_col(lat) >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def epsg_from_text(text) -> Column:
    """EPSG of a CRS name such as 'NAD83 / UTM zone 17N': 269xx in the north, 327xx in the south, else null."""
    pattern = r"UTM zone (\d+)([NS])"
    zone = F.regexp_extract(_col(text), pattern, 1)
    base = F.when(F.regexp_extract(_col(text), pattern, 2) == "N", 26900).otherwise(32700)
    return F.when(zone != "", base + zone.try_cast("int"))


def degrees_to_metres(lat, dlon, dlat) -> tuple[Column, Column]:
    return _col(dlon) * M_PER_DEG * F.cos(F.radians(_col(lat))), _col(dlat) * M_PER_DEG


def metres_to_degrees(lat, dx, dy) -> tuple[Column, Column]:
    return _col(dx) / (M_PER_DEG * F.cos(F.radians(_col(lat)))), _col(dy) / M_PER_DEG


def tile_bounds(z, x, y) -> dict[str, Column]:
    n = F.pow(F.lit(2.0), _col(z))
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return {"west": _col(x) / n * 360 - 180, "south": lat(_col(y) + 1), "east": (_col(x) + 1) / n * 360 - 180, "north": lat(_col(y))}


def tile_position(lon, lat, z) -> tuple[Column, Column]:
    """Fractional tile coordinates; floor them for the tile index."""
    n = F.pow(F.lit(2.0), _col(z))
    rad = F.radians(_col(lat))
    return (_col(lon) + 180) / 360 * n, (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n


def mercator_bounds(z, x, y) -> dict[str, Column]:
    size = 2 * WORLD_M / F.pow(F.lit(2.0), _col(z))
    return {"west": -WORLD_M + _col(x) * size, "south": WORLD_M - (_col(y) + 1) * size,
            "east": -WORLD_M + (_col(x) + 1) * size, "north": WORLD_M - _col(y) * size}


def grid_cell_key(west, south, east, north, size: float = 0.05) -> Column:
    """Bounds snapped outwards to the context grid, as text."""
    low = lambda c: F.floor(_col(c) / size) * size
    high = lambda c: F.ceil(_col(c) / size) * size
    return F.format_string("%.3f_%.3f_%.3f_%.3f", low(west), low(south), high(east), high(north))


def context_cache_key(layer, cell_key) -> Column:
    return F.concat(_col(layer), F.lit("_"), F.substring(F.md5(F.concat(_col(layer), F.lit("_"), _col(cell_key))), 1, 16), F.lit(".parquet"))


def classify(depth, area, circ) -> Column:
    """First matching rule wins; missing measures count as zero."""
    out = None
    d, a, c = (F.coalesce(_col(v).cast("double"), F.lit(0.0)) for v in (depth, area, circ))
    tests = {"<": lambda x, y: x < y, ">": lambda x, y: x > y}
    cols = {"depth": d, "area": a, "circ": c}
    for rule, name in CLASS_RULES:
        cond = F.lit(True)
        for part in rule.split(" AND "):
            who, op, bound = part.split()
            cond = cond & tests[op](cols[who], float(bound))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


def saturating(value, full: float) -> Column:
    return F.least(F.abs(_col(value)) / full, F.lit(1.0))


def discovery_score(strength: Column) -> Column:
    return 0.4 + 0.4 * strength


def contrast_strength(contrast, threshold: float) -> Column:
    return 1 - F.exp(-F.abs(_col(contrast)) / (3 * threshold))


def href(html) -> Column:
    found = F.regexp_extract(_col(html), r'href="([^"]+)"', 1)
    return F.when(found != "", found)


def county_folder(name) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(_col(name), " County", ""), " ", ""), F.lit("CoNC"))


def slug(name) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def acquisition_year(published, url, title) -> Column:
    """First four digits of the date, else a four-digit path or title part; kept when 1990..2030."""
    first = F.regexp_extract(F.coalesce(_col(published), F.lit("")), r"(\d{4})", 1)
    other = F.regexp_extract(F.concat(F.coalesce(_col(url), F.lit("")), F.lit("/"), F.coalesce(_col(title), F.lit(""))), r"[_/](\d{4})[_/]", 1)
    year = F.when(first != "", first).when(other != "", other).cast("int")
    return F.when(year.between(1990, 2030), year)


def radius_bbox(lon, lat, radius_m) -> dict[str, Column]:
    dlat = _col(radius_m) / M_PER_DEG
    dlon = _col(radius_m) / (M_PER_DEG * F.cos(F.radians(_col(lat))))
    return {"west": _col(lon) - dlon, "south": _col(lat) - dlat, "east": _col(lon) + dlon, "north": _col(lat) + dlat}


def terrarium(z) -> dict[str, Column]:
    v = _col(z) + 32768
    return {"r": F.floor(v / 256).cast("int"), "g": F.floor(F.pmod(v, F.lit(256))).cast("int"), "b": F.floor(F.pmod(v * 256, F.lit(256))).cast("int")}


def terrarium_decode(r, g, b) -> Column:
    return _col(r) * 256 + _col(g) + _col(b) / 256 - 32768


def terrain_rgb(z) -> dict[str, Column]:
    v = F.floor((_col(z) + 10000) * 10).cast("bigint")
    return {"r": F.floor(v / 65536).cast("int"), "g": F.floor(F.pmod(v, F.lit(65536)) / 256).cast("int"), "b": F.pmod(v, F.lit(256)).cast("int")}


def hypsometric(t) -> dict[str, Column]:
    """Piecewise-linear colour of an elevation, held at the end stops."""
    v = F.least(F.greatest(_col(t).cast("double"), F.lit(float(HYPSOMETRIC[0][0]))), F.lit(float(HYPSOMETRIC[-1][0])))
    out = {}
    for k, name in enumerate(("r", "g", "b"), start=1):
        expr = None
        for low, high in zip(HYPSOMETRIC, HYPSOMETRIC[1:]):
            piece = low[k] + (v - low[0]) / (high[0] - low[0]) * (high[k] - low[k])
            expr = F.when(v <= high[0], piece) if expr is None else expr.when(v <= high[0], piece)
        out[name] = F.floor(expr).cast("int")
    return out


def colourise(value, layer: str) -> dict[str, Column]:
    """Fixed display scales: diverging for local relief (+-2 m), grey for the rest; alpha 0 where there is no value."""
    v = F.coalesce(_col(value), F.lit(0.0))
    alpha = F.when(_col(value).isNull(), 0).otherwise(255)
    clip = lambda e: F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))
    if layer == "local-relief":
        t = F.least(F.greatest(v / 2, F.lit(-1.0)), F.lit(1.0))
        rgb = [F.floor(mid + F.abs(t) * (F.when(t < 0, lo).otherwise(hi) - mid)) for mid, lo, hi in ((244, 44, 194), (240, 112, 87), (226, 168, 35))]
    else:
        grey = clip((v - 60) / 60) if layer.startswith("openness") else clip(v / 60) if layer == "slope" else clip(v)
        grey = 1 - grey if layer in ("slope", "openness-negative") else grey
        rgb = [F.floor(grey * 255)] * 3
    return {**{n: c.cast("int") for n, c in zip(("r", "g", "b"), rgb)}, "a": alpha}


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dp, dl = p2 - p1, F.radians(_col(lon2)) - F.radians(_col(lon1))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

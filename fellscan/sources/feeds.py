"""Provider feeds to common tables: LiDAR tile indexes, ground-truth sites, map features.

Each feed is a row of settings read by one builder, so adding a provider adds a line. Input rows hold the provider's
properties as a ``map<string,string>`` (``props``), a geometry's bounds or point columns, and nothing else is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscan.functions.scalars import acquisition_year, href

# ---- LiDAR tile indexes --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TileFeed:
    name: list[str]
    url: list[str]
    crs: int | None
    prefix: str = ""
    fmt: str = "laz"
    suffix: str = ".laz"
    needs_geometry: bool = True
    extra: dict = field(default_factory=dict)


# Per feed, the property names tried in order for tile name and link, the CRS code and the file naming.
TILE_FEEDS = {
    "usgs_3dep": TileFeed(["id"], ["data", "copc"], None, "", "copc", ".copc.laz"),
    "tnm": TileFeed([], ["downloadLazURL", "downloadURL"], 4326, "tnm_"),
    "pasda": TileFeed(["TILE_NAME", "Name", "FID"], ["DOWNLOAD_URL", "URL"], 2272, "", needs_geometry=False),
    "wv": TileFeed(["Name", "TILE", "FID"], ["URL", "DOWNLOAD_URL"], 26917, "wv_"),
    "ny": TileFeed(["Tile", "NAME", "FID"], ["LAS_URL", "URL"], 26918, "ny_"),
    "oh": TileFeed(["Name", "TILE", "FID"], ["URL", "DOWNLOAD_URL"], 3735, "oh_"),
    "nc": TileFeed(["name"], ["url"], 6543, "nc_", "copc", ".copc.laz", extra={"year": 2015}),
    "md": TileFeed(["Name", "TILE", "FID"], ["URL", "DOWNLOAD_URL"], 26985, "md_"),
    "va": TileFeed(["TileName", "Name", "FID"], ["PointCloudDownload", "DEMDownload"], 26917, "va_"),
    "ky": TileFeed(["tilename", "Name", "FID"], ["phase2_aws_url", "phase1_aws_url"], 3089, "ky_"),
    "nj": TileFeed(["Name", "TILE", "FID"], ["Download_Link", "URL"], 3424, "nj_"),
    "ct": TileFeed(["Tile", "name", "FID"], ["elev_2023_laz", "elev_2016_las"], 6434, "ct_"),
}
# Source order by state; the national index comes first and the national map last.
STATE_SOURCES = {"PA": "pasda", "WV": "wv", "NY": "ny", "OH": "oh", "NC": "nc", "MD": "md", "VA": "va", "KY": "ky", "NJ": "nj", "CT": "ct"}
PASDA_LINK = "https://www.pasda.psu.edu/uci/LidarDownload.aspx?tile="


def _first(props: Column, names: list[str]) -> Column:
    """First property that is present and not empty."""
    tried = [F.nullif(props[n], F.lit("")) for n in names]
    return F.coalesce(*tried) if tried else F.lit(None).cast("string")


def normalise_tile_index(df: DataFrame, feed: str) -> DataFrame:
    """Tile descriptors from one feed's rows (props, west, south, east, north[, service])."""
    spec, p = TILE_FEEDS[feed], F.col("props")
    url = _first(p, spec.url)
    name = F.coalesce(_first(p, spec.name), F.lit(""))
    year, fmt, crs, size = F.lit(spec.extra.get("year")).cast("int"), F.lit(spec.fmt), F.lit(spec.crs).cast("int"), F.lit(None).cast("bigint")
    if feed == "usgs_3dep":
        year, size = F.substring(p["datetime"], 1, 4).try_cast("int"), p["file:size"].try_cast("bigint")
        crs = F.coalesce(p["proj:epsg"].try_cast("int"), F.lit(4326))
    elif feed == "tnm":
        name = F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.[^.]*$", "")
        year = acquisition_year(_first(p, ["publicationDate", "dateCreated"]), url, _first(p, ["title", "sourceId"]))
        size = p["sizeInBytes"].try_cast("bigint")
    elif feed == "pasda":
        name = F.coalesce(_first(p, spec.name), F.lit("unknown"))
        url = F.coalesce(url, F.concat(F.lit(PASDA_LINK), name))
        year, size = p["YEAR"].try_cast("int"), p["FILE_SIZE"].try_cast("bigint")
    elif feed == "va":
        url = F.when(url.contains("<a "), href(url)).otherwise(url)
    elif feed == "ky":
        fmt = F.when(url.contains(".copc.laz"), "copc.laz").otherwise("laz")
    elif feed == "nj":
        name = F.concat_ws("_", F.col("service"), name)
    out = df.select(
        F.lit(feed).alias("feed"), name.alias("source_id"), F.concat(F.lit(spec.prefix), name, F.lit(spec.suffix)).alias("filename"), url.alias("url"),
        "west", "south", "east", "north", crs.alias("crs"), size.alias("file_size_bytes"), year.alias("acquisition_year"), fmt.alias("format"))
    out = out.where(F.col("url").isNotNull() & (F.col("url") != ""))
    if spec.needs_geometry:
        out = out.where(F.col("west").isNotNull())
    if feed == "tnm":
        return dedup_tiles(out, "url")
    return dedup_tiles(out, "source_id") if feed == "nj" else out


def dedup_tiles(tiles: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by (source_id, filename, west, south), as a combinable minimum."""
    order = ["source_id", "filename", "west", "south"]
    rest = [c for c in tiles.columns if c not in (*order, key)]
    pick = F.min(F.struct(*[c for c in order if c != key], *rest)).alias("m")
    return tiles.groupBy(key).agg(pick).select(*[F.col(key) if c == key else F.col(f"m.{c}").alias(c) for c in tiles.columns])


def drop_legacy(tiles: DataFrame) -> DataFrame:
    """Keep COPC tiles and tiles acquired in 2010 or later."""
    return tiles.where((F.col("format") == "copc") | (F.col("acquisition_year") >= 2010))


def first_source(tiles: DataFrame, by: list[str], priority: str = "priority") -> DataFrame:
    """Per request, the rows of the first source (lowest priority) that has any."""
    best = tiles.groupBy(*by).agg(F.min(priority).alias(priority))
    return tiles.join(best, [*by, priority], "left_semi")


# ---- ground truth --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SiteFeed:
    source: str
    name: list[str]
    default: str
    source_id: list[str]
    meta: dict[str, str]
    upper: tuple[str, ...] = ()
    rules: list[tuple[str, list[str], str]] = field(default_factory=list)
    otherwise: str = "unknown"


# Type codes of the first feed.
PASDA_TYPES = {"SINKHOLE": "sinkhole", "SURFACE DEPRESSION": "depression", "CAVE": "cave_entrance", "CAVE ENTRANCE": "cave_entrance", "SPRING": "spring",
               "MINE": "mine_portal", "SURFACE MINE": "mine_portal", "COLLAPSE": "collapse_pit"}
_DEPOSIT = {"commodity": "commod1", "county": "county"}
# Per feed, name and id properties, default name, kept properties, and ordered type rules (property, words, type).
SITE_FEEDS = {
    "pasda_karst": SiteFeed("pasda_karst", ["NAME", "FEAT_NAME"], "PASDA-", ["OBJECTID", "FID"], {"county": "COUNTY", "quad": "QUAD_NAME", "raw_type": "FEAT_TYPE"}, ("raw_type",)),
    "pa_aml": SiteFeed("pa_aml", ["MINE_NAME", "SITE_NAME"], "AML-", ["AML_ID", "OBJECTID"],
                       {"county": "COUNTY", "mine_type": "MINE_TYPE", "status": "STATUS", "hazard_class": "HAZARD"}, otherwise="mine_portal"),
    "usgs_ny": SiteFeed("usgs_ny", ["NAME"], "NY-Depression-", ["OBJECTID", "FID"], {"source_method": "SOURCE", "county": "COUNTY", "geology": "GEOLOGY"}, otherwise="depression"),
    "usgs_national": SiteFeed("usgs_national", ["UNIT_NAME", "MAP_UNIT"], "USGS-Karst-", ["OBJECTID", "FID"], {"rock_type": "ROCK_TYPE", "state": "STATE"}),
    "ohio_epa": SiteFeed("ohio_epa", ["NAME"], "OH-Karst-", ["OBJECTID"], {"county": "COUNTY", "raw_type": "TYPE"}, ("raw_type",),
                         [("TYPE", ["CAVE"], "cave_entrance"), ("TYPE", ["SINK"], "sinkhole"), ("TYPE", ["SPRING"], "spring")]),
    "nc_cave_survey": SiteFeed("nc_cave_survey", ["site_name"], "NC-", ["dep_id", "rec_id"], {**_DEPOSIT, "site_type": "site_type"}, ("commodity", "site_type"),
                               [("commod1", ["MICA", "FELDSPAR", "GOLD", "AU"], "mine_portal"), ("site_type", ["CAVE"], "cave_entrance")], "mine_portal"),
    "md_karst_survey": SiteFeed("md_karst_survey", ["site_name"], "MD-", ["dep_id", "rec_id"], {**_DEPOSIT, "site_type": "site_type"}, ("commodity", "site_type"),
                                [("commod1", ["COAL"], "mine_portal"), ("site_type", ["CAVE"], "cave_entrance"), ("commod1", ["LIMESTONE", "DOLOMITE"], "sinkhole")], "mine_portal"),
    "ma_usgs_mines": SiteFeed("ma_usgs_mines", ["site_name"], "MA-", ["dep_id", "rec_id"], _DEPOSIT, ("commodity",), [("commod1", ["MARBLE", "LIMESTONE"], "cave_entrance")], "mine_portal"),
    "la_subsidence": SiteFeed("la_subsidence", ["site_name"], "LA-", ["dep_id", "rec_id"], _DEPOSIT, ("commodity",), [("commod1", ["SALT", "BRINE", "SULFUR"], "salt_dome_collapse")], "mine_portal"),
    "ca_blm_aml": SiteFeed("ca_blm_aml", ["site_name"], "CA-", ["dep_id", "rec_id"], _DEPOSIT, ("commodity",), [], "mine_portal"),
}


def normalise_ground_truth(df: DataFrame, feed: str, target_states: list[str] | None = None) -> DataFrame:
    """Sites from one feed's rows: (row_id, props, points array<struct<lon,lat>>); non-points collapse to their vertex mean.

    Unnamed sites get the feed's default name and the row id. ``target_states`` limits the national feed.
    """
    spec, p = SITE_FEEDS[feed], F.col("props")
    n = F.size("points")
    mean = lambda f: F.aggregate("points", F.lit(0.0), lambda a, q: a + f(q)) / n
    rows = df.where(n > 0)
    if feed == "usgs_national" and target_states:
        rows = rows.where(p["STATE"].isin(target_states))
    kind = F.lit(spec.otherwise)
    if feed == "pasda_karst":
        code = F.upper(F.trim(F.coalesce(_first(p, ["FEAT_TYPE", "TYPE"]), F.lit(""))))
        kind = F.coalesce(F.element_at(F.create_map(*[x for k, v in PASDA_TYPES.items() for x in (F.lit(k), F.lit(v))]), code), F.lit("unknown"))
    for prop, words, value in reversed(spec.rules):
        text = F.upper(F.coalesce(_first(p, ["TYPE", "Feature_Type"]) if prop == "TYPE" else p[prop], F.lit("")))
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        kind = F.when(hit, value).otherwise(kind)
    meta = []
    for k, prop in spec.meta.items():
        v = F.coalesce(p[prop], F.lit(""))
        meta += [F.lit(k), F.upper(v) if k in spec.upper else v]
    return rows.select(
        F.coalesce(_first(p, spec.name), F.concat(F.lit(spec.default), F.col("row_id").cast("string"))).alias("name"), kind.alias("feature_type"),
        mean(lambda q: q.lon).alias("lon"), mean(lambda q: q.lat).alias("lat"), F.lit(spec.source).alias("source"),
        F.coalesce(_first(p, spec.source_id), F.lit("")).alias("source_id"), F.create_map(*meta).alias("metadata"))


def load_report(sites: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Rows per source, with expected sources that brought nothing marked as failed."""
    counts = sites.groupBy("source").agg(F.count("*").alias("rows"))
    if expected:
        names = sites.sparkSession.createDataFrame([(e,) for e in expected], "source string")
        counts = names.join(counts, "source", "full")
    return counts.select("source", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) == 0).alias("failed"))


def replace_by_source(df: DataFrame, path: str) -> None:
    """Idempotent reload: only the partitions of the sources present in ``df`` are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def seed_if_absent(new: DataFrame, existing: DataFrame, source: str = "manual") -> DataFrame:
    """``new`` rows when ``existing`` has none of the source, else nothing."""
    guard = existing.where(F.col("source") == source).select(F.lit(1).alias("_g")).limit(1)
    return new.withColumn("_g", F.lit(1)).join(guard, "_g", "left_anti").drop("_g")


# ---- map features --------------------------------------------------------------------------------------------------

# Tag filters per layer (any listed tag value makes a feature part of the layer; None takes any value).
LAYERS: dict[str, dict[str, list[str] | None]] = {
    "roads": {"highway": ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "unclassified", "living_street", "motorway_link",
                          "trunk_link", "primary_link", "secondary_link", "tertiary_link"]},
    "railways": {"railway": ["rail", "light_rail"]},
    "water": {"waterway": None, "natural": ["water"]},
    "landuse": {"landuse": ["industrial", "commercial", "retail", "construction", "quarry", "landfill"], "amenity": ["parking"],
                "leisure": ["golf_course", "pitch", "track", "sports_centre", "stadium"], "man_made": ["bridge", "pier", "breakwater", "embankment"]},
    "buildings": {"building": None},
    "cemeteries": {"landuse": ["cemetery"], "amenity": ["grave_yard"]},
}


def osm_layer(df: DataFrame, layer: str) -> DataFrame:
    """Features (id, tags map, geom_type, coords) of one layer; empty geometries are dropped."""
    hit = F.lit(False)
    for tag, values in LAYERS[layer].items():
        v = F.col("tags")[tag]
        hit = hit | F.coalesce(v.isNotNull() if values is None else v.isin(values), F.lit(False))
    out = df.where(hit)
    return out.where(F.size("coords") > 0) if "coords" in df.columns else out


def segments_of(features: DataFrame, layer: str) -> DataFrame:
    """Line features as consecutive-vertex segments."""
    pts = F.col("coords")
    legs = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts) - 1), lambda a, b: F.struct(a.lon.alias("x1"), a.lat.alias("y1"), b.lon.alias("x2"), b.lat.alias("y2")))
    return features.where(F.size(pts) > 1).select("id", F.lit(layer).alias("layer"), F.inline(legs))





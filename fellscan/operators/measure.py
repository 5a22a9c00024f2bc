"""Elevation profiles and ring measures over many request geometries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fellscan.functions.geodesy import authalic_area_term, geodesic, geodesic_end, with_utm
from fellscan.functions.scalars import utm_zone
from fellscan.operators.joins import sample_nearest


def legs(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """Consecutive vertex pairs with geodesic length, bearing and distance along the line. ``points array<struct<lon,lat>>``."""
    pts = F.col("points")
    pair = F.arrays_zip(F.slice(pts, 1, F.size(pts) - 1).alias("a"), F.slice(pts, 2, F.size(pts) - 1).alias("b"))
    rows = lines.where(F.size(pts) > 1).select(key, F.posexplode(pair).alias("leg", "s"))
    rows = rows.select(key, "leg", F.col("s").getField("a").alias("a"), F.col("s").getField("b").alias("b")) if "a" in rows.schema["s"].dataType.names else rows.select(
        key, "leg", F.col("s").getField("0").alias("a"), F.col("s").getField("1").alias("b"))
    rows = rows.withColumn("g", geodesic(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")))
    w = Window.partitionBy(key).orderBy("leg")
    return rows.select(key, "leg", F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"), F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"), F.col("g.distance_m").alias("length_m"),
                       F.col("g.azimuth").alias("azimuth")).withColumn("end_m", F.sum("length_m").over(w)).withColumn("start_m", F.col("end_m") - F.col("length_m"))


def line_lengths(lines: DataFrame, key: str = "line_id") -> DataFrame:
    return legs(lines, key).groupBy(key).agg(F.sum("length_m").alias("length_m"))


def ring_areas(rings: DataFrame, key: str = "line_id") -> DataFrame:
    """Area of closed rings on the ellipsoid's equal-area sphere."""
    c = F.col
    return legs(rings, key).groupBy(key).agg(F.abs(F.sum(authalic_area_term(c("lon1"), c("lat1"), c("lon2"), c("lat2")))).alias("area_m2"))


def profile_points(lines: DataFrame, n: int = 201, key: str = "line_id") -> DataFrame:
    """``n`` evenly spaced positions per line, both ends included: (key, i, distance_m, lon, lat)."""
    segs = legs(lines, key)
    total = segs.groupBy(key).agg(F.sum("length_m").alias("total_m"), F.max("leg").alias("last_leg"))
    want = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("distance_m", F.col("total_m") * F.col("i") / (n - 1))
    # a position on a vertex belongs to the leg that ends there
    on = want.join(segs, key).where(
        ((F.col("distance_m") > F.col("start_m")) | (F.col("leg") == 0)) & ((F.col("distance_m") <= F.col("end_m")) | (F.col("leg") == F.col("last_leg"))))
    moved = on.withColumn("p", geodesic_end(F.col("lon1"), F.col("lat1"), F.col("azimuth"), F.greatest(F.col("distance_m") - F.col("start_m"), F.lit(0.0))))
    return moved.select(key, "i", "distance_m", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def profiles(lines: DataFrame, surface: DataFrame, survey: DataFrame, n: int = 201, key: str = "line_id") -> DataFrame:
    """Profile positions with the elevation of the native cell under each, first source by (resolution, path)."""
    pts = profile_points(lines, n, key)
    flat = with_utm(pts.withColumn("zone", utm_zone("lon")), F.col("lon"), F.col("lat"), F.col("zone"), "x", "y")
    placed = flat.withColumns({"_id": F.concat_ws("|", F.col(key).cast("string"), F.col("i").cast("string"))})
    by_zone = survey.withColumn("zone", (F.col("epsg") % 100).cast("int"))
    epsgs = by_zone.select("zone", "epsg").distinct()
    best = sample_nearest(placed.join(epsgs, "zone").select("_id", "x", "y", "epsg"), surface, survey, "_id").where("elevation_m IS NOT NULL")
    rank = best.join(survey.select(F.col("source_id").alias("source"), "resolution_m", "path"), "source").groupBy("_id").agg(F.min(F.struct("resolution_m", "path", "source", "elevation_m")).alias("m"))
    return placed.join(rank, "_id", "left").select(key, "i", "distance_m", "lon", "lat", F.col("m.elevation_m").alias("elevation_m"), F.col("m.source").alias("source"))

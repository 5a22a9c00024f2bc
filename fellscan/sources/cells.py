"""Elevation and point tables: scans, profiles, inventory, overview levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRES = {"m", "metre", "meter", "metres", "meters", ""}


def dem_cells(df: DataFrame, nodata: float | None = None, scale: float = 1.0, offset: float = 0.0, units: str = "m", col: str = "z") -> DataFrame:
    """Present cells only, scaled; anything but metres is refused."""
    if units.strip().lower() not in METRES:
        raise ValueError(f"elevation units must be metres, got {units!r}")
    v = F.col(col)
    ok = v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < float("inf"))
    if nodata is not None:
        ok = ok & (v != nodata)
    return df.where(ok).withColumn(col, v * scale + offset)


def raster_profile(surface: DataFrame, col: str = "z") -> DataFrame:
    """Per survey: lattice shape, present and missing cells, value range and stored type."""
    rows, cols = F.max("row") - F.min("row") + 1, F.max("col") - F.min("col") + 1
    return surface.groupBy("survey_id").agg(
        rows.alias("height"), cols.alias("width"), F.count(col).alias("cells"), (rows * cols - F.count(col)).alias("nodata_cells"),
        F.min(col).alias("min_z"), F.max(col).alias("max_z")).withColumn("dtype", F.lit(surface.schema[col].dataType.simpleString()))


def point_cloud(df: DataFrame) -> DataFrame:
    """The six point columns in their declared types (other columns are never read)."""
    types = {"x": "double", "y": "double", "z": "double", "return_number": "int", "number_of_returns": "int", "classification": "int"}
    extra = ["survey_id"] if "survey_id" in df.columns else []
    return df.select(*extra, *[F.col(k).cast(t).alias(k) for k, t in types.items()])


def row_digest(*cols: str) -> list:
    """Eight 32-bit words of a row's SHA-256 as bigints; their sums identify a set of rows in any order."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    h = F.sha2(text, 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)]


def fingerprint(df: DataFrame, *cols: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Order-insensitive digest of the rows: SHA-256 over the count and the wrapped sums of the row-hash words.

    The sums combine on the map side, so nothing is sorted or collected however many rows there are.
    """
    cols = cols or tuple(sorted(df.columns))
    words = {f"_w{i}": w for i, w in enumerate(row_digest(*cols))}
    hashed = df.select(*keys, *[w.alias(k) for k, w in words.items()])
    sums = [F.pmod(F.sum(F.col(k).cast("decimal(38,0)")), F.lit(2**32).cast("decimal(38,0)")).cast("bigint").cast("string") for k in words]
    agg = hashed.groupBy(*keys) if keys else hashed.groupBy()
    return agg.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("digest"))


def dem_inventory(surface: DataFrame, survey: DataFrame) -> DataFrame:
    """Per survey: native bounds, resolution and a revision digest that changes with any cell.

    ``survey``: survey_id, epsg, x0, y0 (top-left corner), dx, dy.
    """
    box = surface.groupBy("survey_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("cells"))
    rev = fingerprint(surface, "row", "col", "z", keys=("survey_id",)).withColumnRenamed("digest", "revision")
    return box.join(survey, "survey_id").join(rev, "survey_id").select(
        "survey_id", "epsg", "cells", (F.col("x0") + F.col("c0") * F.col("dx")).alias("west"), (F.col("y0") - (F.col("r1") + 1) * F.col("dy")).alias("south"),
        (F.col("x0") + (F.col("c1") + 1) * F.col("dx")).alias("east"), (F.col("y0") - F.col("r0") * F.col("dy")).alias("north"),
        F.greatest("dx", "dy").alias("resolution_m"), "revision")


def overview(surface: DataFrame, factor: int, col: str = "z") -> DataFrame:
    """Block averages over ``factor`` x ``factor`` cells."""
    low = lambda c: F.floor(F.col(c) / factor).cast("bigint")
    return surface.groupBy("survey_id", low("row").alias("row"), low("col").alias("col")).agg(F.avg(col).alias(col))


def register_area(inventory: DataFrame, areas: DataFrame, slug: str, name: str) -> DataFrame:
    """The area list with ``slug`` added or replaced by the inventory's joint bounds and finest resolution."""
    fresh = inventory.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
                          F.min("resolution_m").alias("resolution_m")).where(F.col("west").isNotNull()).select(F.lit(slug).alias("slug"), F.lit(name).alias("name"), "west", "south", "east", "north", "resolution_m")
    return areas.where(F.col("slug") != slug).unionByName(fresh)

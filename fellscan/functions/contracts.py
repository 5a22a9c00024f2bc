"""Row-level rules: each helper turns a table into its violations, one row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRE_UNITS = ["m", "metre", "meter", "metres", "meters"]


def valid_scan(df: DataFrame, max_km: float = 4) -> DataFrame:
    """Add ``valid_scan``: west < east, south < north, and neither side longer than ``max_km`` (width at the middle latitude)."""
    width = (F.col("east") - F.col("west")) * 111.32 * F.cos(F.radians((F.col("north") + F.col("south")) / 2))
    height = (F.col("north") - F.col("south")) * 111.32
    ok = (F.col("west") < F.col("east")) & (F.col("south") < F.col("north")) & (width <= max_km) & (height <= max_km)
    return df.withColumn("valid_scan", ok)


def eligibility(survey: DataFrame) -> DataFrame:
    """Add ``reason`` (why a source cannot be used) and ``mosaic_reason`` (why it cannot be joined to others); null is fine.

    Needs epsg, dx, dy, units, scale, offset, survey_key, datum. A local projected metre CRS is a UTM-style code here:
    269xx, 326xx or 327xx.
    """
    c = F.col
    units = F.lower(F.trim(F.coalesce(c("units"), F.lit(""))))
    projected = F.floor(c("epsg") / 100).isin(269, 326, 327)
    finite = lambda x: c(x).isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) < float("inf"))
    reason = (
        F.when(c("epsg").isNull() | ~projected, "crs").when(~units.isin("", *METRE_UNITS), "units")
        .when(~(finite("dx") & finite("dy") & (c("dx") > 0) & (c("dy") > 0)), "spacing").when(~(finite("scale") & finite("offset")), "scale")
        .when(F.greatest("dx", "dy") > 5, "coarse"))
    blank = lambda x: F.coalesce(F.trim(c(x)), F.lit("")) == ""
    return survey.withColumn("reason", reason).withColumn(
        "mosaic_reason", F.coalesce("reason", F.when(blank("survey_key") | blank("datum") | ~units.isin(*METRE_UNITS), "undeclared")))


def drop_nonfinite(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    ok = F.lit(True)
    for k in (x, y):
        ok = ok & F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")) & (F.abs(F.col(k)) < float("inf"))
    return df.where(ok)


def _rules(df: DataFrame, key: Column | list[Column], rules: dict[str, Column]) -> DataFrame:
    named = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    keys = key if isinstance(key, list) else [key]
    return df.select(*keys, F.explode(named).alias("rule"))


def _points_rules(kind: Column, pts: Column, lat: float, n_rings: Column | None = None) -> dict[str, Column]:
    least = F.when(kind == "Point", 1).when(kind == "LineString", 2).otherwise(4)
    rules = {
        "geometry_type": kind.isin("Point", "LineString", "Polygon"),
        "vertices": (F.size(pts) >= least) & (F.size(pts) <= 500),
        "coordinates": F.forall(pts, lambda p: p.lon.isNotNull() & p.lat.isNotNull() & ~F.isnan(p.lon) & ~F.isnan(p.lat) & (F.abs(p.lon) <= 180) & (F.abs(p.lat) <= lat)),
        "ring_closed": (kind != "Polygon") | (F.element_at(pts, 1) == F.element_at(pts, -1)),
    }
    if n_rings is not None:
        rules["single_ring"] = (kind != "Polygon") | (n_rings == 1)
    return rules


def notebook_violations(df: DataFrame) -> DataFrame:
    """Broken rules of saved findings: (investigation_id, id, rule).

    Needs investigation_id, id, title, notes, evidence, created_at, updated_at, review, geometry_type, points. Duplicate
    ids inside an investigation and investigations with more than 1000 findings are reported as well.
    """
    text = {f"text_{k}": F.col(k).isNotNull() & (F.length(k) <= 100_000) for k in ("title", "notes", "evidence", "created_at", "updated_at")}
    rules = {**text, "review": F.col("review").isin("unreviewed", "interesting", "dismissed", "uncertain"), **_points_rules(F.col("geometry_type"), F.col("points"), 85)}
    rows = _rules(df, [F.col("investigation_id"), F.col("id")], rules)
    twice = df.groupBy("investigation_id", "id").agg(F.count("*").alias("n")).where("n > 1").select("investigation_id", "id", F.lit("duplicate_finding").alias("rule"))
    full = df.groupBy("investigation_id").agg(F.count("*").alias("n")).where("n > 1000").select("investigation_id", F.lit(None).cast(df.schema["id"].dataType).alias("id"), F.lit("too_many_findings").alias("rule"))
    return rows.unionByName(twice).unionByName(full)


def measurement_violations(df: DataFrame, max_m: float = 10_000) -> DataFrame:
    """Broken rules of measurement requests (id, geometry_type, points): shape rules and total length in (0, max_m].

    Lengths are great-circle sums over the points; polygons measure their perimeter.
    """
    from fellscan.functions.scalars import haversine_m

    pts = F.col("points")
    legs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(pts), F.lit(2))),
                       lambda i: haversine_m(F.try_element_at(pts, i - 1).lon, F.try_element_at(pts, i - 1).lat, F.try_element_at(pts, i).lon, F.try_element_at(pts, i).lat))
    length = F.aggregate(legs, F.lit(0.0), lambda a, d: a + F.coalesce(d, F.lit(0.0)))
    kind = F.col("geometry_type")
    rules = {**_points_rules(kind, pts, 85), "length": (length <= max_m) & ((kind == "Point") | (length > 0))}
    return _rules(df, F.col("id"), rules)

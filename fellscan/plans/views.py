"""Reads over stored detections and their companions: filters, pages, details, shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscan.operators.joins import within_distance


def json_has(col: str, value: str) -> Column:
    """The value is an element of a JSON array, or of an object's ``source_passes`` array."""
    c = F.col(col)
    plain = F.array_contains(F.from_json(c, "array<string>"), value)
    nested = F.array_contains(F.from_json(F.get_json_object(c, "$.source_passes"), "array<string>"), value)
    return F.coalesce(plain, F.lit(False)) | F.coalesce(nested, F.lit(False))


def within_bbox(df: DataFrame, w: float, s: float, e: float, n: float) -> DataFrame:
    """Strict interior of the box; range predicates on plain columns, so they prune row groups."""
    return df.where((F.col("lon") > w) & (F.col("lon") < e) & (F.col("lat") > s) & (F.col("lat") < n))


def query_detections(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, types: list[str] | None = None, source_pass: str | None = None,
                     min_conf: float = 0.0, validated: bool | None = None) -> DataFrame:
    out = within_bbox(df, *bbox) if bbox else df
    out = out.where(F.col("confidence") >= min_conf)
    if types:
        out = out.where(F.col("feature_type").isin([t.lower() for t in types]))
    if source_pass:
        out = out.where(json_has("source_passes", source_pass))
    if validated is not None:
        out = out.where(F.col("validated") == validated)
    return out


def page(df: DataFrame, order: list[Column], limit: int = 500, offset: int = 0, key: str = "id") -> DataFrame:
    return df.orderBy(*order, key).offset(offset).limit(min(limit, 50_000))


def page_with_total(df: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """The page by confidence, each row carrying the size of the whole result (one scalar joined to a bounded page)."""
    total = df.agg(F.count("*").alias("total_count"))
    return page(df, [F.desc("confidence")], limit, offset, key).crossJoin(F.broadcast(total))  # one row


def newest(df: DataFrame, n: int, when: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(when), F.desc(key)).limit(n)


def tour(det: DataFrame, n: int = 50, min_conf: float = 0.5) -> DataFrame:
    """Confident detections with plain depressions last."""
    return det.where(F.col("confidence") >= min_conf).orderBy((F.col("feature_type") == "depression").cast("int"), F.desc("confidence"), "id").limit(n)


def shortlist(det: DataFrame, bbox: tuple[float, float, float, float], n: int = 100, min_conf: float = 0.4) -> DataFrame:
    return page(query_detections(det, bbox, min_conf=min_conf), [F.desc("confidence")], n)


def nearest_first(tiles: DataFrame, lon: float, lat: float, n: int, key: str = "tile_id") -> DataFrame:
    """Tiles by distance of their centre (in degrees), ties by id."""
    cx, cy = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    return tiles.withColumn("dist", F.sqrt((cx - lon) ** 2 + (cy - lat) ** 2)).orderBy("dist", key).limit(n)


def ground_truth_in(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, limit: int = 1000, key: str = "site_id") -> DataFrame:
    return (within_bbox(df, *bbox) if bbox else df).orderBy(key).limit(limit)


def detection_detail(det: DataFrame, results: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """Detections beside their pass results and review events, one child per row (``kind`` pass, event, or null for none).

    Children stay rows: a detection with a very long history spreads like any other join output.
    """
    passes = results.select("detection_id", F.lit("pass").alias("kind"), F.col("ord").cast("bigint").alias("ord"), F.col("pass_name").alias("name"), F.col("raw_score").cast("double").alias("score"))
    history = events.select("detection_id", F.lit("event").alias("kind"), F.col("seq").cast("bigint").alias("ord"), F.lower("verdict").alias("name"), F.lit(None).cast("double").alias("score"))
    child = passes.unionByName(history)
    return det.join(child, det[key] == child["detection_id"], "left").drop("detection_id")


def site_recall(sites: DataFrame, det: DataFrame, radius_m: float = 200, key: str = "site_id") -> DataFrame:
    """Sites with ``detections`` near them and the nearest distance; ``found`` marks at least one."""
    pairs = within_distance(sites.select(key, "lon", "lat"), det.select("id", "lon", "lat"), radius_m)
    near = pairs.groupBy(F.col(f"a_{key}").alias(key)).agg(F.count("*").alias("detections"), F.min("distance_m").alias("nearest_m"))
    return sites.join(near, key, "left").withColumn("detections", F.coalesce("detections", F.lit(0))).withColumn("found", F.col("detections") > 0)



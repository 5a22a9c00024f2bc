"""Fusing candidates of several passes into one record per place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellscan.functions.scalars import FEATURE_TYPES, M_PER_DEG, classify
from fellscan.operators.components import eps_clusters
from fellscan.operators.regions import batch_morphometrics, pca_elongation

DISCOVERY = ["raised_features", "linear_features", "enclosures", "repeated_patterns", "geological_forms"]


def weight_of(weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(table, F.col("pass_name")), F.lit(1.0))


def type_order(col: Column) -> Column:
    order = F.array(*[F.lit(t) for t in FEATURE_TYPES])
    pos = F.array_position(order, col)
    return F.when(pos > 0, pos).otherwise(len(FEATURE_TYPES) + 1)


def split_families(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depression candidates, shape-family candidates); the latter never meet fusion or classification."""
    shape = F.col("pass_name").isin(DISCOVERY)
    return cands.where(~shape), cands.where(shape)


def union_passes(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def source_passes(cands: DataFrame, key: list[str]) -> DataFrame:
    return cands.groupBy(*key).agg(F.sort_array(F.collect_set("pass_name")).alias("source_passes"))


def cluster(cands: DataFrame, eps: float = 10.0, coords: str = "lonlat", scope: str | None = None, id_col: str = "cand_id",
            x: str = "x", y: str = "y", **knobs) -> DataFrame:
    """Add ``cluster_id``. ``lonlat`` scales degrees by 111 320 m and the mean latitude of the scope; ``metric`` uses x, y as they are."""
    if coords == "metric":
        return eps_clusters(cands, eps, x, y, id_col, scope, **knobs)
    by = [scope] if scope else []
    mean = cands.groupBy(*by).agg(F.avg("lat").alias("_lat0"))
    placed = cands.join(mean, by) if by else cands.crossJoin(F.broadcast(mean))  # one row
    placed = placed.withColumns({"_mx": F.col("lon") * M_PER_DEG * F.cos(F.radians("_lat0")), "_my": F.col("lat") * M_PER_DEG})
    return eps_clusters(placed, eps, "_mx", "_my", id_col, scope, **knobs).drop("_mx", "_my", "_lat0")


def exact_mean(value: Column) -> Column:
    """Mean by a decimal sum, so that it is the same in any order; what no decimal(28, 12) holds is left out."""
    exact = value.try_cast("decimal(28,12)")
    return F.sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0))


def merge_clusters(cands: DataFrame, weights: dict[str, float], bonus: float = 1.2, scope: str | None = None, id_col: str = "cand_id",
                   coords: str = "lonlat") -> DataFrame:
    """One row per cluster: weighted confidence with agreement bonus, voted type, mean place, mean measures, largest outline.

    Where candidates say whether they have an outline (``has_outline``), those that do come first for it.

    The candidates keep ``cluster_id``, so per-pass detail is a join away instead of a list that could grow with a
    crowded place; votes and measures aggregate by (cluster, type) and (cluster, key) first.
    """
    key = ([scope] if scope else []) + ["cluster_id"]
    px, py = ("lon", "lat") if coords == "lonlat" else ("x", "y")
    w = cands.withColumn("_w", weight_of(weights))
    base = w.groupBy(*key).agg(  # decimal sums are the same in any order
        F.sum((F.col("_w") * F.col("score")).cast("decimal(28,12)")).cast("double").alias("_ws"), F.sum(F.col("_w").cast("decimal(28,12)")).cast("double").alias("_sw"), F.sort_array(F.collect_set("pass_name")).alias("source_passes"),
        F.count("*").alias("members"), exact_mean(F.col(px)).alias(px), exact_mean(F.col(py)).alias(py),
        F.min(F.struct(*([(~F.col("has_outline")).alias("n")] if "has_outline" in cands.columns else []), (-F.coalesce("area_m2", F.lit(0.0))).alias("a"), F.col(id_col).alias("id"))).alias("_o"))
    votes = w.groupBy(*key, "feature_type").agg(F.round(F.sum(F.col("_w") * F.col("score")), 9).alias("v"))
    kind = votes.groupBy(*key).agg(F.min(F.struct((-F.col("v")).alias("v"), type_order(F.col("feature_type")).alias("o"), "feature_type")).alias("_t"))
    means = cands.select(*key, F.explode("morphometrics").alias("k", "v")).groupBy(*key, "k").agg(exact_mean(F.col("v")).alias("v"))
    maps = means.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("morphometrics"))
    raw = F.when(F.col("_sw") > 0, F.col("_ws") / F.col("_sw")).otherwise(F.lit(0.0))
    n = F.size("source_passes")
    conf = F.least(F.when(n >= 3, raw * bonus).otherwise(raw), F.lit(1.0))
    return base.join(kind, key).join(maps, key, "left").select(
        *key, px, py, conf.alias("score"), F.col("_t.feature_type").alias("feature_type"), F.coalesce("morphometrics", F.create_map().cast("map<string,double>")).alias("morphometrics"),
        "source_passes", n.alias("num_passes"), "members", F.col("_o.id").alias("outline_id"))


def fuse(cands: DataFrame, weights: dict[str, float], eps: float = 10.0, bonus: float = 1.2, min_conf: float = 0.3, coords: str = "lonlat",
         scope: str | None = None, id_col: str = "cand_id", **knobs) -> DataFrame:
    """Cluster, merge, and keep what reaches ``min_conf``. ``scope='tile_id'`` fuses tile by tile."""
    members = cluster(cands, eps, coords, scope, id_col, **knobs)
    return merge_clusters(members, weights, bonus, scope, id_col, coords).where(F.col("score") >= min_conf)


def enrich(fused: DataFrame, outline_cells: DataFrame, surface: DataFrame, res: float = 1.0) -> DataFrame:
    """Recompute measures inside each fused outline and let them overwrite the averaged ones.

    ``outline_cells``: (survey_id, region_id, row, col, outline_id) of the winning outlines.
    """
    cells = outline_cells.join(fused.select("outline_id").distinct(), "outline_id", "left_semi")
    shape = batch_morphometrics(cells, surface, res).join(pca_elongation(cells), ["survey_id", "region_id"])
    names = {"depth_m": "depth_m", "area_m2": "area_m2", "perimeter_m": "perimeter_m", "circularity": "circularity", "volume_m3": "volume_m3",
             "k_value": "k_value", "elongation": "elongation_pca"}
    pairs = [x for k, c in names.items() for x in (F.lit(k), F.col(c))]
    if "wall_slope_deg" in shape.columns:
        pairs += [F.lit("wall_slope_deg"), F.col("wall_slope_deg")]
    ids = cells.select("survey_id", "region_id", "outline_id").distinct()
    new = shape.join(ids, ["survey_id", "region_id"]).select("outline_id", F.create_map(*pairs).alias("_new"))
    old = F.col("morphometrics")
    merged = F.when(F.col("_new").isNull(), old).otherwise(
        F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("_new"), k)), F.col("_new")))
    return fused.join(new, "outline_id", "left").withColumn("morphometrics", merged).drop("_new")


def reclassify(fused: DataFrame) -> DataFrame:
    """Type from the merged measures; ``retyped`` marks a change. Depth falls back to the relief anomaly when missing."""
    m = F.col("morphometrics")
    depth = F.coalesce(m["depth_m"], m["lrm_anomaly_m"])
    kind = classify(depth, m["area_m2"], m["circularity"])
    return fused.withColumn("_k", kind).withColumn("retyped", F.col("_k") != F.col("feature_type")).withColumn("feature_type", F.col("_k")).drop("_k")


